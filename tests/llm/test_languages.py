import pytest
from pyspark.sql import functions as F

from pathloom.llm import languages as lang

SAMPLES = {
    "en": ["The old mill was closed after the war because nobody wanted to work there any more.", "She wrote that the river had been full of boats when her father was young.", "Nothing in this book would have been possible without the help of their friends.", "They say the house at the end of the street was built by a captain who never came home."],
    "de": ["Die alte Mühle wurde nach dem Krieg geschlossen, weil niemand mehr dort arbeiten wollte.", "Sie schrieb, dass der Fluss voller Boote war, als ihr Vater noch jung gewesen ist.", "Nichts in diesem Buch wäre ohne die Hilfe ihrer Freunde möglich gewesen.", "Man sagt, das Haus am Ende der Straße habe ein Kapitän gebaut, der nie nach Hause kam."],
    "es": ["El viejo molino cerró después de la guerra porque nadie quería trabajar allí.", "Ella escribió que el río estaba lleno de barcos cuando su padre era joven.", "Nada en este libro habría sido posible sin la ayuda de sus amigos.", "Dicen que la casa al final de la calle la construyó un capitán que nunca volvió."],
    "ru": ["Старая мельница закрылась после войны, потому что никто не хотел там работать.", "Она писала, что река была полна лодок, когда её отец был молод.", "Ничего в этой книге не было бы возможно без помощи друзей.", "Говорят, что дом в конце улицы построил капитан, который не вернулся."],
}


@pytest.fixture(scope="module")
def profiles():
    return lang.Profiles(SAMPLES)


def test_held_out(profiles):
    held = {"en": "Some of the people who had been there before the flood said that it was nothing.", "de": "Einige der Leute, die vor der Flut dort gewesen waren, sagten, dass es nichts war.", "es": "Algunas de las personas que estaban allí antes de la inundación decían que no era nada.", "ru": "Некоторые люди, которые были там раньше, говорили, что ничего не было."}
    for k, t in held.items():
        d = profiles.distances([t, t.upper()])
        assert [profiles.langs[j] for j in d.argmin(axis=1)] == [k, k]


def test_distance_against_definition(profiles):
    """Ranks and places counted the plain way."""
    t = "the man and the sea"
    coded = [c for c in t]
    grams = {}
    padded = f" {t} "
    for n in lang.LENGTHS:
        for i in range(len(padded) - n + 1):
            g = padded[i : i + n]
            ok = g[0] != " " or g[1] != " " if n == 2 else g[1] != " "
            if ok:
                grams[g] = grams.get(g, 0) + 1
    who, gram, rank = lang._ranked([t])
    assert len(gram) == len(grams) and len(coded) == len(t)
    order = sorted(grams.values(), reverse=True)
    mean = {c: sum(i for i, v in enumerate(order) if v == c) / order.count(c) for c in set(order)}
    assert sorted(rank.tolist()) == sorted(mean[c] for c in grams.values())


def test_stretches_and_labels(spark, profiles):
    en = " ".join(SAMPLES["en"])
    mixed = f"'''Title''' – {en}\n\n{{{{quote|{' '.join(SAMPLES['es'][:3])}}}}}\n\n{en}"
    docs = [
        (1, en, "en"), (2, en, "de-AT"), (3, mixed, "English"), (4, None, "en"), (5, "", None), (6, "| name = Die alte Mühle\n| place = am Fluss\n", "en"),
        (7, f"{en} (Die alte Mühle am Fluss wurde geschlossen)", "EN"), (8, "sdkfj wqlek jsdlfk wlekr sdfkj wqelkr sdlkfj qwlekr sdlkfj wqe rlkj sdflkj qwelkrj sdf wer", "en"), (9, en, "und"), (10, en + "\n" + " ".join(SAMPLES["ru"]), None),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"doc": F.lit(0), "stretch": F.lit(0), "named": F.lit(0)})
    found = {(r.doc_id, r.lang) for r in lang.unlabelled_languages(df, profiles).collect()}
    assert found == {(2, "en"), (3, "es"), (9, "en"), (10, "en"), (10, "ru")}
    parts = lang.stretches(df.where("doc_id = 3"), profiles).orderBy("stretch").collect()
    assert [p.lang for p in parts] == ["en", "es", "en"] and all(0 <= p.confidence <= 1 for p in parts)
    assert lang.unlabelled_languages(df.limit(0), profiles).count() == 0
    long_ = spark.createDataFrame([(1, "lang " * 400_000 + en * 200, "de")], "doc_id long, text string, lang string")
    assert {r.lang for r in lang.unlabelled_languages(long_, profiles).collect()} == {"en"}


def test_every_document_has_a_language(spark, profiles):
    en, de = (" ".join(SAMPLES[k]) for k in ("en", "de"))
    verse = "\n".join(["es war so da", "er ist in ja", "so ging er zu"])  # lines of four words
    docs = [(1, en, "en"), (1, en, "en"), (2, f"{en}\n\n{SAMPLES['de'][0]}", "de"), (3, None, "en"), (4, "", None), (5, "| Die alte Mühle = nach dem Krieg", None), (6, "x", "x"), (7, "123 +", "fr"), (8, verse, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"doc": F.lit(0), "named": F.lit(0), "confidence": F.lit(0)})
    got = sorted(((r.doc_id, r.lang, r.label_is, r.n_langs, r.n_words > 0) for r in lang.document_languages(df, profiles).collect()), key=str)
    assert got[:3] == [(1, "en", "right", 1, True), (1, "en", "right", 1, True), (2, "en", "wrong", 2, True)]
    assert [g[0] for g in got] == [1, 1, 2, 3, 4, 5, 6, 7, 8]
    assert got[3][1:3] == (None, None) and got[4][1:3] == (None, "missing") and got[7][1:3] == (None, None) and got[8][1:3] == ("de", "missing")
    assert all(0 <= r.confidence <= 1 for r in lang.document_languages(df, profiles).collect())
    assert lang.document_languages(df.limit(0), profiles).count() == 0


def test_counts_of_frequent_grams_differ():
    """However frequent n-grams are, their ranks tell them apart."""
    _, gram, rank = lang._ranked(["to " * 60_000 + "so " * 50_000])
    assert len(set(rank[:6].tolist())) >= 3


def test_label_spellings(spark):
    rows = [("en", "en"), ("EN", "en"), ("en_us", "en"), ("en-GB", "en"), ("English", "en"), ("eng", "en"), ("ger", "de"), ("fre", "fr"), ("dut", "nl"), ("und", None), ("mul", None), ("xx", None), ("", None), (None, None), (" pt-BR ", "pt"), ("unknown", None), ("Polish", "pl")]
    df = spark.createDataFrame(rows, "label string, want string")
    for r in df.withColumn("got", lang.label_language(F.col("label"))).collect():
        assert r.got == r.want, r


def test_fit(spark):
    rows = [(k, t) for k, ts in SAMPLES.items() for t in ts] + [(None, "x"), ("en", None), ("en", " ")]
    p = lang.fit_profiles(spark.createDataFrame(rows, "lang string, text string"))
    assert p.langs == sorted(SAMPLES)
