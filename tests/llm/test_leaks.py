import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathloom.llm import leaks
from pathloom.llm.text import spaced_words, words

WORDS = ["ka", "lo", "mi", "ru", "te", "zo", "pra", "ven", "dul", "shi"]


def name(r):
    return "".join(r.choice(WORDS) for _ in range(3))


def passage(r, n):
    return " ".join(r.choice(["the", "of", "and", "was", "in", "a"]) if r.random() < 0.5 else name(r) for _ in range(n))


@pytest.fixture(scope="module")
def items():
    r = random.Random(1)
    return pd.DataFrame([(i, passage(r, r.randrange(24, 60)), passage(r, 18)) for i in range(60)], columns=["item_id", "passage", "question"])


def test_plain_text():
    assert words("L&#39;<b>&eacute;l</b>an [[Page name|of ''time'']]: Stra­ße &amp; 12") == ["l", "elan", "of", "time", "strasse", "12"]
    assert words("a<br>b <ref name='x' /> c") == ["a", "b", "c"]
    assert [len(w) for w in spaced_words("l'eau du puits-là , !")] == [2, 1, 2]


def plain_runs(index_items, texts, run=12):
    grams = {}
    for i, p, q in zip(index_items["item_id"], index_items["passage"], index_items["question"]):
        for part in (p, q):
            s = spaced_words(part)
            for a in range(len(s) - run + 1):
                grams.setdefault(tuple(w for g in s[a : a + run] for w in g), set()).add(i)
    sizes, out = {len(g) for g in grams}, set()
    for d, t in enumerate(texts):
        w = words(t or "")
        for m in sizes:
            for a in range(len(w) - m + 1):
                out |= {(d, i) for i in grams.get(tuple(w[a : a + m]), ())}
    return out


def test_against_all_pairs(items):
    r = random.Random(2)
    texts = []
    for k in range(400):
        body = passage(r, r.randrange(0, 400)).split()
        if k % 2 == 0:
            src = items.iloc[r.randrange(60)][r.choice(["passage", "question"])].split()
            n = r.choice([10, 11, 12, 13, 30])
            a = r.randrange(max(1, len(src) - n))
            at = r.randrange(len(body) + 1)
            body[at:at] = src[a : a + n]
        texts.append(" ".join(body).upper() if k % 7 == 0 else ",\n".join(body))
    texts += [None, "", "word " * 50_000]
    index = leaks.LeakIndex(items)
    got = index.search(texts)
    assert {(d, int(index.ids[i])) for d, i, how in got if how == "run"} == plain_runs(items, texts)


def test_index_grows_with_the_words_of_the_items():
    """Twenty times the items, with new words in each: no array grows faster."""
    r, size = random.Random(5), {}
    for n in (500, 10_000):
        rows = [(i, " ".join(f"w{r.randrange(40 * n)}" if r.random() < 0.3 else name(r) for _ in range(40)), passage(r, 15)) for i in range(n)]
        index = leaks.LeakIndex(pd.DataFrame(rows, columns=["item_id", "passage", "question"]))
        size[n] = index.bytes()
        texts = [f"{passage(r, 60)} {rows[k][1]} {passage(r, 30)}" for k in (3, n // 2, n - 1)]
        assert {(d, int(index.ids[i])) for d, i, _ in index.search(texts)} == {(0, 3), (1, n // 2), (2, n - 1)}
    assert size[10_000] <= 21 * size[500]


def test_large_keys(items, monkeypatch):
    """Sums over keys too large for an array are the same."""
    texts = [f"{items.iloc[k].passage} and more" for k in range(60)]
    want = sorted(leaks.LeakIndex(items).search(texts))
    real = leaks._sums
    monkeypatch.setattr(leaks, "_sums", lambda k, v, room: real(k, v, 1 << 40))
    assert sorted(leaks.LeakIndex(items).search(texts)) == want and len(want) >= 60
    monkeypatch.setattr(leaks, "MOST_POSTINGS", 100)
    assert sorted(leaks.LeakIndex(items).search(texts)) == want


def test_changed_passages(items):
    r = random.Random(3)
    index = leaks.LeakIndex(items)
    for k in range(60):
        w = items.iloc[k].passage.split()
        allowed = len(w) // 6
        for changes, hit in ((allowed, True), (allowed * 2 + 3, False)):
            at = [int((j + 0.5) * len(w) / changes) for j in range(changes)]
            v = [f"qq{j}" if j in at else x for j, x in enumerate(w)]
            found = index.search([f"{passage(r, 100)} {' '.join(v)} {passage(r, 100)}"])
            assert any(index.ids[i] == k for _, i, _ in found) == hit, (k, changes)


def test_changed_words_of_several_runs():
    """A word between spaces counts once, whatever the runs of letters of it and of the word in its place."""
    w = [f"word{chr(97 + i)}" for i in range(24)]
    w[3], w[11], w[19] = "l'eau", "12-year", "mother-in-law"
    index = leaks.LeakIndex(pd.DataFrame([(7, " ".join(w), None)], columns=["item_id", "passage", "question"]))

    def found(**other):
        v = [other.get(f"w{i}", x) for i, x in enumerate(w)]
        return [how for _, _, how in index.search([f"some text before {' '.join(v)} and after"])]

    assert found(w3="fire", w8="x", w11="old", w19="uncle") == ["passage"]  # four words of 24
    assert found(w3="", w8="x", w11="old", w19="uncle") == ["passage"]
    assert found(w3="d'air", w8="x-ray", w11="year", w19="uncle") == ["passage"]
    assert found(w3="l air", w8="x", w11="12 year", w19="mother in law", w15="y") == ["passage"]
    assert found(w3="fire", w8="x", w11="old", w19="uncle", w15="y") == []  # five


def test_alignment():
    p = np.array([1, 2, 3, 4, 5])
    assert leaks.aligned(p, np.array([9, 1, 2, 3, 4, 5, 9])) == 0
    assert leaks.aligned(p, np.array([9, 1, 2, 8, 4, 5, 9])) == 1
    assert leaks.aligned(p, np.array([1, 2, 4, 5])) == 1
    assert leaks.aligned(p, np.array([1, 2, 3, 7, 4, 5])) == 1


def test_operator(spark, items, monkeypatch):
    docs = spark.createDataFrame([(1, items.iloc[3].passage), (2, None), (3, ""), (4, "nothing here"), (5, items.iloc[4].question), (5, items.iloc[4].question)], "doc_id long, text string").withColumns({"doc": F.lit(0), "how": F.lit(0)})
    tests = spark.createDataFrame([*items.itertuples(index=False, name=None), (99, None, None), (98, "", "")], "item_id long, passage string, question string")
    for most in (40_000_000, 3_000):
        monkeypatch.setattr(leaks, "MOST_CHARACTERS", most)
        found = [(r.item_id, r.doc_id) for r in leaks.leaked_items(docs, tests).collect()]
        assert sorted(found) == [(3, 1), (4, 5), (4, 5)]
    assert leaks.leaked_items(docs.limit(0), tests).count() == 0
    assert leaks.leaked_items(docs, tests.limit(0)).count() == 0


def test_answers(spark, items):
    """Whether the answer occurs too is told, but decides nothing."""
    q = items.iloc[4].question
    docs = spark.createDataFrame([(1, f"{q} It is L\u2019'''Eau''' claire."), (2, f"{q} It is the eau, claire or not."), (3, "l'eau claire")], "doc_id long, text string")
    for answer, told in (("l'eau claire", {1: True, 2: False}), (None, {1: None, 2: None})):
        tests = spark.createDataFrame([(4, None, q, answer)], "item_id long, passage string, question string, answer string")
        assert {r.doc_id: r.answered for r in leaks.leaked_items(docs, tests).collect()} == told
