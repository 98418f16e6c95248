"""Languages of documents and of their stretches, by rank-order profiles of character n-grams.

A profile is a language's most frequent n-grams in order. A unit of text (a sentence) is ranked the same way, and its
distance to a profile is the sum over its n-grams of how far they are out of place there, with a fixed penalty for those
that the profile lacks. The nearest profile wins; how much nearer it is than the next gives the confidence.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.text import _HIDDEN, _INLINE, _LINK, _MARKS, _QUOTES, _TAG, _URL

#: N-grams of a profile, and the lengths counted.
PROFILE = 1000
LENGTHS = (2, 3)
#: Sentences of known language that a profile is built from, at most, for each language.
MOST_SAMPLES = 5_000
#: A unit with fewer letter words that begin small (or of a text in capitals) isn't classified by itself.
LEAST_PROSE_WORDS = 4

# Names of the languages, by which labels are understood besides their codes.
NAMES = {
    "en": ("eng", "english"), "de": ("deu", "ger", "german"), "fr": ("fra", "fre", "french"), "es": ("spa", "spanish"), "pt": ("por", "portuguese"),
    "it": ("ita", "italian"), "nl": ("nld", "dut", "dutch"), "sv": ("swe", "swedish"), "pl": ("pol", "polish"), "ru": ("rus", "russian"),
}

_COMMENT = re.compile(r"<!--.*?(?:-->|$)", re.S)
_TABLE_LINE = re.compile(r"^\s*(?:[|!]|\{\||=+[^=]|#\s*redirect)", re.I)
_BREAK = re.compile(r"\{\{[^{}|\n]*\|?|\}\}|\||\n|</?(?:blockquote|ref|p|div|br|li|td|tr|table|h\d)(?:\s[^<>]*)?/?>", re.I)
_END = re.compile(r"(?<=[.!?])[\"'”“»)\]]*\s+")
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+")


def label_language(label: Column) -> Column:
    """The language that a label names (two letters), in any spelling: code, code with region, English name; else null."""
    head = F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]+)(?:[-_].*)?$", 1))
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(head.isin(code, *names), code).otherwise(out)
    return out


def units(text: str) -> list[str]:
    """The stretches of running text between sentence ends, lines and markup, however short."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _HIDDEN.sub("", text)
    if "<!--" in text:
        text = _COMMENT.sub("\n", text)
    if "[[" in text:
        text = _LINK.sub("", text).replace("[[", "").replace("]]", "")
    if "http" in text:
        text = _URL.sub(" ", text)
    if "''" in text:
        text = _QUOTES.sub("", text)
    out = []
    for line in text.split("\n"):
        if _TABLE_LINE.match(line):
            continue
        if "<" in line or "|" in line or "{" in line:
            parts = [_TAG.sub(" ", _INLINE.sub("", p)) for p in _BREAK.split(line)]
        else:
            parts = [line]
        for p in parts:
            if p:
                out.extend(_END.split(p))
    return out


def _table() -> np.ndarray:
    """Code of each character: 0 for what isn't a letter, the same for a letter with and without accents."""
    t = np.zeros(65536, np.uint8)
    letters = "abcdefghijklmnopqrstuvwxyzßæøłđðþœ" + "абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґ"
    for i, c in enumerate(letters):
        t[ord(c)] = i + 1
    for i in range(0xC0, 0x250):
        base = _MARKS.sub("", unicodedata.normalize("NFKD", chr(i).lower()))
        if len(base) == 1 and t[ord(base)] and not t[i]:
            t[i] = t[ord(base)]
    t[ord("й")] = t[ord("и")]
    for i in range(0x250):
        low = chr(i).lower()
        if len(low) == 1 and t[ord(low)]:
            t[i] = t[ord(low)]
    for i in range(0x400, 0x460):
        t[i] = t[ord(chr(i).lower())]
    return t


_CODES = _table()
_BITS = 7


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram) of every n-gram within words, with the spaces around them."""
    joined = " " + "  ".join(texts) + " "
    raw = np.frombuffer(joined.encode("utf-16-le", "surrogatepass"), np.uint16)
    code = _CODES[raw].astype(np.int64)
    size = np.array([len(t) if t.isascii() else len(t.encode("utf-16-le", "surrogatepass")) // 2 for t in texts], np.int64)
    own = np.repeat(np.arange(len(texts)), size + 2)
    own = np.r_[own, own[-1:]][: len(code)] if len(code) > len(own) else own[: len(code)]
    # runs of other characters become one space
    keep = (code > 0) | np.r_[True, code[:-1] > 0]
    code, own = code[keep], own[keep]
    who, grams = [], []
    for n in LENGTHS:
        if len(code) < n:
            continue
        g = np.full(len(code) - n + 1, 1, np.int64)
        for j in range(n):
            g = (g << _BITS) | code[j : len(code) - n + 1 + j]
        inside = own[: len(g)] == own[n - 1 :]
        middle = code[: len(g)] > 0 if n == 1 else (code[1 : len(g) + 1] > 0) if n == 3 else (code[: len(g)] > 0) | (code[1 : len(g) + 1] > 0)
        ok = inside & middle
        who.append(own[: len(g)][ok])
        grams.append(g[ok])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *who]), np.concatenate([none, *grams])


def _ranked(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, rank by falling frequency, ties sharing their mean rank)."""
    who, gram = _grams(texts)
    key = np.sort((who << (3 * _BITS + 1)) | gram)
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    count = np.diff(np.r_[at, len(key)])
    key = key[at]
    who = key >> (3 * _BITS + 1)
    level = (who << 32) | ((1 << 31) - count)
    o = np.argsort(level, kind="stable")
    level = level[o]
    first = np.flatnonzero(np.r_[True, level[1:] != level[:-1]][: len(level)])
    size = np.diff(np.r_[first, len(level)])
    begin = np.searchsorted(who[o], np.arange(len(texts)))
    rank = np.repeat(first - begin[who[o][first]] + (size - 1) / 2, size)
    return who[o], key[o] & ((1 << (3 * _BITS + 1)) - 1), rank


class Profiles:
    """Rank-order profiles of languages, from samples of each."""

    def __init__(self, samples: dict[str, list[str]], limit: bool = True):
        self.langs = sorted(samples)
        tables = []
        for lang in self.langs:
            _, gram, rank = _ranked([" . ".join(samples[lang])])
            o = np.lexsort((gram, rank))[:PROFILE]
            tables.append(dict(zip(gram[o].tolist(), range(len(o)))))
        known = sorted(set().union(*tables))
        self.index = np.zeros(1 << (3 * _BITS + 1), np.int32)
        self.index[known] = np.arange(1, len(known) + 1)
        self.place = np.full((len(known) + 1, len(self.langs)), np.nan, np.float32)
        for j, t in enumerate(tables):
            for g, r in t.items():
                self.place[self.index[g], j] = r
        # How near units of a language come to a profile of other samples: what is much farther is no prose.
        self.limit = 1.0
        if limit:
            half = Profiles({k: v[::2] for k, v in samples.items()}, limit=False)
            own = [d for j, k in enumerate(self.langs) for d in half.distances(samples[k][1::2])[:, j]]
            self.limit = float(np.quantile(own, 0.99) + 0.1) if own else 1.0

    def distances(self, texts: list[str]) -> np.ndarray:
        """Mean distance of each text to each profile, as a part of the penalty for a missing n-gram."""
        out = np.ones((len(texts), len(self.langs)))
        if not texts:
            return out
        who, gram, rank = _ranked(texts)
        if not len(who):
            return out
        place = self.place[self.index[gram]]
        far = np.minimum(np.abs(place - rank[:, None].astype(np.float32)), PROFILE)
        far[np.isnan(far)] = PROFILE
        at = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        out[who[at]] = np.add.reduceat(far, at, axis=0) / np.diff(np.r_[at, len(who)])[:, None] / PROFILE
        return out


#: Languages within this of the nearest profile are undecided by a unit alone; its surroundings decide.
CLOSE = 0.05
_SMALL = re.compile(r"(?<![^\W\d_])[^\W\d_]+")


class Reader:
    """Stretches of a text by language. What was read once is kept (up to ``most`` units), as revisions share their sentences."""

    def __init__(self, profiles: Profiles, most: int = 100_000):
        self.profiles, self.most = profiles, most
        self.seen: dict[str, tuple[np.ndarray, int] | None] = {}

    def _learn(self, texts: list[str]) -> None:
        new = []
        for t in texts:
            w = t.split()
            n = sum(1 for x in w if any(map(str.isalnum, x[:3])) or any(map(str.isalnum, x)))
            small = sum(1 for x in _SMALL.findall(t) if x.islower()) if n >= LEAST_PROSE_WORDS else 0
            if n >= LEAST_PROSE_WORDS and (small >= LEAST_PROSE_WORDS or (small <= 1 and t.isupper())):
                new.append((t, n))
            else:
                self.seen[t] = None
        far = self.profiles.distances([t for t, _ in new])
        for (t, n), d in zip(new, far):
            self.seen[t] = (d, n) if d.min() <= self.profiles.limit else None

    def read(self, texts: list[str | None]) -> list[list[tuple[str, float, int, str]]]:
        """Of each text its stretches (language, confidence, words, beginning)."""
        split = [units(t) if t else [] for t in texts]
        if len(self.seen) > self.most:
            self.seen.clear()
        new = {u for us in split for u in us if u not in self.seen}
        if new:
            self._learn(sorted(new))
        return [self._stretches([(u, *self.seen[u]) for u in us if self.seen[u]]) for us in split]

    def _stretches(self, known: list[tuple[str, np.ndarray, int]]) -> list[tuple[str, float, int, str]]:
        if not known:
            return []
        far = np.array([d for _, d, _ in known])
        size = np.array([n for *_, n in known])
        best = far.argmin(axis=1)
        near = far <= far.min(axis=1)[:, None] + CLOSE
        sure = near.sum(axis=1) == 1
        if not sure.all():
            whole = int((far * size[:, None]).sum(axis=0).argmin())
            for i in np.flatnonzero(~sure):
                # undecided alone: as the sure neighbours say, else as the whole text
                around = [int(best[j]) for j in (i - 1, i + 1) if 0 <= j < len(best) and sure[j]]
                fits = [j for j in [*around, whole] if near[i, j]]
                best[i] = fits[0] if fits else best[i]
        cut = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
        out = []
        for a, b in zip(cut, [*cut[1:], len(best)]):
            mean = np.average(far[a:b], axis=0, weights=size[a:b])
            lang = int(best[a])
            rest = np.delete(mean, lang).min() if len(mean) > 1 else 1.0
            out.append((self.profiles.langs[lang], float(np.clip((rest - mean[lang]) / 0.1, 0, 1)), int(size[a:b].sum()), known[a][0][:80]))
        return out

    def overall(self, text: str | None, found: list[tuple[str, float, int, str]]) -> tuple[str | None, float, int, int]:
        """(language, confidence, words of prose, languages of prose) of a whole text, from its stretches: the language with most
        words, sure to the part of the prose that is in it. Without prose all of the text's words decide together, and
        nothing does where there are none."""
        if found:
            words: dict[str, float] = {}
            sure: dict[str, float] = {}
            for lang, c, n, _ in found:
                words[lang] = words.get(lang, 0) + n
                sure[lang] = sure.get(lang, 0) + c * n
            lang = max(sorted(words), key=words.get)
            total = sum(words.values())
            return lang, sure[lang] / total, int(total), len(words)
        far = self.profiles.distances([" ".join(units(text))])[0] if text else np.ones(1)
        best = int(far.argmin())
        if far[best] >= 1:
            return None, 0.0, 0, 0
        rest = np.delete(far, best).min() if len(far) > 1 else 1.0
        return self.profiles.langs[best], float(np.clip((rest - far[best]) / 0.1, 0, 1)), 0, 0


def fit_profiles(samples: DataFrame, lang: str = "lang", text: str = "text") -> Profiles:
    """Profiles from at most ``MOST_SAMPLES`` sentences of each language (those first by a hash of their text)."""
    rows = samples.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and trim(text) <> ''")
    # langs are few; of each a bounded number of rows is kept before anything is collected
    kept = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    share = {r[0]: r[1] for r in kept}
    by: dict[str, list[str]] = {}
    for k, n in sorted(share.items()):
        part = rows.where(F.col("lang") == k)
        if n > MOST_SAMPLES:
            part = part.orderBy(F.xxhash64("text"), "text").limit(MOST_SAMPLES)
        by[k] = sorted(r[1] for r in part.collect())
    return Profiles(by)


def stretches(documents: DataFrame, profiles: Profiles, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each stretch of a document in one language: ``doc_id``, ``stretch`` (its number), ``lang``, ``confidence`` (0 to 1),
    ``n_words``, ``begins`` (its first characters).

    Markup, tables, fields, headings, names, senseless typing and sentences of fewer than ``LEAST_PROSE_WORDS`` words are passed
    over and not counted, so a document without prose, or without text, gives no row (:func:`document_languages` gives one). Each row of ``documents`` is read whole, copies too; other columns are ignored.
    """
    held = documents.sparkSession.sparkContext.broadcast(profiles)  # ten languages of PROFILE n-grams

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(held.value)
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                found = reader.read(part.column("text").to_pylist())
                rows = [(d, i, *s) for d, of in enumerate(found) for i, s in enumerate(of)]
                if rows:
                    d, i, lang, sure, n, begins = zip(*rows)
                    yield pa.record_batch([part.column("doc").take(pa.array(d)), pa.array(i, pa.int32()), pa.array(lang), pa.array(sure), pa.array(n, pa.int64()), pa.array(begins)], names=["doc", "stretch", "lang", "confidence", "n_words", "begins"])

    rows = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    out = rows.mapInArrow(read, f"doc {rows.schema['doc'].dataType.simpleString()}, stretch int, lang string, confidence double, n_words long, begins string")
    return out.select(F.col("doc").alias(doc_id), "stretch", "lang", "confidence", "n_words", "begins")


def document_languages(documents: DataFrame, profiles: Profiles, doc_id: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """One row for each row of ``documents``: ``doc_id``, ``lang``, ``confidence`` (0 to 1), ``n_words`` of prose, ``n_langs`` of prose,
    ``named`` (the language that the label names, or null) and ``label_is`` ('right', 'wrong' or 'missing').

    A text's language is the one with most words of prose; a text without prose (tables, names, fields) has the one that all its
    words are nearest to, with 0 words, and calls no label wrong (``label_is`` is null then). Texts that are null, empty or without
    letters of the profiles have a null language and confidence 0. Whole texts are read; other columns are ignored.
    """
    held = documents.sparkSession.sparkContext.broadcast(profiles)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(held.value)
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                texts = part.column("text").to_pylist()
                lang, sure, n, many = zip(*[reader.overall(t, of) for t, of in zip(texts, reader.read(texts))]) if texts else ((),) * 4
                yield pa.record_batch([part.column("doc"), part.column("named"), pa.array(lang, pa.string()), pa.array(sure, pa.float64()), pa.array(n, pa.int64()), pa.array(many, pa.int32())], names=["doc", "named", "lang", "confidence", "n_words", "n_langs"])

    rows = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"), label_language(F.col(label)).alias("named"))
    out = rows.mapInArrow(read, f"doc {rows.schema['doc'].dataType.simpleString()}, named string, lang string, confidence double, n_words long, n_langs int")
    is_ = F.when(F.col("named").isNull(), "missing").when(F.col("lang") == F.col("named"), "right").when(F.col("n_words") > 0, "wrong")
    return out.select(F.col("doc").alias(doc_id), "lang", "confidence", "n_words", "n_langs", "named", is_.alias("label_is"))


def unlabelled_languages(documents: DataFrame, profiles: Profiles, least_words: int = 15, doc_id: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """The languages of which a document holds a stretch of ``least_words`` or more, and which its label doesn't name: ``doc_id``,
    ``lang``, ``n_words`` (of the longest stretch), ``confidence`` (of the surest such stretch)."""
    held = documents.sparkSession.sparkContext.broadcast(profiles)
    langs = profiles.langs

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(held.value)
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                rows = []
                for d, (of, named) in enumerate(zip(reader.read(part.column("text").to_pylist()), part.column("named").to_pylist())):
                    for lang in langs:
                        own = [s for s in of if s[0] == lang and s[2] >= least_words]
                        if own and lang != named:
                            rows.append((d, lang, max(s[2] for s in own), max(s[1] for s in own)))
                if rows:
                    d, lang, n, sure = zip(*rows)
                    yield pa.record_batch([part.column("doc").take(pa.array(d)), pa.array(lang), pa.array(n, pa.int64()), pa.array(sure)], names=["doc", "lang", "n_words", "confidence"])

    rows = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"), label_language(F.col(label)).alias("named")).where(F.col("text").isNotNull())
    out = rows.mapInArrow(read, f"doc {rows.schema['doc'].dataType.simpleString()}, lang string, n_words long, confidence double")
    return out.select(F.col("doc").alias(doc_id), "lang", "n_words", "confidence")
