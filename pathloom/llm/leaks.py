"""Held-out test items that appear in training texts.

The items are the documents of an inverted index with BM25 impacts, cut into blocks with their maxima; every stretch of
every training text is a query. The threshold is the least score that any true case can have (computed from the items),
so that all true cases are retrieved. WAND skips what cannot reach it: stretches whose block maxima stay below, and
items that share only terms too frequent to reach the threshold together. What is retrieved is verified word by word.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.text import spaced_words, words

#: Characters of the items of one index, which is built by the driver and sent to every task (see :meth:`LeakIndex.bytes`: about
#: seven bytes for each); items with more are searched for in several passes over the corpus.
MOST_CHARACTERS = 40_000_000
#: Terms of at most this part of the items, and of at most so many, are essential; every case has one in any event.
RARE, RARE_ITEMS = 0.04, 50
#: Postings that a search looks at in one go: more texts than that are halved.
MOST_POSTINGS = 4_000_000
ITEM_BLOCK = 64
K1, B = 1.2, 0.75
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)


class LeakIndex:
    """BM25 impacts of items (passage and question), block maxima, and what verification needs.

    All of it is arrays as long as the items' words: postings, maxima of the blocks in which a term occurs, and hashes of the
    runs of words, whose words are looked up in the items themselves.
    """

    def __init__(self, items: pd.DataFrame, run: int = 12, changed: float = 1 / 6):
        self.run, self.changed = run, changed
        answers = items["answer"] if "answer" in items else repeat(None)
        ids, self.answers, vocabulary = [], [], {}
        token, size, at = array("i"), array("i"), [0]  # words' numbers; of words between spaces how many they hold; where passages and questions begin there
        for item, passage, question, answer in zip(items["item_id"], items["passage"], items["question"], answers):
            two = [spaced_words(x) if isinstance(x, str) else [] for x in (passage, question)]
            if not any(two):
                continue
            ids.append(item)
            self.answers.append(" ".join(words(answer)) if isinstance(answer, str) else "")
            for part in two:
                for g in part:
                    size.append(len(g))
                    token.extend(vocabulary.setdefault(w, len(vocabulary) + 1) for w in g)
                at.append(len(size))
        self.ids, self.vocabulary = np.array(ids, np.int64), vocabulary
        n, v = len(ids), len(vocabulary) + 1
        self.token, self.size, self.part = np.array(token, np.int32), np.array(size, np.int32), np.array(at, np.int64)
        self.begin = np.r_[0, np.cumsum(self.size, dtype=np.int64)]  # where words between spaces begin among the tokens
        owner = np.repeat(np.arange(2 * n), np.diff(self.part))  # part of each word between spaces
        part = np.repeat(owner, self.size)  # and of each token
        own = part // 2
        # postings, by term
        pair, tf = np.unique(self.token.astype(np.int64) * max(n, 1) + own, return_counts=True)
        term, self.item = pair // max(n, 1), (pair % max(n, 1)).astype(np.int32)
        df = np.bincount(term, minlength=v)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        length = np.bincount(own, minlength=n)
        mean = length.mean() if n else 1
        self.impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.item] / mean))
        self.at = np.searchsorted(term, np.arange(v + 1))
        self._keys = pair
        # maxima by term and block of items, where there are any
        self.blocks = max(1, -(-n // ITEM_BLOCK))
        block = term * self.blocks + self.item // ITEM_BLOCK
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]][: len(block)])
        self.block = (block[first] % self.blocks).astype(np.int32)
        self.block_max = np.maximum.reduceat(self.impact, first) if len(first) else np.empty(0)
        self.block_at = np.searchsorted(block[first] // self.blocks, np.arange(v + 1))
        self.term_max = np.zeros(v)
        np.maximum.at(self.term_max, term, self.impact)

        # The least score that a true case can have, by item: of its runs of words, and of its passage without its best words.
        rng = np.random.default_rng(7)
        self.code = rng.integers(0, 2**63, v, np.int64).astype(np.uint64) | np.uint64(1)
        worth = self._impact(self.token.astype(np.int64), own)
        again = _again(self.token, part)
        least_run, least_passage, self.fewest = np.full(n, np.inf), np.full(n, np.inf), np.full(n, np.iinfo(np.int64).max)
        self.essential = (df <= max(3, min(RARE * n, RARE_ITEMS))) & (df > 0)
        longest_run, longest_passage = 1, 1
        self.grams = {}
        heads = np.flatnonzero(np.arange(len(owner)) + run <= np.r_[self.part[1:], 0][owner]) if n else np.empty(0, np.int64)
        many = self.begin[heads + run] - self.begin[heads]
        for m in np.unique(many).tolist():
            start = self.begin[heads[many == m]]
            hashes = np.empty(len(start), np.uint64)
            power = np.array([pow(_BASE, j, 2**64) for j in range(m)], np.uint64)
            for a in range(0, len(start), 100_000):
                s = start[a : a + 100_000, None]
                w = s + np.arange(m)
                t = self.token[w]
                np.minimum.at(least_run, own[s[:, 0]], np.where(again[w] < s, worth[w], 0).sum(axis=1))
                self.essential[t[np.arange(len(t)), df[t].argmin(axis=1)]] = True
                with np.errstate(over="ignore"):
                    hashes[a : a + 100_000] = (self.code[t] * power).sum(axis=1, dtype=np.uint64)
            o = np.argsort(hashes, kind="stable")
            self.grams[m] = hashes[o], own[start[o]].astype(np.int32), start[o]
            longest_run = max(longest_run, m)
        for i in range(n):
            flat, allowed, sizes = self.passage(i)
            if not allowed:
                continue
            terms, where = np.unique(flat, return_index=True)
            value = worth[self.begin[self.part[2 * i]] + where]
            o = np.argsort(value, kind="stable")
            lost = int(np.sort(sizes)[-allowed:].sum())  # runs of letters in the words that may change
            least_passage[i] = value[o[: max(0, len(o) - lost)]].sum()
            self.fewest[i] = max(1, len(terms) - lost)
            self.essential[terms[o[max(0, len(o) - lost - 1) :]]] = True  # at least one of them is left
            longest_passage = max(longest_passage, len(flat) + lost)
        #: Words of half a query, so that two neighbouring halves hold any true case; and the thresholds of items and their blocks.
        self.levels = []
        for stretch, least in ((longest_run, 0.999 * least_run), (longest_passage, 0.999 * least_passage)):
            self.levels.append((stretch, least, np.minimum.reduceat(least, np.arange(0, n, ITEM_BLOCK)) if n else least))

    def passage(self, i: int) -> tuple[np.ndarray, int, np.ndarray]:
        """Tokens of an item's passage, how many of its words may change, and of how many tokens each word consists."""
        a, b = self.part[2 * i], self.part[2 * i + 1]
        return self.token[self.begin[a] : self.begin[b]].astype(np.int64), int((b - a) * self.changed), self.size[a:b].astype(np.int64)

    def bytes(self) -> int:
        """Bytes of the arrays, and about those of the words."""
        arrays = [x for x in vars(self).values() if isinstance(x, np.ndarray)] + [x for g in self.grams.values() for x in g]
        return sum(x.nbytes for x in arrays) + sum(len(w) + 60 for w in self.vocabulary) + sum(map(len, self.answers))

    def search(self, texts: list[str | None]) -> list[tuple[int, int, str]]:
        """(text, item, 'run' or 'passage') of all cases."""
        if not len(self.ids):
            return []
        get = self.vocabulary.get
        coded, sizes = [], []
        for t in texts:
            w = words(t) if t else []
            coded.append(np.fromiter(map(get, w, repeat(0)), np.int64, len(w)))
            sizes.append(len(w))
        ids, size = np.concatenate(coded) if coded else np.empty(0, np.int64), np.array(sizes, np.int64)
        if not len(ids):
            return []
        if len(texts) > 1 and np.where(self.essential, np.diff(self.at), 0)[ids].sum() > MOST_POSTINGS:
            half = len(texts) // 2
            return self.search(texts[:half]) + [(d + half, i, how) for d, i, how in self.search(texts[half:])]
        begin = np.r_[0, np.cumsum(size)]
        own, item, *_ = self._retrieve(ids, size, begin, *self.levels[0])
        found = self._runs(ids, begin, np.unique(own * len(self.ids) + item))
        return found + self._changed(texts, ids, begin, {(d, i) for d, i, _ in found}, *self._retrieve(ids, size, begin, *self.levels[1]))

    def answered(self, text: str, items: list[int]) -> list[bool | None]:
        """Whether the words of each item's answer occur in the text, one after the other; None for items without answer."""
        own = f" {' '.join(words(text))} "
        return [f" {self.answers[i]} " in own if self.answers[i] else None for i in items]

    def _retrieve(self, ids, size, begin, stretch, theta, least_of):
        """(text, item, position, shared terms) of the queries, each a stretch and the next, that reach an item's threshold."""
        v, n = len(self.code), len(self.ids)
        doc = np.repeat(np.arange(len(size)), size)
        count = -(-size // stretch)
        first = np.r_[0, np.cumsum(count)]
        total = int(first[-1])
        owner = np.repeat(np.arange(len(size)), count)
        follows = np.r_[owner[1:] == owner[:-1], False][:total]  # whether the next stretch is of the same text
        block = first[doc] + (np.arange(len(ids)) - begin[doc]) // stretch
        known = ids > 0
        key = np.unique(block[known] * v + ids[known])
        b, t = key // v, key % v
        ess = self.essential[t]

        def paired(x):
            y = x.copy()
            y[:-1][follows[:-1]] += x[1:][follows[:-1]]
            return y

        # Block maxima: queries that can't reach the least threshold of a block of items skip it.
        rest = paired(np.bincount(b[~ess], self.term_max[t[~ess]], total))
        blocks = self.blocks
        at, row = _spans(self.block_at[t[ess]], self.block_at[t[ess] + 1])
        key, upper = _sums(b[ess][row] * blocks + self.block[at], self.block_max[at], total * blocks)
        q = np.unique(np.r_[key, key[np.r_[False, follows][key // blocks]] - blocks])  # a stretch counts for the one before too
        upper = _at(key, upper, q) + np.where(follows[q // blocks], _at(key, upper, q + blocks), 0)
        alive = q[upper + rest[q // blocks] >= least_of[q % blocks]]
        used = np.unique(np.r_[alive, alive[follows[alive // blocks]] + blocks])
        some = np.zeros(total, bool)
        some[used // blocks] = True
        live = ess & some[b]
        b1, t1 = b[live], t[live]
        at, row = _spans(self.at[t1], self.at[t1 + 1])
        b2, item, imp = b1[row], self.item[at], self.impact[at]
        ok = _at(used, np.ones(len(used)), b2 * blocks + item // ITEM_BLOCK) > 0
        pair, score = _sums(b2[ok] * n + item[ok], imp[ok], total * n)
        none = np.empty(0, np.int64)
        if not len(pair):
            return none, none, none, none
        q = np.unique(np.r_[pair, pair[np.r_[False, follows][pair // n]] - n])
        s = _at(pair, score, q) + np.where(follows[q // n], _at(pair, score, q + n), 0)
        keep = s + rest[q // n] >= theta[q % n]
        q, s = q[keep], s[keep]
        # The exact score of what is left, frequent terms included.
        lo, hi = np.searchsorted(b, q // n), np.searchsorted(b, q // n + 1 + follows[q // n].astype(np.int64))
        shared, out = np.zeros(len(q), np.int64), np.zeros(len(q), bool)
        for a in range(0, len(q), 100_000):
            z = slice(a, a + 100_000)
            at, row = _spans(lo[z], hi[z])
            add = self._impact(t[at], (q[z] % n)[row])
            out[z] = np.bincount(row, add, hi[z].size) >= theta[q[z] % n]
            shared[z] = np.bincount(row, add > 0, hi[z].size)
        q = q[out]
        own = owner[q // n]
        return own, q % n, begin[own] + (q // n - first[own]) * stretch, shared[out]

    def _impact(self, t, i):
        return _at(self._keys, self.impact, t * len(self.ids) + i)

    def _runs(self, ids, begin, candidates) -> list[tuple[int, int, str]]:
        """Candidates with a run of words in common: rolling hashes over the texts, equal hashes compared word by word."""
        n = len(self.ids)
        own = np.unique(candidates // n)
        if not len(own):
            return []
        at, row = _spans(begin[own], begin[own + 1])
        text, w = own[row], ids[at]
        power, inverse = _powers(len(w))
        found: set[int] = set()
        with np.errstate(over="ignore"):
            run = np.r_[np.uint64(0), np.cumsum(self.code[w] * power, dtype=np.uint64)]
            for m, (h, who, gram) in self.grams.items():
                if len(w) < m:
                    continue
                g = (run[m:] - run[:-m]) * inverse[: len(w) - m + 1]
                lo = np.searchsorted(h, g)
                hit = np.flatnonzero(h[np.minimum(lo, len(h) - 1)] == g)
                for p in hit[text[hit] == text[hit + m - 1]].tolist():
                    j = int(lo[p])
                    while j < len(h) and h[j] == g[p]:
                        if np.array_equal(self.token[gram[j] : gram[j] + m], w[p : p + m]):
                            found.add(int(text[p]) * n + int(who[j]))
                        j += 1
        return [(k // n, k % n, "run") for k in found & set(candidates.tolist())]

    def _changed(self, texts, ids, begin, found, own, item, position, shared) -> list[tuple[int, int, str]]:
        """Candidates that hold a whole passage with some words changed: an alignment around what was retrieved."""
        many = shared >= self.fewest[item]
        out: set[tuple[int, int]] = set()
        width = 2 * self.levels[1][0]
        bounds: dict[int, np.ndarray] = {}  # of the texts' words between spaces
        for d, i, a in zip(own[many].tolist(), item[many].tolist(), position[many].tolist()):
            if (d, i) in found or (d, i) in out:
                continue
            passage, allowed, sizes = self.passage(i)
            if d not in bounds:
                bounds[d] = np.cumsum([int(begin[d]), *map(len, spaced_words(texts[d]))])
            z = min(int(begin[d + 1]), a + width)
            lo, hi = np.searchsorted(bounds[d], [a, z + 1])
            if aligned(passage, ids[a:z], sizes, bounds[d][lo:hi] - a) <= allowed:
                out.add((d, i))
        return [(d, i, "passage") for d, i in out]


def _spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions of all spans [lo, hi), and for each the span's number."""
    many = hi - lo
    row = np.repeat(np.arange(len(many)), many)
    return np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + lo[row], row


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of the sorted keys that are wanted, 0 for those that aren't there."""
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def _sums(key: np.ndarray, value: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, all below ``room``, and the (positive) sums of their values."""
    if room <= 1 << 22:
        out = np.bincount(key, value, room)
        at = np.flatnonzero(out)
        return at, out[at]
    at, back = np.unique(key, return_inverse=True)
    return at, np.bincount(back, value, len(at))


def _again(token: np.ndarray, part: np.ndarray) -> np.ndarray:
    """For each token where it occurred before in its part, or -1."""
    out = np.full(len(token), -1)
    o = np.lexsort((np.arange(len(token)), token, part))
    same = (token[o][1:] == token[o][:-1]) & (part[o][1:] == part[o][:-1])
    out[o[1:][same]] = o[:-1][same]
    return out


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, b in enumerate((_BASE, _BASE_INVERSE)):
            p = np.ones(2 * n, np.uint64)
            p[1:] = np.uint64(b)
            with np.errstate(over="ignore"):
                _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def aligned(passage: np.ndarray, part: np.ndarray, sizes: np.ndarray | None = None, ends: np.ndarray | None = None) -> int:
    """The fewest words to change, leave out or add so that ``passage`` occurs somewhere in ``part``.

    Both are runs of letters. ``sizes``: of how many runs each word of the passage consists; ``ends``: where in ``part`` its
    words between spaces end, from the first such place on. A word of several runs counts once, as does a run changed alone.
    """
    d = np.zeros(len(part) + 1, np.int64)
    step = np.arange(len(part) + 1)
    lo, hi = (ends[:-1], ends[1:]) if ends is not None else (step[:0], step[:0])
    multi = [(int(x), int(y)) for x, y in zip(lo, hi) if y - x > 1]
    at = 0
    for size in np.ones(len(passage), np.int64) if sizes is None else sizes:
        before = d
        for w in passage[at : at + size]:
            e = np.minimum(d[1:] + 1, d[:-1] + (part != w))
            e = np.r_[d[0] + 1, e]
            d = np.minimum.accumulate(e - step) + step  # words added in between
        at += size
        if size > 1 or multi:
            e = np.minimum(d, before + 1)  # the whole word left out
            e[hi] = np.minimum(e[hi], before[lo] + 1)  # or one other in its place
            d = np.minimum.accumulate(e - step) + step
            for x, y in multi:  # a word of several runs added
                if d[x] + 1 < d[y]:
                    d[y] = d[x] + 1
                    d[y:] = np.minimum.accumulate(d[y:] - step[y:]) + step[y:]
    return int(d.min())


def leaked_items(documents: DataFrame, items: DataFrame, run: int = 12, changed: float = 1 / 6, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document that holds a test item in whole or part: ``item_id``, ``doc_id``, ``how``, ``answered``.

    ``how`` is 'run' if at least ``run`` consecutive words (between spaces) of the item's passage or question occur, else
    'passage' if the whole passage occurs with up to the share ``changed`` of its words changed. ``answered`` says
    whether the item's answer occurs too, null if it has none; it decides nothing. Case, accents, punctuation, spacing, entities and wiki or HTML markup don't matter. Documents without text and items without words
    match nothing; each row of ``documents`` is searched whole, copies too; other columns are ignored.
    """
    length = F.coalesce(F.length("passage"), F.lit(0)) + F.coalesce(F.length("question"), F.lit(0)) + 8
    passes = max(1, -(-int(items.agg(F.coalesce(F.sum(length), F.lit(0))).first()[0]) // MOST_CHARACTERS))
    out = None
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k) if passes > 1 else items
        own = LeakIndex(part.select(F.col("item_id").cast("long"), "passage", "question", *[c for c in ("answer",) if c in items.columns]).toPandas().sort_values("item_id"), run, changed)
        held = documents.sparkSession.sparkContext.broadcast(own)

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for b in batches:
                texts = b.column("text")
                for a in range(0, b.num_rows, 500):
                    hits = index.search(texts.slice(a, 500).to_pylist())
                    if hits:
                        d, i, how = zip(*hits)
                        by_text = {x: [j for y, j, _ in hits if y == x] for x in set(d)}
                        told = {(x, j): t for x, own in by_text.items() for j, t in zip(own, index.answered(texts[a + x].as_py(), own))}
                        yield pa.record_batch([pa.array(index.ids[list(i)]), b.column("doc").take(pa.array([a + x for x in d])), pa.array(how), pa.array([told[x, j] for x, j in zip(d, i)], pa.bool_())], names=["item_id", "doc", "how", "answered"])

        rows = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where(F.col("text").isNotNull())
        found = rows.mapInArrow(search, f"item_id long, doc {rows.schema['doc'].dataType.simpleString()}, how string, answered boolean")
        out = found if out is None else out.unionByName(found)
    return out.select("item_id", F.col("doc").alias(doc_id), "how", "answered")
