import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import packing


def plain_best_fit(sizes, capacity):
    rooms, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fit = [b for b in range(len(rooms)) if rooms[b] >= sizes[i]]
        b = min(fit, key=lambda b: rooms[b]) if fit else len(rooms)
        if not fit:
            rooms.append(capacity)
        rooms[b] -= sizes[i]
        out[i] = b
    return sorted(rooms)


def test_best_fit():
    rng = np.random.default_rng(1)
    for _ in range(40):
        sizes = rng.integers(1, 101, int(rng.integers(1, 80)))
        bins = packing.best_fit(sizes, 100)
        total = np.bincount(bins, sizes)
        assert total.max() <= 100 and sorted((100 - total).astype(int).tolist()) == plain_best_fit(sizes.tolist(), 100)


@pytest.mark.parametrize("parts,most", [(1, 500_000), (7, 500_000), (5, 40)])
def test_pack(spark, monkeypatch, parts, most):
    monkeypatch.setattr(packing, "MOST_ITEMS", most)
    rng = np.random.default_rng(parts)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(0, 900, 600))] + [(600, 5000), (601, 1024), (602, None), (603, 1), (603, 1)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long").repartition(parts).withColumns({c: F.lit(0) for c in ("size", "members", "full", "bin", "piece", "doc", "n")})
    out = packing.pack(df, 1024).collect()
    fill, per = defaultdict(int), defaultdict(list)
    for r in out:
        fill[r.bin] += r.n
        per[r.doc_id].append((r.start, r.n))
    assert max(fill.values()) <= 1024
    want = {i: n for i, n in rows if n}
    assert set(per) == set(want)
    for i, own in per.items():
        if i == 603:
            assert sorted(own) == [(0, 1), (0, 1)]
            continue
        own.sort()
        assert sum(n for _, n in own) == want[i] and (len(own) == 1) == (want[i] <= 1024)
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
    lower = -(-sum(n for _, n in rows if n) // 1024)
    # Bins are never taken apart again, so groups of 40 to 90 large items lose more than whole partitions do.
    assert len(fill) <= lower * (1.02 if parts == 1 else 1.25 if most == 40 else 1.08) + 1


def test_groups_are_bounded():
    """However many bins are left, no group is packed that is larger than what a task holds."""
    left, groups, seen = 20_000_000, None, []
    while groups != 1 and len(seen) < 20:
        groups = packing.next_groups(left, groups)
        seen.append((left, groups))
        left = int(left * 0.85)
    assert all(n <= g * packing.MOST_ITEMS for n, g in seen) and seen[0][1] == 40


def test_pack_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long"), 100).count() == 0


@pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no vocabulary file here")
def test_count_tokens(spark):
    texts = [(1, "Hello world, it's 2011!"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "日本語 текст"), (6, "a" * 200_000)]
    got = {r.doc_id: r.n_tokens for r in packing.count_tokens(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    encode = packing._encoder(packing._vocabulary(packing.TOKENIZER), packing.PATTERN)
    assert got[2] == got[3] == 0 and got[4] > 1 and got[1] == 7  # Hello| world|,| it|'s| 2011|!
    for i, t in texts[:5]:
        if t:
            assert encode.decode(encode.encode_ordinary(t)) == t
