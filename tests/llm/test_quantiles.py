import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import quantiles as q

WANTED = [0.01, 0.25, 0.5, 0.75, 0.99]


def rank_error(values, guess, share):
    v = np.sort(values)
    rank = np.ceil(share * len(v))
    lo, hi = np.searchsorted(v, guess - abs(guess) * 2**-10 - 1e-9, "left"), np.searchsorted(v, guess + abs(guess) * 2**-10 + 1e-9, "right")
    return max(0, lo + 1 - rank, rank - hi) / len(v)


def test_codes():
    x = np.array([0, 1, -1, 1023, 1024, 4095, 123_456_789, -123_456_789, 2**55, 0.1, 0.2, 0.3, 0.4, 0.9, 1.5, -0.5, -0.0, 5e-324, 2.0**62, 2.0**63 - 1024, -(2.0**63), 1e308, -1e308, np.inf, -np.inf])
    x = np.sort(x)
    codes = q.encode(x)
    assert (np.diff(codes) >= 0).all() and codes.min() >= 0 and codes.max() < 1 << q.Shape().code_bits
    back = q.decode(codes)
    normal = np.isfinite(x) & (np.abs(x) > 1e-300)
    assert (np.abs(back - x)[normal] <= np.abs(x)[normal] * 2.0**-11).all() and back[0] == -np.inf and back[-1] == np.inf
    whole = np.arange(-4095, 4096)
    assert (q.decode(q.encode(whole)) == whole).all()


def test_fractions_and_the_whole_range(spark):
    def ask(values, kind, few):
        df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
        return q.percentiles(q.sketch(df, [], "v", few=few), [], [0.01, 0.5, 0.95], few=few).first()

    for few in (None, 0):
        r = ask([0.1, 0.2, 0.3, 0.4, 0.9, 1.5, -0.5, None, float("nan")], "double", few)
        assert r.n == 7 and r.percentiles == pytest.approx([-0.5, 0.3, 1.5], rel=2**-10)
        top = [2**62 + i * 2**56 for i in range(64)] + [2**63 - 1, -(2**63)]
        r = ask(top, "long", few)
        assert r.n == 66 and r.percentiles == pytest.approx([-(2.0**63), float(sorted(top)[32]), float(sorted(top)[62])], rel=2**-10)


@pytest.fixture(scope="module")
def flows(spark):
    rng = np.random.default_rng(1)
    rows = [(f"g{g}", d, int(v)) for g in range(4) for d in range(5) for v in rng.lognormal(3 + g * 2, 2 + g / 3, 700)]
    rows += [("skew", 0, 7)] * 3000 + [("g0", 0, None), (None, 0, 5)]
    return spark.createDataFrame(rows, "g string, day int, v long").cache()


def values_of(flows, where):
    return np.array([r.v for r in flows.where(where).where("v is not null").select("v").collect()])


def test_within_bound(spark, flows):
    odd = flows.withColumns({c: F.lit(1) for c in ("cell", "value", "n", "_at", "_value", "_dense", "_x", "_w", "_c", "_n", "_g0")})
    for few in (None, 0):
        for shape in (q.Shape(), q.Shape(width=1024, depth=5)):
            got = {r.g: r for r in q.percentiles(q.sketch(odd, ["g"], "v", shape=shape, few=few), ["g"], WANTED, shape, few).collect()}
            assert got["skew"].percentiles == [7.0] * 5 and got[None].n == 1
            for g in range(4):
                own, r = values_of(flows, f"g = 'g{g}'"), got[f"g{g}"]
                assert r.n == len(own)
                worst = max(rank_error(own, p, s) for p, s in zip(r.percentiles, WANTED))
                assert worst <= r.rank_error + 1 / len(own) and worst <= (0.0 if few is None else 0.02 if shape.width == 256 else 0.008)


def test_sketches_are_smaller_than_histograms(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(v),) for v in rng.lognormal(9, 5, 60_000)], "v double").repartition(2)
    s = q.sketch(df, [], "v")
    codes = len(np.unique(q.encode(values_of(df, "true"))))
    entries = s.agg(F.sum(F.size("_at"))).first()[0]
    assert s.where("not _dense").count() == 0 and entries <= 2 * q.Shape().cells < 2 * codes
    r = q.percentiles(s, [], [0.5]).first()
    assert rank_error(values_of(df, "true"), r.percentiles[0], 0.5) <= min(r.rank_error, 0.015)


def table_of(sketches, groups, few):
    return sorted((str([r[g] for g in groups]), r._dense, r._at, r._value) for r in q.merge(sketches, groups, few=few).collect())


@pytest.mark.parametrize("few", [None, 0, 100])
def test_merging_is_adding(flows, few):
    whole = q.sketch(flows, ["g"], "v", few=few)
    days = q.sketch(flows, ["g", "day"], "v", few=few)
    assert table_of(whole, ["g"], few) == table_of(q.merge(days, ["g", "day"], few=few), ["g"], few) == table_of(days, ["g"], few)
    everything = q.percentiles(q.merge(whole, [], few=few), [], [0.5], few=few).first()
    assert rank_error(values_of(flows, "true"), everything.percentiles[0], 0.5) <= 0.015


@pytest.mark.parametrize("few", [None, 0])
def test_deletion(flows, few):
    added = q.sketch(flows, ["g"], "v", few=few)
    gone = q.sketch(flows.where("day >= 2"), ["g"], "v", F.lit(-1), few=few)
    assert table_of(added.unionByName(gone), ["g"], few) == table_of(q.sketch(flows.where("day < 2"), ["g"], "v", few=few), ["g"], few)
    nothing = q.sketch(flows, ["g"], "v", F.lit(-1), few=few)
    assert q.percentiles(added.unionByName(nothing), ["g"], WANTED, few=few).count() == 0


def test_bounded_tables(flows, monkeypatch):
    monkeypatch.setattr(q, "MOST_HELD", 100)
    monkeypatch.setattr(q, "ROW", 7)
    got = {r.g: r.n for r in q.percentiles(q.sketch(flows, ["g"], "v"), ["g"], WANTED).collect()}
    assert got["g1"] == 3500 and got["skew"] == 3000


def test_empty(flows):
    assert q.percentiles(q.sketch(flows.limit(0), ["g"], "v"), ["g"], WANTED).count() == 0
    assert q.sketch(flows.where("v is null"), ["g"], "v").count() == 0
