"""The operators on pings: against plain versions on small random tables, and on the cases that tables hold at their edges."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions.geo import haversine_np
from pathloom.operators import faults, keyed, near, ordered, sessions, trips

SCHEMA = "ping_id long, uid long, lat double, lng double, datetime timestamp_ntz"
T0 = dt.datetime(2011, 2, 1)


def pings(spark, rows):
    plain = lambda v: None if v is None else float(v)
    return spark.createDataFrame([(i, u, plain(y), plain(x), t) for i, (u, y, x, t) in enumerate(rows)], SCHEMA)


def walk(rng, uid, n, cadence=30, start=T0, y=45.0, x=9.0, speed=0.01):
    """Stays and drives of one device: (uid, lat, lng, datetime)."""
    out, t = [], start
    while len(out) < n:
        for _ in range(int(rng.integers(60, 90))):
            out.append((uid, y + rng.normal(0, 2e-5), (x + rng.normal(0, 2e-5) + 180) % 360 - 180, t))
            t += dt.timedelta(seconds=int(rng.integers(cadence - 5, cadence + 6)))
        a = rng.random() * 6.28
        for _ in range(int(rng.integers(30, 60))):
            y, x = y + speed / 4 * np.cos(a), x + speed / 4 * np.sin(a)
            out.append((uid, y, (x + 180) % 360 - 180, t))
            t += dt.timedelta(seconds=int(rng.integers(cadence - 5, cadence + 6)))
    return out[:n]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = [r for u, n in ((1, 1500), (2, 400), (3, 90)) for r in walk(rng, u, n, start=T0 + dt.timedelta(hours=u))]
    rows += [(4, 45.0, 9.0, T0), (4, None, 9.0, T0 + dt.timedelta(seconds=5)), (None, 45.0, 9.0, T0), (5, 45.0, 9.0, None), (6, None, None, T0)]
    rows += rows[:50]  # copies under new ids
    order = rng.permutation(len(rows))
    return pings(spark, [rows[i] for i in order]).cache()


def hostile(df):
    """The same table with extra columns of clashing names."""
    return df.withColumns({c: F.lit(1) for c in ("k", "us", "chunk", "n", "y", "x", "id", "edge", "start_us", "speed", "reps", "leaf", "salt", "first", "last")})


def as_pandas(df):
    return df.where("uid is not null and datetime is not null").toPandas()


def test_sessions(spark, table, monkeypatch):
    def plain(copies):
        p = as_pandas(table)
        p = p.drop_duplicates(["uid", "datetime", "lat", "lng"]) if copies else p
        out = set()
        for uid, g in p.sort_values(["uid", "datetime"]).groupby("uid"):
            t = g["datetime"].astype("datetime64[us]").astype("int64").to_numpy()
            cut = np.flatnonzero(np.r_[True, np.diff(t) > 45_000_000])
            for a, b in zip(cut, [*cut[1:], len(t)]):
                out.add((uid, int(t[a]), int(t[b - 1]), b - a))
        return out

    for copies in (["lat", "lng"], None):
        for least in (100_000, 50):
            monkeypatch.setattr(ordered, "CHUNK_ROWS", least)
            got = {(r.uid, r.start_us, r.end_us, r.n) for r in sessions.sessions(hostile(table), gap_s=45, copies=copies).collect()}
            assert got == plain(copies)
    assert sessions.sessions(table.limit(0)).count() == 0
    # exactly the gap goes on, more doesn't
    two = pings(spark, [(1, 1.0, 1.0, T0), (1, 1.0, 1.0, T0 + dt.timedelta(seconds=1800)), (1, 1.0, 1.0, T0 + dt.timedelta(seconds=3601))])
    assert sorted(r.n for r in sessions.sessions(two).collect()) == [1, 2]


def test_keyed(spark, table, monkeypatch):
    assert {r.uid for r in keyed.heavy_keys(hostile(table), share=0.15).collect()} == {1, 2}
    assert keyed.heavy_keys(table.limit(0)).count() == 0
    s = {r.uid: r for r in keyed.key_summary(hostile(table)).collect()}
    assert s[1].n_rows == table.where("uid = 1").count() and s[6].lat_min is None and s[None].n_rows >= 1
    one = as_pandas(table.where("uid = 2")).drop_duplicates(["datetime", "lat", "lng"]).sort_values("datetime")
    d = haversine_np(one.lat.to_numpy()[:-1], one.lng.to_numpy()[:-1], one.lat.to_numpy()[1:], one.lng.to_numpy()[1:])
    for least in (100_000, 40):
        monkeypatch.setattr(ordered, "CHUNK_ROWS", least)
        m = {r.uid: r for r in keyed.path_measures(hostile(table)).collect()}
        assert m[2].path_km == pytest.approx(d.sum()) and m[2].longest_jump_km == pytest.approx(d.max()) and m[2].n == len(one)
        assert m[4].n == 1 and m[4].path_km == 0 and 5 not in m and None not in m


@pytest.fixture(scope="module")
def lopsided(spark):
    """A key with half of all rows, one with a single time, one that never moves (but for its scatter), one that stands on one spot, and small ones."""
    id_ = F.col("id")
    uid = F.when(id_ % 2 == 0, 1).when(id_ % 8 == 1, 2).when(id_ % 8 == 3, 3).when(id_ % 8 == 5, 4).otherwise(10 + id_ % 400).cast("long")
    us = F.when(uid == 2, F.lit(1_300_000_000_000_000)).otherwise(1_300_000_000_000_000 + id_ * 10_000_000 + F.pmod(F.xxhash64("id"), F.lit(3_000_000)))
    scatter = lambda seed: (F.rand(seed) - 0.5) * 2e-4
    lat = F.when(uid == 1, 45 + F.abs(F.pmod(id_, F.lit(4000)) - 2000) * 1e-3 + scatter(1)).when(uid == 2, F.rand(2) * 50).when(uid == 4, 45.0).otherwise(45 + scatter(3))
    df = spark.range(0, 64_000, 1, 4).select(id_.alias("ping_id"), uid.alias("uid"), lat.alias("lat"), F.when(uid == 4, 9.0).otherwise(9 + scatter(4)).alias("lng"), F.timestamp_micros(us).cast("timestamp_ntz").alias("datetime"))
    return df.cache()


@pytest.mark.parametrize("sent", [1_000_000, 5])
def test_groups_stay_small(spark, lopsided, monkeypatch, sent):
    """No group has more than twice the rows of a chunk, whatever its key does, and results don't change."""
    whole = [f(lopsided).collect() for f in (sessions.sessions, keyed.path_measures, faults.faults)]
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 2000)
    monkeypatch.setattr(ordered, "MOST_CUTS", sent)
    monkeypatch.setattr(ordered, "FAN_OUT", 4)
    rows = lopsided.select(F.col("uid").alias("k"), ordered.micros("datetime").alias("us"), F.col("lat").alias("y"), F.col("lng").alias("x"))
    cuts = ordered.find_cuts(rows, "k", ["us", "y", "x"])
    assert (cuts.fine is None) == (sent > 5)
    parts = cuts.spread(rows).groupBy("k", "chunk").agg(F.count("*").alias("n"), F.min(F.struct("us", "y", "x")).alias("a"), F.max(F.struct("us", "y", "x")).alias("b"))
    sizes = {}
    for r in parts.orderBy("k", "chunk").collect():
        sizes.setdefault(r.k, []).append(r)
    assert max(r.n for own in sizes.values() for r in own) <= 4000 and sum(r.n for own in sizes.values() for r in own) == 64_000
    assert all(len(sizes[k]) >= 3 for k in (1, 2, 3, 4)) and all(len(own) == 1 for k, own in sizes.items() if k >= 10)
    assert all(r.b < s.a for own in sizes.values() for r, s in zip(own, own[1:]))  # chunks are in order
    # cuts of faults move to calm pings; there is one in every chunk, of standing sources too
    lim = faults.Limits()
    calm = faults.moved_cuts(rows, cuts, lambda *a: faults.calm(*a, lim))
    moved = calm.spread(rows).groupBy("k", "chunk").count().collect()
    assert max(r["count"] for r in moved if r.k != 2) <= 4000
    for f, want in zip((sessions.sessions, keyed.path_measures, faults.faults), whole):
        got = f(lopsided).collect()
        if f is keyed.path_measures:
            assert {(r.uid, r.n, round(r.path_km, 4), r.longest_wait_s) for r in got} == {(r.uid, r.n, round(r.path_km, 4), r.longest_wait_s) for r in want}
        else:
            assert sorted(map(str, got)) == sorted(map(str, want))


def test_standing_sources_are_cut(spark, monkeypatch):
    """A hot source that never leaves, with spikes and silences, one that leaves in the end, and one on a single spot: as uncut."""
    rng = np.random.default_rng(8)
    rows, t = [], T0
    for i in range(6000):
        t += dt.timedelta(seconds=20) if i not in (1500, 4000) else dt.timedelta(hours=30)
        far = 0.5 if i % 211 == 7 else 0.0
        rows.append((1, 45 + rng.normal(0, 5e-5) + far, (179.99995 + rng.normal(0, 5e-5) + 180) % 360 - 180, t))
        rows.append((2, 45 + rng.normal(0, 5e-5), 9 + max(0, i - 5000) * 0.001, t))
        rows.append((3, 10.0, 10.0, t))
    df = pings(spark, rows).cache()
    told = lambda r: (r.kind, r.uid, r.start_us, r.end_us, r.n, round(r.distance_km, 6), round(r.lat, 9), round(r.lng, 9))
    want = sorted(told(r) for r in trips.stops_and_trips(df).collect())
    assert sum(w[1] == 1 for w in want) == 3 and sum(w[1] == 3 for w in want) == 3 and sum(w[1] == 2 for w in want) >= 3
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 1000)
    seen = []
    real = trips._standing
    monkeypatch.setattr(trips, "_standing", lambda *a: (lambda r: (seen.append(sorted(r[1])), r)[1])(real(*a)))
    assert sorted(told(r) for r in trips.stops_and_trips(df).collect()) == want and seen == [[1, 3]]


def place_rows():
    ring = [(8.999, 44.999), (9.001, 44.999), (9.001, 45.001), (8.999, 45.001), (8.999, 44.999)]
    hole = [(8.9995, 44.9995), (9.0005, 44.9995), (9.0005, 45.0005), (8.9995, 45.0005), (8.9995, 44.9995)]
    p = lambda r: [{"x": x, "y": y} for x, y in r]
    return [
        (1, "site", 45.0, 9.0, 200.0, None), (2, "zone", 45.0, 9.0, None, [p(ring), p(hole)]), (3, "site", 0.0, 179.9999, 100.0, None), (4, "site", 89.9999, 0.0, 100.0, None),
        (5, "site", None, 9.0, 100.0, None), (6, "zone", 1.0, 1.0, None, []), (7, "site", 45.0, 9.0, None, None), (8, "zone", 45.0, 9.0, None, [p(ring)]),
    ]


PLACES = T.StructType([T.StructField("place_id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType()), T.StructField("radius_m", T.DoubleType()), T.StructField("geometry", T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))))])


def test_near_both_forms(spark):
    rng = np.random.default_rng(2)
    rows = [(1, 45 + rng.normal(0, 0.002), 9 + rng.normal(0, 0.002), T0) for _ in range(800)]
    rows += [(1, 0.0, -179.9999, T0), (1, 89.9999, 180.0, T0), (1, 45.0, 9.0, T0), (1, None, 9.0, T0), (1, 999.0, 9.0, T0)] * 2
    df, places = hostile(pings(spark, rows)), spark.createDataFrame(place_rows(), PLACES)
    want = set()
    for i, (_, y, x, _) in enumerate(rows):
        if y is None or abs(y) > 90:
            continue
        for pid, sy, sx, r in ((1, 45.0, 9.0, 200), (3, 0.0, 179.9999, 100), (4, 89.9999, 0.0, 100)):
            if haversine_np(y, x, sy, sx) * 1000 <= r:
                want.add((pid, i))
        outer, inner = abs(y - 45) < 0.001 and abs(x - 9) < 0.001, abs(y - 45) < 0.0005 and abs(x - 9) < 0.0005
        want |= {(8, i)} if outer else set()
        want |= {(2, i)} if outer and not inner else set()
    for most in (near.MOST_BROADCAST, 0):
        got = near.near_places(df, places, most_broadcast=most)
        assert {(r.place_id, r.ping_id) for r in got.collect()} == want
    assert near.near_places(df.limit(0), places).count() == 0
    assert near.near_places(df, places.limit(0)).count() == 0


def test_near_with_many_leaves(spark):
    """Sites enough for many leaves, zones for many stripes: both forms find the same."""
    rng = np.random.default_rng(4)
    ring = lambda x, y: [[{"x": x + a, "y": y + b} for a, b in ((0, 0), (0.02, 0), (0.02, 0.03), (0, 0.03), (0, 0))]]
    rows = [(i, "site", float(y), float(x), float(r), None) for i, (y, x, r) in enumerate(zip(rng.uniform(44, 46, 400), rng.uniform(8, 10, 400), rng.uniform(50, 9000, 400)))]
    rows += [(1000 + i, "zone", None, None, None, ring(float(x), float(y))) for i, (y, x) in enumerate(zip(rng.uniform(44, 46, 300), rng.uniform(8, 10, 300)))]
    places = spark.createDataFrame(rows, PLACES)
    df = pings(spark, [(1, y, x, T0) for y, x in zip(rng.uniform(44, 46, 1500), rng.uniform(8, 10, 1500))])
    found = [sorted(map(str, near.near_places(df, places, most_broadcast=most).collect())) for most in (near.MOST_BROADCAST, 0)]
    assert found[0] == found[1] and len(found[0]) > 1000


def test_kd_splits_against_all_pairs():
    rng = np.random.default_rng(8)
    y, x, r = rng.uniform(-85, 85, 400), rng.uniform(-180, 180, 400), rng.uniform(10e3, 900e3, 400)
    py, px = rng.uniform(-90, 90, 500), rng.uniform(-180, 180, 500)
    i, s, d = near.Sites(y, x, r).within(py, px)
    far = haversine_np(py[:, None], px[:, None], y[None], x[None]) * 1000
    assert set(zip(i.tolist(), s.tolist())) == set(zip(*[z.tolist() for z in np.nonzero(far <= r)]))


def test_faults(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = walk(rng, 1, 3000) + walk(rng, 2, 500, start=T0 + dt.timedelta(days=1), y=-17.0, x=179.99) + walk(rng, 3, 300)
    truth = {}
    for at, k, far in ((100, 1, 0.3), (400, 2, 1.0), (800, 3, 10.0), (1200, 1, 0.2), (3200, 3, 0.5)):
        for j in range(at, at + k):
            u, y, x, t = rows[j]
            rows[j] = (u, y + far, (x + far + 180) % 360 - 180, t)
            truth[j] = "spike"
    for j in range(3600, 3604):  # four together are no case
        u, y, x, t = rows[j]
        rows[j] = (u, y + 1, x, t)
    move = next(i for i in range(2300, 3000) if all(haversine_np(rows[j][1], rows[j][2], rows[j + 1][1], rows[j + 1][2]) > 0.1 for j in range(i, i + 12)))
    for j in range(move + 1, move + 9):
        rows[j] = (*rows[move][:3], rows[j][3])
        truth[j] = "stuck"
    extra = [(1, 0.0, 0.0, T0), (1, 95.0, 9.0, T0), (1, 45.0, 999.0, None), (1, 45.0, 9.0, dt.datetime(1970, 1, 1)), (None, 95.0, 9.0, T0), (1, None, None, T0), (9, 45.0, 9.0, T0)]
    base = len(rows)
    truth |= {base: "no_place", base + 1: "no_place", base + 2: "no_place", base + 3: "no_time"}
    df = hostile(pings(spark, rows + extra)).cache()
    for least in (100_000, 300):
        monkeypatch.setattr(ordered, "CHUNK_ROWS", least)
        assert {r.ping_id: r.kind for r in faults.faults(df).collect()} == truth
    copies = df.unionByName(df.withColumn("ping_id", F.col("ping_id") + 100_000))
    assert faults.faults(copies).count() == 2 * len(truth)
    assert faults.faults(df.limit(0)).count() == 0


def test_leap_of_a_slow_source(spark):
    """No speed is too low for a leap: 50 m there and back within minutes, from a source that else drifts at less than 0.05 km/h."""
    rng = np.random.default_rng(4)
    rows = [(1, 45 + 1e-5 * i + rng.normal(0, 1e-6), 9.0, T0 + dt.timedelta(seconds=130 * i)) for i in range(40)]
    rows += [(2, 45.0, 9.0, T0 + dt.timedelta(seconds=130 * i)) for i in range(4)]  # never moves, thus none
    u, y, x, t = rows[20]
    rows[20] = (u, y + 50 / 111_195, x, t)
    assert {(r.ping_id, r.kind) for r in faults.faults(pings(spark, rows)).collect()} == {(20, "spike")}


def plain_stays(us, y, x, stay=trips.Stay()):
    out, i, n = [], 0, len(us)
    while i < n:
        j = i
        while j + 1 < n and us[j + 1] - us[j] <= stay.silence_s * 1e6 and haversine_np(y[i], x[i], y[j + 1], x[j + 1]) <= stay.radius_km:
            j += 1
        if us[j] - us[i] >= stay.least_s * 1e6:
            out.append((i, j))
            i = j + 1
        else:
            i += 1
    return out


def test_stays_against_definition():
    rng = np.random.default_rng(3)
    for k in range(60):
        cadence = int(rng.choice([20, 60, 300, 1500]))
        rows = walk(rng, 1, int(rng.integers(3, 400)), cadence=cadence, speed=float(rng.choice([0.002, 0.02])), x=float(rng.choice([9.0, 179.999])), y=float(rng.choice([0.1, 45.0, 77.6])))
        us = np.array([int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6) for *_, t in rows])
        if k % 3 == 0:
            us[len(us) // 2 :] += 90_000_000_000
        y, x = np.array([r[1] for r in rows]), (np.array([r[2] for r in rows]) + 180) % 360 - 180
        starts = np.zeros(len(us), bool)
        starts[0] = True
        assert trips.stays(us, y, x, starts, trips.Stay()) == plain_stays(us, y, x)


def test_stays_of_sparse_reporters():
    """Fast reports on the way and few or none while standing; arrival and departure share slots with the stay's first and last ping."""
    rng = np.random.default_rng(9)
    stops = 0
    for lat in (0.0, 45.0, 77.6, 89.97):
        wide = np.cos(np.radians(lat))
        for waits in ([7200], [900, 900], [300] * 5, [1190, 30], [86_400]):
            t, a, rows = 0, 0.0, []
            for _ in range(4):
                for _ in range(30):
                    a, t = a + 0.004, t + 10
                    rows.append((t, lat, 179.95 + a / wide))
                for w in waits:
                    t += w
                    rows.append((t, lat + rng.normal(0, 1e-4), 179.95 + a / wide + rng.normal(0, 1e-4) / wide))
            us, y, x = (np.array(c) for c in zip(*rows))
            us, x, starts = us * 1_000_000, (x + 180) % 360 - 180, np.arange(len(us)) == 0
            want = plain_stays(us, y, x)
            stops += len(want)
            assert trips.stays(us, y, x, starts, trips.Stay()) == want
    assert stops == 80


REAL = "/root/testdata/sf0.01/privacy_toy.parquet"


@pytest.fixture(scope="module")
def real():
    """Distinct dated pings in order, by uid: us, lat, lng."""
    import pandas as pd

    if not os.path.exists(REAL):
        pytest.skip("no test tables here")
    p = pd.read_parquet(REAL, columns=["uid", "lat", "lng", "datetime"]).dropna().drop_duplicates()
    p = p[(p.lat.abs() <= 90) & (p.lng.abs() <= 180) & ((p.lat != 0) | (p.lng != 0)) & (p.datetime >= "2005-01-01") & (p.datetime < "2036-01-01")]
    p["us"] = p["datetime"].astype("datetime64[us]").astype("int64")
    return {u: (g.us.to_numpy(), g.lat.to_numpy(), g.lng.to_numpy()) for u, g in p.sort_values(["uid", "us", "lat", "lng"]).groupby("uid")}


def test_no_stay_is_lost_on_real_pings(real, monkeypatch):
    """Sources of every cadence, spikes and all: with plateaus, without them, and by the definition the same stays."""
    parts = [(us, y, x) for us, y, x in real.values()]
    us, y, x = (np.concatenate(c) for c in zip(*parts))
    starts = np.zeros(len(us), bool)
    starts[np.cumsum([0, *[len(p[0]) for p in parts]])[:-1]] = True
    got = trips.stays(us, y, x, starts, trips.Stay())
    monkeypatch.setattr(trips, "plateaus", lambda us, p, starts, stay: [(0, len(us))])
    assert got == trips.stays(us, y, x, starts, trips.Stay()) and len(got) > 400
    first = np.flatnonzero(starts)
    for a, (u, v, w) in list(zip(first, parts))[::4]:
        if len(u) < 3000:
            assert [(i - a, j - a) for i, j in got if a <= i < a + len(u)] == plain_stays(u, v, w)
    monkeypatch.setattr(trips, "plateaus", lambda us, p, starts, stay: [])
    assert trips.stays(us, y, x, starts, trips.Stay()) == []  # stops come from plateaus


def test_total_variation_decides(monkeypatch):
    """A standing source's stays need the denoised path, a walker's pings aren't looked at; with the averages as they are stays are lost."""
    rng = np.random.default_rng(12)
    n = 400
    us, starts = 1_300_000_000_000_000 + np.arange(n) * 60_000_000, np.arange(n) == 0
    east = np.where(np.arange(n) < 200, 0.0, 0.05)  # 4 km on at once
    y, x = 45 + rng.normal(0, 3e-4, n), 9 + east + rng.normal(0, 3e-4, n)
    want = plain_stays(us, y, x)
    assert len(want) >= 2 and trips.stays(us, y, x, starts, trips.Stay()) == want
    walked = 45 + np.arange(n) * 0.083 / 111.195  # 5 km/h
    assert trips.plateaus(us, trips.unit_vectors(walked, np.full(n, 9.0)), starts, trips.Stay()) == []
    monkeypatch.setattr(trips, "total_variation", lambda z, penalty: np.array(z, float))
    assert set(trips.stays(us, y, x, starts, trips.Stay())) < set(want)


def test_plateaus_lose_no_stay(monkeypatch):
    """Scatter up to the radius, leaps, silences, any slot and penalty: the same stays as with all pings let through."""
    rng, shipped, found = np.random.default_rng(13), trips.plateaus, 0
    for _ in range(200):
        n, amp = int(rng.integers(1, 400)), float(rng.choice([0.01, 0.1, 0.19]))
        us = np.cumsum(rng.choice([0, 1, 5, 90], n, p=[0.05, 0.85, 0.09, 0.01]) * int(rng.choice([5, 60, 300]))) * 1_000_000
        east = amp * rng.choice([-1, 1], n) + np.cumsum(rng.random(n) < 0.02) * float(rng.choice([0, 0.3, 3]))
        y, x = 45 + amp * (rng.random(n) - 0.5) / 111.195, (179.999 + east / 78.6 + 180) % 360 - 180
        starts = rng.random(n) < 0.005
        starts[0] = True
        stay = trips.Stay(float(rng.choice([60, 1200])), 0.2, float(rng.choice([500, 86_400])), float(rng.choice([1, 120, 3000])), float(rng.choice([0, 0.1, 5])))
        monkeypatch.setattr(trips, "plateaus", lambda us, p, starts, stay: [(0, len(us))])
        want = trips.stays(us, y, x, starts, stay)
        monkeypatch.setattr(trips, "plateaus", shipped)
        assert trips.stays(us, y, x, starts, stay) == want
        found += len(want)
    assert found > 1000


def test_ellipsoids_decide(spark, monkeypatch):
    """What isn't outside the ellipsoids is no spike; and with everything outside, a scattering source's normal speed is underrated."""
    rng = np.random.default_rng(11)
    rows = walk(rng, 1, 1200)
    for at in (100, 700):
        u, y, x, t = rows[at]
        rows[at] = (u, y + 0.3, x, t)
    us = np.array([int((r[3] - dt.datetime(1970, 1, 1)).total_seconds() * 1e6) for r in rows])
    y, x = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    starts = np.arange(len(us)) == 0
    lim = faults.Limits()

    def found():
        at, total, reps, (_, b, v) = faults.profile(us, y, x, starts, lim)
        speed = np.full(len(us), faults.normal_speed(b, v, lim))
        return np.flatnonzero(faults.spikes(us, y, x, starts, speed, lim)).tolist()

    assert found() == [100, 700]
    with monkeypatch.context() as m:
        m.setattr(faults, "outside", lambda us, y, x, starts: np.zeros(len(us), bool))
        assert found() == []
    # this source goes to and fro all the time: its normal way of moving, as the scales tell
    y = 45 + np.where(np.arange(1200) % 3 == 2, 0.004, 0.0) + rng.normal(0, 1e-6, 1200)
    x, us = np.full(1200, 9.0), 1_300_000_000_000_000 + np.arange(1200) * 60_000_000
    assert found() == []
    monkeypatch.setattr(faults, "outside", lambda us, y, x, starts: np.ones(len(us), bool))
    assert len(found()) > 100


def test_total_variation_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, lam = int(rng.integers(3, 50)), float(rng.choice([0.01, 0.3, 4]))
        z = np.cumsum(rng.normal(size=n) * rng.choice([0.01, 1]))
        u = trips.total_variation(z, lam)
        s = np.cumsum(z - u)
        assert len(u) == n and abs(s[-1]) < 1e-9 and (np.abs(s[:-1]) <= lam + 1e-9).all()
        for i in np.flatnonzero(np.abs(np.diff(u)) > 1e-9):
            assert s[i] == pytest.approx(-lam * np.sign(u[i + 1] - u[i]), abs=1e-7)


def test_trips(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = walk(rng, 1, 4000) + walk(rng, 2, 300)
    df = hostile(pings(spark, rows + rows[:30] + [(3, None, 9.0, T0), (None, 45.0, 9.0, T0), (4, 45.0, 9.0, None), (5, 45.0, 9.0, T0)])).cache()
    want = set()
    for uid, part in ((1, rows[:4000]), (2, rows[4000:])):
        us = np.array([int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6) for *_, t in part])
        found = plain_stays(us, np.array([r[1] for r in part]), np.array([r[2] for r in part]))
        want |= {("stop", uid, int(us[a]), int(us[b])) for a, b in found}
        want |= {("trip", uid, int(us[b]), int(us[a])) for (_, b), (a, _) in zip(found, found[1:])}
    for least in (100_000, 400):
        monkeypatch.setattr(ordered, "CHUNK_ROWS", least)
        assert {(r.kind, r.uid, r.start_us, r.end_us) for r in trips.stops_and_trips(df).collect()} == want
    assert trips.stops_and_trips(df.limit(0)).count() == 0


def test_hot_row_shrinks_before_the_shuffle(spark):
    import pyarrow as pa

    b = pa.record_batch([pa.array([1, 1, 1, 2, None, None]), pa.array([0.5, 0.5, 0.5, 0.5, None, None]), pa.array(["a", "a", "b", "a", None, None])], names=["k", "y", "s"])
    assert ordered.drop_copies(b, ["k", "y", "s"]).num_rows == 4
    assert ordered.drop_copies(b.slice(0, 0), ["k"]).num_rows == 0


def test_string_keys(spark):
    rows = spark.createDataFrame([(f"u{i % 3}", T0 + dt.timedelta(seconds=i * 700), 45.0, 9.0 + i) for i in range(60)], "uid string, datetime timestamp_ntz, lat double, lng double")
    assert sum(r.n for r in sessions.sessions(rows).collect()) == 60
    assert sum(r.n for r in keyed.path_measures(rows).collect()) == 60


