import numpy as np
import pytest
from helpers import TWENTY, by_uid, rows_of
from pyspark.sql import functions as F

from pathloom.operators import preprocess as p


def kept(df):
    return sorted(r.row_id for r in df.collect())


def test_filter(twenty):
    assert set(range(20)) - set(kept(p.filter_speed(twenty, 10))) == {1, 5, 9, 13, 16}
    assert kept(p.filter_speed(twenty, 120)) == list(range(20))
    with pytest.raises(ValueError):
        p.filter_speed(twenty, include_loops=True, max_loop=1)
    assert p.filter_speed(twenty, 120, include_loops=True).count() <= 20


def test_compress(twenty):
    assert p.compress(twenty, 0.2).count() == 20
    out = p.compress(twenty, 20)
    assert out.count() == 15
    assert (43.6264, 10.364875) in [(round(r.lat, 4), round(r.lng, 6)) for r in out.collect()]


def test_stays(spark):
    import datetime as dt

    rows = rows_of(TWENTY) + [(20 + k, 7, 45.54427, 9.32615, dt.datetime(2011, 2, d, 11, 34, 4)) for k, d in enumerate((4, 5, 6))]
    df = spark.createDataFrame(rows, "row_id int, uid long, lat double, lng double, datetime timestamp_ntz")
    start = {(r.uid, r.datetime): r.row_id for r in df.collect()}  # a stop has the time of its first point, extra columns of its last
    first = lambda d: sorted(start[r.uid, r.datetime] for r in d.collect())
    out = p.stay_locations(df)
    assert set(range(23)) - set(first(out)) == {3, 7, 11, 14, 17, 19, 21, 22}
    assert out.where("leaving_datetime <= datetime").count() == 0
    long_ = p.stay_locations(df, minutes_for_a_stop=60, leaving_time=False)
    assert first(long_) == [2, 5, 9, 16, 20] and "leaving_datetime" not in long_.columns
    with pytest.raises(ValueError):
        p.stay_locations(df, spatial_radius_km=None)
    assert p.stay_locations(df, spatial_radius_km=None, compress_radius_km=0.4).count() == out.count()
    assert p.stay_locations(df, min_speed_kmh=0.5).count() <= out.count()
    assert p.stay_locations(df, no_data_for_minutes=30).count() == 0


def test_cluster(twenty):
    def labels(r):
        return [r.cluster for r in p.cluster(twenty, r).orderBy("row_id").collect()]

    assert labels(0.1) == [3, 2, 1, 0, 0, 2, 0, 1, 3, 2, 1, 0, 2, 1, 0, 2, 1, 0, 1, 0]
    assert labels(40) == [0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 1, 0, 1, 0, 0, 0]


def test_noise_and_empty(twenty):
    assert {r.cluster for r in p.cluster(twenty, 0.1, min_samples=3).collect()} == {-1}
    none = twenty.where("uid = 99")
    for f in (p.filter_speed, p.compress, p.stay_locations, p.cluster):
        assert f(none).count() == 0


def test_nulls_are_left_out(twenty):
    holes = twenty.withColumn("lat", F.when(F.col("row_id") == 1, None).otherwise(F.col("lat")))
    assert p.compress(holes).count() == 19


def test_run_starts_against_loop():
    rng = np.random.default_rng(1)
    from pathloom.functions.geo import haversine_np

    for _ in range(50):
        n = int(rng.integers(1, 60))
        y, x = np.cumsum(rng.normal(0, 0.002, n)) + 45, np.cumsum(rng.normal(0, 0.002, n)) + 9
        starts = rng.random(n) < 0.1
        starts[0] = True
        got = p.run_starts(y, x, starts, 0.3)
        a = 0
        for i in range(n):
            new = starts[i] or haversine_np(y[a], x[a], y[i], x[i]) > 0.3
            assert got[i] == new
            a = i if new else a


def test_order_doesnt_depend_on_input(twenty):
    assert by_uid(p.compress(twenty.orderBy(F.desc("row_id")), 20), "lat") == by_uid(p.compress(twenty, 20), "lat")


def test_hot_individuals_are_cut(spark, monkeypatch):
    import datetime as dt

    from pathloom.operators import ordered

    rng = np.random.default_rng(4)
    rows = []
    for uid, n in ((1, 900), (2, 60)):
        y = 45 + np.cumsum(rng.choice([0, 0.0003, -0.0003, 0.01, -0.01], n, p=[0.4, 0.25, 0.25, 0.05, 0.05]))
        t = dt.datetime(2011, 1, 1)
        for v in y:
            t += dt.timedelta(minutes=int(rng.integers(1, 9)))
            rows.append((uid, float(v), 9.0, t, "x"))
    df = spark.createDataFrame(rows, "uid long, lat double, lng double, datetime timestamp_ntz, note string")
    for f in (lambda: p.compress(df, 0.2), lambda: p.stay_locations(df), lambda: p.stay_locations(df, min_speed_kmh=1.0), lambda: p.stay_locations(df, no_data_for_minutes=7)):
        monkeypatch.setattr(ordered, "CHUNK_ROWS", 100_000)
        whole = sorted(map(tuple, f().collect()))
        monkeypatch.setattr(ordered, "CHUNK_ROWS", 100)
        assert sorted(map(tuple, f().collect())) == whole and whole
