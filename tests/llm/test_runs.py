import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from pathloom.functions.geo import haversine_np
from pathloom.llm import runs
from pathloom.operators import ordered

T0 = dt.datetime(2011, 2, 1)


def test_runs(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows, y, t = [], 45.0, T0
    for i in range(1200):
        y += float(rng.choice([0.0, 0.00002, 0.001]))
        t += dt.timedelta(seconds=int(rng.choice([30, 90_000], p=[0.97, 0.03])))
        rows.append((i % 7 // 6 + 1, y, 9.0, t))
    rows += rows[:40] + [(None, 45.0, 9.0, T0), (1, None, 9.0, T0), (1, 45.0, 9.0, None)]
    df = spark.createDataFrame(rows, "uid long, lat double, lng double, datetime timestamp_ntz").withColumns({c: F.lit(1) for c in ("k", "us", "chunk", "first", "last", "n")})
    want = set()
    for uid in (1, 2):
        own = sorted({r[1:] for r in rows if r[0] == uid and None not in r}, key=lambda r: (r[2], r[0], r[1]))
        at = 0
        for i in range(1, len(own) + 1):
            if i == len(own) or haversine_np(*own[i - 1][:2], *own[i][:2]) > 0.01 or (own[i][2] - own[i - 1][2]).total_seconds() > 86_400:
                us = [int((own[j][2] - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000 for j in (at, i - 1)]
                want.add((uid, us[0], us[1], i - at))
                at = i
    for least in (100_000, 60):
        monkeypatch.setattr(ordered, "CHUNK_ROWS", least)
        assert {(r.uid, r.start_us, r.end_us, r.n) for r in runs.collapse_runs(df).collect()} == want
    assert runs.collapse_runs(df.limit(0)).count() == 0
