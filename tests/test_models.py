import datetime as dt

import numpy as np
import pytest

from pathloom.functions.geo import haversine_np
from pathloom.models import agents, flows, social

START, END = dt.datetime(2020, 1, 1, 8), dt.datetime(2020, 1, 6, 8)
FOUR = [("0", 45.2, 7.50, 5.0, 11), ("1", 45.23, 7.50, 6.0, 12), ("2", 45.2, 7.55, 7.0, 13), ("3", 45.23, 7.55, 8.0, 19)]


@pytest.fixture(scope="module")
def tiles(spark):
    return spark.createDataFrame(FOUR, "tile_ID string, lat double, lng double, relevance double, tot_outflow long")


def closed_form(g):
    y, x, m, o = (np.array(c, float) for c in list(zip(*FOUR))[1:])
    d = haversine_np(y[:, None], x[:, None], y[None], x[None])
    with np.errstate(divide="ignore"):
        f = d**g.argument if g.deterrence == "power_law" else np.exp(-d * g.argument)
    np.fill_diagonal(f, 0)
    s = f * m[None] ** g.destination_exp
    if g.constraint == "singly constrained":
        return s / s.sum(axis=1, keepdims=True) * o[:, None]
    s = s * m[:, None] ** g.origin_exp
    return s / s.sum() * o.sum()


@pytest.mark.parametrize("deterrence,argument", [("power_law", -2.0), ("exponential", 0.2)])
@pytest.mark.parametrize("constraint", ["singly constrained", "globally constrained"])
def test_gravity(tiles, deterrence, argument, constraint):
    g = flows.Gravity(deterrence, argument, origin_exp=1.5, destination_exp=2.0, constraint=constraint)
    want = closed_form(g)
    for r in g.generate(tiles).collect():
        assert r.flow == pytest.approx(want[int(r.origin), int(r.destination)], abs=1e-12)
    sample = g.generate(tiles, out_format="flows_sample", seed=3).collect()
    assert sum(r.flow for r in sample) == 55
    assert sorted(map(tuple, sample)) == sorted(map(tuple, g.generate(tiles, out_format="flows_sample", seed=3).collect()))
    p = g.generate(tiles, out_format="probabilities").groupBy("origin").sum("flow").collect()
    assert sum(r[1] for r in p) == pytest.approx(4 if constraint == "singly constrained" else 1)


def test_gravity_fit(spark):
    rng = np.random.default_rng(2)
    rows = [(str(i), float(y), float(x), float(m), int(o)) for i, (y, x, m, o) in enumerate(zip(rng.uniform(45, 46, 30), rng.uniform(7, 8, 30), rng.uniform(1, 9, 30), rng.integers(500, 900, 30)))]
    tiles = spark.createDataFrame(rows, "tile_ID string, lat double, lng double, relevance double, tot_outflow long")
    for constraint in ("singly constrained", "globally constrained"):
        true = flows.Gravity(argument=-1.4, origin_exp=0.6, destination_exp=0.7, constraint=constraint)
        got = flows.Gravity(constraint=constraint).fit(true.generate(tiles), tiles)
        assert got.argument == pytest.approx(-1.4, abs=1e-3) and got.destination_exp == pytest.approx(0.7, abs=1e-3)
    assert got.origin_exp == pytest.approx(0.6, abs=1e-3)


def test_radiation(tiles):
    p = flows.Radiation().generate(tiles, out_format="probabilities")
    y, x, m, _ = (np.array(c, float) for c in list(zip(*FOUR))[1:])
    for r in p.collect():
        i, j = int(r.origin), int(r.destination)
        d = haversine_np(y[i], x[i], y, x)
        s = sum(m[k] for k in range(4) if k != i and (d[k], k) < (d[j], j))
        assert r.flow == pytest.approx(m[i] * m[j] / ((m[i] + s) * (m[i] + s + m[j])) / (1 - m[i] / m.sum()))
    assert all(float(r.flow).is_integer() for r in flows.Radiation().generate(tiles).collect())
    with pytest.raises(ValueError):
        flows.Radiation().generate(tiles, out_format="all")
    with pytest.raises(KeyError):
        flows.Radiation().generate(tiles.drop("tot_outflow"))
    with pytest.raises(ValueError):
        flows.Gravity("quadratic")


def test_epr(spark, tiles):
    a = agents.density_epr().generate(spark, START, END, tiles, n_agents=12, seed=5)
    rows = sorted(map(tuple, a.collect()))
    assert rows == sorted(map(tuple, a.repartition(7).collect())) and {r[0] for r in rows} == set(range(1, 13))
    assert all(START <= r[1] < END for r in rows) and {(r[2], r[3]) for r in rows} <= {(y, x) for _, y, x, *_ in FOUR}
    for u in range(1, 13):
        times = [r[1] for r in rows if r[0] == u]
        assert min((b - c).total_seconds() for b, c in zip(times[1:], times)) >= 20 * 60 - 1e-3
    one = agents.spatial_epr().generate(spark, START, END, tiles, n_agents=2, starting_locations=[3, 1], seed=1)
    first = {r.uid: (r.lat, r.lng) for r in one.where(f"datetime = timestamp_ntz'{START}'").collect()}
    assert first == {1: FOUR[3][1:3], 2: FOUR[1][1:3]}
    with pytest.raises(IndexError):
        agents.EPR().generate(spark, START, END, tiles, n_agents=3, starting_locations=[1])
    with pytest.raises(AttributeError):
        agents.EPR().generate(spark, START, END, tiles, flows.Gravity(constraint="globally constrained"))


def test_power_law():
    rng = np.random.default_rng(1)
    x = np.array([agents.truncated_power_law(rng, 1.8, 1 / 17, 1 / 3) for _ in range(20_000)])
    assert x.min() >= 1 / 3
    grid = np.geomspace(1 / 3, 400, 200_000)
    density = grid**-1.8 * np.exp(-grid / 17)
    mean = np.trapezoid(grid * density, grid) / np.trapezoid(density, grid)
    assert x.mean() == pytest.approx(mean, rel=0.06)


def test_diary(spark, tiles):
    rows, t = [], dt.datetime(2020, 1, 1)
    for day in range(12):
        for hour in range(24):
            rows.append((1, "work" if 9 <= hour < 17 else "home", t + dt.timedelta(days=day, hours=hour)))
    df = spark.createDataFrame(rows, "uid long, location string, datetime timestamp_ntz")
    d = agents.MarkovDiary().fit(df)
    assert np.allclose(d.chain.sum(axis=1)[d.chain.sum(axis=1) > 0], 1)
    page = d.generate(72, dt.datetime(2020, 3, 1), np.random.default_rng(1))
    assert [(p.hour, a) for p, a in page] == [(0, 0), (9, 1), (17, 0)] * 1 + [(9, 1), (17, 0)] * 2
    out = agents.Ditras(d).generate(spark, START, END, tiles, n_agents=3, seed=2)
    assert out.where("hour(datetime) = 17").count() > 0
    with pytest.raises(ValueError):
        agents.Ditras(agents.MarkovDiary()).generate(spark, START, END, tiles)


@pytest.mark.parametrize("model", [social.geosim(), social.sts_epr()])
def test_social(spark, tiles, model):
    kw = dict(n_agents=15, seed=4, populations=2)
    a = model.generate(spark, START, END, tiles, **kw)
    rows = sorted(map(tuple, a.collect()))
    assert rows == sorted(map(tuple, model.generate(spark, START, END, tiles, **kw).collect()))
    assert {r[0] for r in rows} == {0, 1} and all(START <= r[2] <= END for r in rows)
    edges = model.generate(spark, START, END, tiles, social_graph=[[0, 1], [0, 2], [0, 3], [1, 3], [2, 4]], seed=4)
    assert {r.uid for r in edges.collect()} == {1, 2, 3, 4, 5}
    for bad in (dict(n_agents=0), dict(social_graph="ring"), dict(social_graph=[])):
        with pytest.raises(ValueError):
            model.generate(spark, START, END, tiles, **bad)
    with pytest.raises(ValueError):
        model.generate(spark, END, START, tiles)


def test_weighted_choice():
    rng = np.random.default_rng(1)
    n = np.bincount([social.weighted_choice(rng, [1, 0, 3]) for _ in range(10_000)], minlength=3) / 10_000
    assert n[1] == 0 and n[0] == pytest.approx(0.25, abs=0.02)


