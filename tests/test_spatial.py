import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions.geo import haversine_np
from pathloom.operators import drawing, spatial, tessellation
from pathloom.schema import GEOMETRY

X, Y = (116.1440758191, 116.278823111718, 116.413570404336), (39.8846396072, 39.987958221274, 40.091120806035)
NINE = {
    1: [(39.978253, 116.3272755, 1, "08:34:04"), (40.013819, 116.306532, 1, "10:34:08"), (39.878987, 116.1266865, 5, "10:34:08"), (40.013819, 116.306532, 10, "12:34:15"), (39.97958, 116.313649, 1, "01:34:28")],
    2: [(39.978696, 116.3262205, 1, "03:34:54"), (39.98153775, 116.31079, 1, "04:34:55"), (39.978161, 116.3272425, 5, "05:29:12")],
    3: [(39.9, 116.0, 15, "00:29:12")],
}


@pytest.fixture(scope="module")
def tiles(spark):
    rows = [(str(k), [[{"x": a, "y": b} for a, b in ((X[i], Y[j]), (X[i], Y[j + 1]), (X[i + 1], Y[j + 1]), (X[i + 1], Y[j]), (X[i], Y[j]))]]) for k, (i, j) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1)))]
    return spark.createDataFrame(rows, T.StructType([T.StructField("tile_ID", T.StringType()), T.StructField("geometry", GEOMETRY)]))


@pytest.fixture(scope="module")
def nine(spark):
    rows = [(u, y, x, dt.datetime.fromisoformat(f"2013-01-{d:02d} {t}")) for u, ps in NINE.items() for y, x, d, t in ps]
    return spark.createDataFrame(rows, "uid long, lat double, lng double, datetime timestamp_ntz")


def test_mapping_both_forms(nine, tiles):
    for most in (spatial.MOST_BROADCAST, 0):
        got = spatial.map_to_tiles(nine.withColumn("n", F.lit(1)), tiles, most_broadcast=most)
        assert got.count() == 9 and got.where("tile_ID is null").count() == 2
        for r in got.where("tile_ID is not null").collect():
            i, j = int(r.lng > X[1]), int(r.lat > Y[1])
            assert r.tile_ID == str(2 * i + j)
        assert spatial.map_to_tiles(nine, tiles, remove_na=True, most_broadcast=most).count() == 7
    holes = nine.withColumn("lat", F.when(F.col("uid") == 3, None).otherwise(F.col("lat")))
    assert spatial.map_to_tiles(holes, tiles).where("tile_ID is null").count() == 2
    assert spatial.map_to_tiles(nine.limit(0), tiles).count() == 0


def test_borders_are_the_same_in_both_forms(spark):
    """Corners, edges and slanted borders: a point belongs to the same tiles, whichever way they are found."""
    ring = lambda *p: [[{"x": float(x), "y": float(y)} for x, y in p]]
    shapes = [("a", ring((0, 0), (2, 2), (2, 0), (0, 0))), ("b", ring((0, 0), (2, 2), (0, 2))), ("c", ring((2, 0), (2, 2), (4, 2), (4, 0), (2, 0))), ("d", ring((0, 2), (0, 3), (4, 3), (4, 2), (0, 2))), ("e", None), ("f", []), ("g", ring((-100, -100), (100, -100), (100, 100), (-100, 100))), ("h", ring((0, 0), (3, 1), (1, 3)) + ring((1, 1), (1.5, 1.25), (1.25, 1.5)))]
    tiles = spark.createDataFrame(shapes, T.StructType([T.StructField("tile_ID", T.StringType()), T.StructField("geometry", GEOMETRY)]))
    at = [i / 4 for i in range(-2, 19)]
    points = spark.createDataFrame([(i, y, x) for i, (y, x) in enumerate((y, x) for y in at for x in at)] + [(900, None, 1.0), (901, 1.0, float("nan"))], "id long, lat double, lng double")
    found = []
    for most in (spatial.MOST_BROADCAST, 5, 0):
        for lone in (False, True):
            found.append(sorted((r.id, r.tile_ID or "") for r in spatial.map_to_tiles(points, tiles, remove_na=lone, most_broadcast=most).collect()))
    assert found[0] == found[2] == found[4] and found[1] == found[3] == found[5]
    assert [f for f in found[0] if f[1]] == found[1] and {i for i, t in found[0] if not t} == {900, 901}


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(6)
    tiles = spark.createDataFrame([(f"t{i:03d}", float(y), float(x)) for i, (y, x) in enumerate(zip(rng.uniform(-80, 80, 300), rng.uniform(-180, 180, 300)))] + [("t999", 10.0, 10.0), ("t998", 10.0, 10.0)], "tile_ID string, lat double, lng double")
    points = spark.createDataFrame([(float(y), float(x)) for y, x in zip(rng.uniform(-90, 90, 200), rng.uniform(-180, 180, 200))] + [(None, 1.0), (10.0, 10.0)], "lat double, lng double")
    one = sorted(map(str, spatial.nearest_tile(points, tiles, km="km").collect()))
    assert one == sorted(map(str, spatial.nearest_tile(points, tiles, km="km", most_broadcast=40).collect()))
    assert any("tile_ID='t998'" in r for r in one) and spatial.nearest_tile(points, tiles.limit(0)).where("tile_ID is not null").count() == 0


def test_flows_of_trips(spark):
    """With trips the order is that of trips, then of time; a trip's first point follows the last of the trip before."""
    t = dt.datetime(2011, 1, 1)
    rows = [(1, k, t + dt.timedelta(minutes=m), 0.0, 0.0, tile) for k, m, tile in ((2, 0, "c"), (2, 5, "d"), (1, 9, "a"), (1, 10, "b"), (3, 1, None), (4, 0, "e"))] + [(None, 1, t, 0.0, 0.0, "z"), (None, 1, t, 0.0, 0.0, "y")]
    df = spark.createDataFrame(rows, "uid long, tid long, datetime timestamp_ntz, lat double, lng double, tile_ID string")
    assert {(r.origin, r.destination, r.flow) for r in spatial.to_flows(df).collect()} == {("a", "b", 1), ("b", "c", 1), ("c", "d", 1)}


def test_running_sums_over_all_rows(spark):
    from pathloom.operators import ordered

    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("v"), F.lit(1).alias("_p"), F.lit(2).alias("_i"))
    got = ordered.running(df, ["v"], "n").orderBy("v").collect()
    assert [r.n for r in got] == list(range(1000)) and got[0]._p == 1
    total = ordered.running(df, [F.desc("v")], "n", F.col("v")).orderBy("v").collect()
    assert all(r.n == sum(range(r.v + 1, 1000)) for r in total)
    assert ordered.running(df.limit(0), ["v"], "n").count() == 0


def test_flows(nine, tiles):
    mapped = spatial.map_to_tiles(nine, tiles)
    flows = {(r.origin, r.destination): r.flow for r in spatial.to_flows(mapped).collect()}
    assert flows == {("2", "2"): 3, ("2", "3"): 1}
    assert {(r.origin, r.destination) for r in spatial.to_flows(mapped, self_loops=False).collect()} == {("2", "3")}
    wide = {r.origin: r for r in spatial.flow_matrix(spatial.to_flows(mapped), tiles).collect()}
    assert len(wide) == 4 and wide["2"]["2"] == 3 and wide["0"]["3"] == 0
    assert spatial.flow_between(spatial.to_flows(mapped), tiles, "2", "3").first().flow == 1
    assert spatial.flow_between(spatial.to_flows(mapped), tiles, "0", "3").first().flow == 0
    with pytest.raises(ValueError):
        spatial.flow_between(spatial.to_flows(mapped), tiles, "2", "nowhere")
    with pytest.raises(ValueError):
        spatial.check_flows(nine.sparkSession.createDataFrame([("2", "x", 1)], "origin string, destination string, flow long"), tiles)


def test_nearest(spark):
    rng = np.random.default_rng(1)
    t = [(f"t{i:03d}", float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-80, 80, 60), rng.uniform(-180, 180, 60)))]
    p = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-90, 90, 300), rng.uniform(-180, 180, 300)))] + [(300, None, 1.0)]
    got = spatial.nearest_tile(spark.createDataFrame(p, "id int, lat double, lng double"), spark.createDataFrame(t, "tile_ID string, lat double, lng double"), km="km").collect()
    ty, tx = np.array([r[1] for r in t]), np.array([r[2] for r in t])
    for r in got:
        if r.lat is None:
            assert r.tile_ID is None
        else:
            d = haversine_np(r.lat, r.lng, ty, tx)
            assert r.tile_ID == t[int(d.argmin())][0] and r.km == pytest.approx(d.min())


def test_squares_and_hexagons(spark):
    box = (9.0, 45.0, 9.1, 45.1)
    whole = tessellation.get("squared", spark, box, meters=2000)
    ring = [(9.0, 45.0), (9.0, 45.1), (9.1, 45.0), (9.0, 45.0)]
    part = tessellation.squares(spark, [ring], meters=2000)
    assert 0 < part.count() < whole.count()
    assert sorted(int(r.tile_ID) for r in part.collect()) == list(range(part.count()))
    hexes = tessellation.get("hexagonal", spark, [ring], meters=500)
    assert hexes.count() > 10 and all(len(r.geometry[0]) == 7 for r in hexes.collect())
    assert tessellation.hexagon_resolution(50) == 10 and tessellation.hexagon_resolution(500) == 8 and tessellation.hexagon_resolution(5000) == 6
    with pytest.raises(ValueError):
        tessellation.get("no such", spark)
    with pytest.raises(ValueError):
        tessellation.hexagons(spark, [ring], meters=1_000_000)
    points = spark.createDataFrame([(45.0, 9.0), (44.0, 9.0)], "lat double, lng double")
    assert [r.tile_ID for r in tessellation.get("voronoi", points).orderBy("lat").collect()] == ["0", "1"]


def test_group_by_time(nine):
    got = spatial.group_by_time(nine, "1 day")
    assert {(r.group, r.window_start.day) for r in got.collect()} == {(0, 1), (1, 5), (2, 10), (3, 15)}
    lead = spatial.group_by_time(nine, "1 day", add_starting_location=True)
    assert lead.count() == 12
    assert spatial.group_by_time(nine.limit(0)).count() == 0


def test_centroid(tiles):
    r = spatial.centroids(tiles).where("tile_ID = '0'").first()
    assert r.lat == pytest.approx((Y[0] + Y[1]) / 2) and r.lng == pytest.approx((X[0] + X[1]) / 2)


def test_drawing(nine, tiles):
    lines = drawing.trajectory_lines(nine, max_users=2, max_points=3)
    assert lines.count() == 2 and all(len(r.line) <= 5 for r in lines.collect())
    assert drawing.heat_points(nine, 4).count() <= 5
    flows = spatial.to_flows(spatial.map_to_tiles(nine, tiles))
    drawn = drawing.flow_lines(flows, spatial.centroids(tiles)).first()
    assert drawn.weight == 1.0 and drawn["rank"] == 1
    assert drawing.tile_features(tiles, 2).first().feature.startswith('{"type":"Feature"')
    stops = nine.withColumns({"leaving_datetime": F.col("datetime"), "cluster": F.lit(0)})
    assert drawing.diary_spans(stops, 1).count() == 5
    with pytest.raises(KeyError):
        drawing.diary_spans(stops, 77)
    assert drawing.stop_markers(stops).count() == 9
