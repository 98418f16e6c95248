import datetime as dt
import json
import struct

import pytest

from pathloom.frames import Flows, Trajectories
from pathloom.sources import datasets, files, shapefile
from pathloom.streaming import sessions as stream


def test_constructors(spark):
    rows = [[1, 39.984094, 116.319236, "2008-10-23 13:53:05"]] * 4
    t = Trajectories.of(rows, spark, latitude=1, longitude=2, datetime=3, user_id=0)
    assert set(t.df.columns) == {"uid", "lat", "lng", "datetime"} and t.df.count() == 4
    d = Trajectories.of({"user": [1], "latitude": [39.9], "lng": [116.3], "hour": ["2008-10-23 13:53:05"]}, spark, latitude="latitude", datetime="hour", user_id="user")
    assert d.convert_timezone("Europe/London", "Europe/Berlin").df.first().datetime == dt.datetime(2008, 10, 23, 14, 53, 5)
    assert isinstance(t.select("lat", "lng", "datetime"), Trajectories) and not isinstance(t.select("lat"), Trajectories)
    s = Trajectories.of(spark.createDataFrame([(1.0, 2.0, 1224769985)], "lat double, lng double, datetime long"), timestamp=True)
    assert s.df.first().datetime == dt.datetime(2008, 10, 23, 13, 53, 5)
    with pytest.raises(TypeError):
        Trajectories.of(3, spark)
    with pytest.raises(TypeError):
        Trajectories(t.df, crs="x")
    with pytest.raises(AttributeError):
        Trajectories(t.df, parameters=[])
    with pytest.raises(AttributeError):
        _ = Trajectories(t.df.drop("lng")).lng


def test_chain_remembers(twenty):
    t = Trajectories(twenty).compress(0.4).stay_locations(spatial_radius_km=None)
    assert list(t.parameters) == ["compress", "detect"]
    assert t.settings_from(Trajectories(twenty)).parameters == {}


def test_csv_and_round_trip(spark, twenty, tmp_path):
    path = str(tmp_path / "t.csv")
    twenty.toPandas().rename(columns={"lat": "latitude"}).to_csv(path, index=False)
    t = files.read_trajectories(spark, path, latitude="latitude", columns=["uid", "latitude", "lng", "datetime"])
    assert t.df.count() == 20 and t.parameters["from_file"] == path
    files.write(t, str(tmp_path / "out"))
    back = files.read(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.df.collect())) == sorted(map(tuple, t.df.collect())) and back.parameters == t.parameters


def test_flows_files(spark, tmp_path):
    tiles = spark.createDataFrame([("a", 45.0, 9.0), ("b", 46.0, 9.0)], "tile_ID string, lat double, lng double")
    (tmp_path / "f.csv").write_text("flow,origin,destination\n3,a,b\n1,b,a\n")
    f = files.read_flows(spark, str(tmp_path / "f.csv"), tiles)
    assert f.get_flow("a", "b").first().flow == 3
    files.write(f, str(tmp_path / "out"))
    back = files.read(spark, str(tmp_path / "out"))
    assert isinstance(back, Flows) and back.df.count() == 2 and back.tiles.count() == 2
    (tmp_path / "bad.csv").write_text("flow,origin,destination\n3,a,z\n")
    with pytest.raises(ValueError):
        files.read_flows(spark, str(tmp_path / "bad.csv"), tiles)
    with pytest.raises(TypeError):
        Flows(f.df, None)
    (tmp_path / "xy.csv").write_text("flow,oy,ox,dy,dx\n2,45.01,9.0,46.01,9.0\n5,45.01,9.0,45.01,9.0\n")
    kw = dict(origin_lat="oy", origin_lng="ox", destination_lat="dy", destination_lng="dx")
    near = files.read_flows(spark, str(tmp_path / "xy.csv"), tiles, **kw)
    assert {(r.origin, r.destination, r.flow) for r in near.df.collect()} == {("a", "b", 2.0), ("a", "a", 5.0)}
    own = files.read_flows(spark, str(tmp_path / "xy.csv"), **kw)
    assert own.tiles.count() == 2 and own.df.count() == 2


def test_gpx_plt_timeline(spark, tmp_path):
    gpx = '<?xml version="1.0"?><gpx><trk><trkseg>' + "".join(f'<trkpt lat="45.{i}" lon="9.{i}"><ele>3</ele><time>2011-02-03T08:0{i}:00Z</time></trkpt>' for i in range(5)) + "</trkseg></trk></gpx>"
    (tmp_path / "a.gpx").write_text(gpx)
    g = files.read_gpx(spark, str(tmp_path / "a.gpx"), user_id=7).df.orderBy("datetime").collect()
    assert [r.lat for r in g] == [45.0, 45.1, 45.2, 45.3, 45.4] and g[0].uid == 7 and g[1].datetime == dt.datetime(2011, 2, 3, 8, 1)
    for who in ("001", "005"):
        d = tmp_path / "Data" / who / "Trajectory"
        d.mkdir(parents=True)
        (d / "x.plt").write_text("Head\nWGS 84\nAltitude is in Feet\nReserved 3\n0,2,255,My Track,0,0,2,8421376\n0\n" + "".join(f"39.{i}0,116.3,0,492,39744.12,2008-10-23,02:5{i}:04\n" for i in range(4)))
    p = files.read_plt(spark, str(tmp_path), filter_kwargs={"max_speed_kmh": 1e6})
    assert p.df.count() == 8 and {r.uid for r in p.df.collect()} == {"001", "005"}
    assert files.read_plt(spark, str(tmp_path), ["005"], {"max_speed_kmh": 1e6}).df.count() == 4
    (tmp_path / "l.json").write_text(json.dumps({"locations": [{"latitudeE7": 450000000, "longitudeE7": 90000000, "timestampMs": "1296721444000", "accuracy": a} for a in (5, 500)]}))
    t = files.read_timeline(spark, str(tmp_path / "l.json"), user_id=1, min_accuracy_meters=100).df.collect()
    assert len(t) == 1 and t[0].lat == 45.0 and t[0].datetime == dt.datetime(2011, 2, 3, 8, 24, 4)


def test_shapes(spark, tmp_path):
    square = [[0, 0], [0, 1], [1, 1], [1, 0], [0, 0]]
    far = [[x + 5, y] for x, y in square]
    features = [{"type": "Feature", "properties": {"tile_id": "a", "population": 3}, "geometry": {"type": "Polygon", "coordinates": [square]}}, {"type": "Feature", "properties": {"tile_id": "b", "population": 4}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [far]]}}]
    (tmp_path / "t.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    t = {r.tile_ID: r for r in files.read_geojson(spark, str(tmp_path / "t.json"), "tile_id").collect()}
    assert len(t["a"].geometry) == 1 and len(t["b"].geometry) == 2 and t["b"].population == 4 and t["a"].geometry[0][2].x == 1
    corners = [(float(x), float(y)) for x, y in square]
    body = struct.pack("<i4d2ii", 5, 0, 0, 1, 1, 1, len(corners), 0) + b"".join(struct.pack("<2d", *c) for c in corners)
    data = b"\0" * 100 + struct.pack(">ii", 1, len(body) // 2) + body
    (tmp_path / "s.shp").write_bytes(data)
    assert list(shapefile.polygons(data)) == [(1, [corners])]
    assert datasets.load_dataset(spark, "nyc_boundaries", str(tmp_path / "s.shp")).first().geometry[0][1].y == 1.0


def test_catalog(spark, tmp_path):
    assert "foursquare_nyc" in datasets.list_datasets() and datasets.list_datasets(data_types=["flow"]) == ["flow_foursquare_nyc"]
    assert datasets.dataset_info("parking_san_francisco")["data_type"] == "auxiliar"
    for bad in (lambda: datasets.load_dataset(spark, "none", ""), lambda: datasets.load_dataset(spark, "foursquare_nyc", "", drop_columns=3), lambda: datasets.list_datasets(data_types="flow"), lambda: datasets.dataset_info("none")):
        with pytest.raises(ValueError):
            bad()
    (tmp_path / "c.tsv").write_text("470\tv\tc\tn\t40.71\t-74.0\t-240\tTue Apr 03 18:00:09 +0000 2012\n979\tv\tc\tn\t40.60\t-74.04\t-240\tTue Apr 03 18:00:25 +0000 2012\n979\tv\tc\tn\t40.75\t-73.9\t-240\tTue Apr 03 19:00:25 +0000 2012\n5\tv\tc\tn\t40.5\t-74.2\t-240\tTue Apr 03 19:00:25 +0000 2012\n5\tv\tc\tn\t40.9\t-73.7\t-240\tTue Apr 03 20:00:25 +0000 2012\n")
    t = datasets.load_dataset(spark, "foursquare_nyc", str(tmp_path / "c.tsv"), drop_columns=True)
    assert t.df.orderBy("datetime").first().datetime == dt.datetime(2012, 4, 3, 18, 0, 9)
    assert datasets.load_dataset(spark, "flow_foursquare_nyc", str(tmp_path / "c.tsv")).df.count() >= 1  # one more if the corner counts
    (tmp_path / "new_abc.txt").write_text("37.75134 -122.39488 0 1213084687\n37.75136 -122.39527 0 1213084659\n")
    cab = datasets.load_dataset(spark, "taxi_san_francisco", str(tmp_path / "new_abc.txt")).df.orderBy("datetime").first()
    assert cab.uid == "abc" and cab.datetime == dt.datetime(2008, 6, 10, 0, 57, 39)


def test_session_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2011, 2, 1)
    rows = [(u, t0 + dt.timedelta(minutes=m)) for u in (1, 2) for m in (0, 5, 29, 59, 90, 200, 230, 231)]
    files_ = [rows[1::2], rows[0::2], [(99, t0 + dt.timedelta(days=9))]]  # the last moves the watermark past all timers
    schema = "uid long, datetime timestamp_ntz"
    for i, part in enumerate(files_):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(i)))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = stream.session_stream(src, late="1 day").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    from pathloom.operators.sessions import sessions

    want = {(r.uid, r.start_us, r.end_us, r.n) for r in sessions(spark.createDataFrame(rows, schema)).collect()}
    assert {(r.uid, r.start_us, r.end_us, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_counts_stream(spark, tmp_path):
    t0 = dt.datetime(2011, 2, 1)
    schema = "uid long, datetime timestamp_ntz"
    for i, part in enumerate([[(1, t0 + dt.timedelta(minutes=m)) for m in (1, 30, 61, 130)], [(1, t0 + dt.timedelta(days=2))]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = stream.counts_stream(src).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert [r.n_visits for r in spark.read.parquet(str(tmp_path / "out")).orderBy("slot").collect()] == [2, 1, 1]
