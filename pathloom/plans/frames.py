"""Queries for frames, readers, writers, tiles and drawing: tables are written in a source's form, read back and compared."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.frames import Flows, Trajectories
from pathloom.functions import geo
from pathloom.operators import collective, drawing, preprocess, spatial, tessellation
from pathloom.operators.ordered import micros
from pathloom.operators.privacy import time_bucket
from pathloom.plans.trajectories import TRAJ_SQL, haversine_sql, rounded, trajectories
from pathloom.session import scratch, table
from pathloom.sources import datasets, files

QUERIES: dict = {}
ORACLE: dict = {}


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return register


def _pings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "privacy_toy")


def _once(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ny_commuting_flows_2011").dropDuplicates(["flow_id"])


_PINGS = "SELECT ping_id, uid, lat, lng, epoch_us(datetime) AS us FROM privacy_toy"
_ONCE = "f AS (SELECT DISTINCT ON (flow_id) * FROM ny_commuting_flows_2011)"


def _told(df: DataFrame) -> DataFrame:
    return df.select("ping_id", "uid", "lat", "lng", micros("datetime").alias("us"))


@_query(_PINGS)
def frame_of_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Columns renamed and typed, datetimes given as seconds."""
    raw = _pings(spark, folder).select("ping_id", F.col("uid").alias("who"), F.col("lat").cast("string").alias("y"), F.col("lng").cast("string").alias("x"), (micros("datetime") / F.lit(1e6)).alias("sec"))
    return _told(Trajectories.of(raw, spark, "y", "x", "sec", "who", timestamp=True).df)


@_query("SELECT uid, epoch_us(max(datetime)) AS us, count(*) AS n FROM (SELECT DISTINCT uid, datetime, lat, lng FROM (SELECT uid, datetime, lat, lng FROM privacy_toy WHERE lat > 0 UNION ALL SELECT uid, datetime, lat, lng FROM privacy_toy)) p JOIN (SELECT DISTINCT uid FROM privacy_toy WHERE lng < 0) w USING (uid) GROUP BY uid")
def frame_relations(spark: SparkSession, folder: str) -> DataFrame:
    """Selecting, filtering, uniting, deduplicating and joining keep a frame and its record."""
    t = Trajectories.of(_pings(spark, folder), parameters={"from": "pings"}).select("uid", "datetime", "lat", "lng")
    west = t.where("lng < 0").df.select("uid").distinct()
    both = t.where("lat > 0").union(t).distinct().join(west, "uid").order_by("datetime").set_parameter("kept", "all")
    assert both.parameters == {"from": "pings", "kept": "all"} and both.crs == t.crs
    return both.df.groupBy("uid").agg(micros(F.max("datetime")).alias("us"), F.count("*").alias("n"))


@_query("SELECT ping_id, uid, lng AS x, lat AS y FROM privacy_toy")
def frame_points(spark: SparkSession, folder: str) -> DataFrame:
    return Trajectories.of(_pings(spark, folder)).to_points().select("ping_id", "uid", "geometry.x", "geometry.y")


@_query(_PINGS)
def csv_trajectories(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "csv")
    _pings(spark, folder).select("ping_id", F.col("uid").alias("user"), "lat", F.col("lng").alias("lon"), F.col("datetime").alias("check-in time")).write.option("compression", "gzip").csv(path, header=True, sep="\t")
    t = files.read_trajectories(spark, path, longitude="lon", datetime="check-in time", user_id="user", sep="\t")
    return _told(t.df.withColumns({c: F.col(c).cast("long") for c in ("ping_id", "uid")}))


@_query(_PINGS)
def csv_without_header(spark: SparkSession, folder: str) -> DataFrame:
    """Columns by position, of which those asked for are read; datetimes in seconds."""
    path = scratch(spark, "csv")
    _pings(spark, folder).select("lat", "lng", "received_at", (micros("datetime") / F.lit(1e6)).cast("decimal(20,6)"), "uid", "ping_id").write.csv(path)
    t = files.read_trajectories(spark, path, "0", "1", "3", "4", columns=["0", "1", "3", "4", "5"], header=False, timestamp=True)
    return _told(t.df.select(F.col("5").cast("long").alias("ping_id"), F.col("uid").cast("long"), "lat", "lng", "datetime"))


@_query(_PINGS)
def parquet_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Written with what the frame knows, and read back with it."""
    path = scratch(spark, "frame")
    files.write(Trajectories.of(_pings(spark, folder), crs={"init": "epsg:3857"}, parameters={"compress": {"spatial_radius_km": 0.4}}), path)
    back = files.read(spark, path)
    assert back.crs == {"init": "epsg:3857"} and back.parameters == {"compress": {"spatial_radius_km": 0.4}}
    return _told(back.df)


@_query(f"WITH {_ONCE} SELECT flow_id, origin, destination, flow::DOUBLE AS flow, epoch_us(datetime) AS us FROM f")
def csv_flows(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "csv")
    _once(spark, folder).select("flow_id", F.col("flow").alias("n"), F.col("origin").alias("from"), F.col("destination").alias("to"), F.unix_seconds(F.col("datetime").cast("timestamp")).alias("day")).write.csv(path, header=True)
    f = files.read_flows(spark, path, table(spark, folder, "tessellation"), "tile_id", "from", "to", flow="n", datetime="day", timestamp=True)
    return f.df.select(F.col("flow_id").cast("long").alias("flow_id"), "origin", "destination", "flow", micros("datetime").alias("us"))


@_query(f"WITH {_ONCE} SELECT origin, destination, sum(flow)::BIGINT AS flow, count(*) AS n FROM f WHERE flow > 100 GROUP BY ALL")
def flows_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "flows")
    files.write(Flows.of(_once(spark, folder), table(spark, folder, "tessellation"), tile_id="tile_id", parameters={"a": 1}), path)
    back = files.read(spark, path)
    assert back.parameters == {"a": 1} and back.tile_id == "tile_id"
    return back.where("flow > 100").df.groupBy("origin", "destination").agg(F.sum("flow").alias("flow"), F.count("*").alias("n"))


@_query(f"""WITH {_ONCE}, c AS (SELECT tile_id, geometry[1][1].y AS y, geometry[1][1].x AS x FROM tessellation)
 SELECT flow_id, a.y || ',' || a.x AS origin, b.y || ',' || b.x AS destination, flow::DOUBLE AS flow FROM f JOIN c a ON f.origin = a.tile_id JOIN c b ON f.destination = b.tile_id""")
def csv_flows_of_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Ends as coordinates and no tiles: every place is a tile of its own."""
    corner = table(spark, folder, "tessellation").select("tile_id", F.expr("geometry[0][0].y").alias("y"), F.expr("geometry[0][0].x").alias("x"))
    rows = _once(spark, folder).select("flow_id", "flow", "origin", "destination")
    for end in ("origin", "destination"):
        rows = rows.join(F.broadcast(corner), F.col(end) == F.col("tile_id")).drop("tile_id", end).withColumnsRenamed({"y": f"{end}_y", "x": f"{end}_x"})  # 400 tiles
    path = scratch(spark, "csv")
    rows.write.csv(path, header=True)
    f = files.read_flows(spark, path, origin_lat="origin_y", origin_lng="origin_x", destination_lat="destination_y", destination_lng="destination_x")
    return f.df.select(F.col("flow_id").cast("long").alias("flow_id"), "origin", "destination", "flow")


@_query("SELECT tile_id AS tile_ID, ring, i, p.x AS x, p.y AS y FROM (SELECT tile_id, ring - 1 AS ring, generate_subscripts(g, 1) - 1 AS i, unnest(g) AS p FROM (SELECT tile_id, generate_subscripts(geometry, 1) AS ring, unnest(geometry) AS g FROM tessellation))")
def geojson_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Tiles as GeoJSON features, read back with the ids they have there."""
    path = scratch(spark, "geojson")
    features = table(spark, folder, "tessellation").select(drawing.feature(F.col("geometry"), "tile_id").alias("f"))
    features.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", F.collect_list("f")), F.lit("]}"))).write.text(path)  # the fixed table of 400 tiles
    rows = files.read_geojson(spark, path, "tile_id")
    rows = rows.select(F.col("tile_ID").alias("t"), F.posexplode("geometry").alias("ring", "g")).select("t", "ring", F.posexplode("g").alias("i", "p"))
    return rows.select(F.col("t").alias("tile_ID"), F.col("ring").cast("long").alias("ring"), F.col("i").cast("long").alias("i"), "p.x", "p.y")


@_query("SELECT 'a' AS uid, lat, lng, epoch_us(datetime) AS us FROM privacy_toy WHERE lat IS NOT NULL AND lng IS NOT NULL AND datetime IS NOT NULL")
def gpx_points(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "gpx")
    rows = _pings(spark, folder).dropna(subset=["lat", "lng", "datetime"])
    point = F.format_string('<trkpt lat="%s" lon="%s"><time>%s</time></trkpt>', F.col("lat").cast("string"), F.col("lng").cast("string"), F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    def whole(batches):  # every file is a document of its own
        yield pa.record_batch([pa.array(["<gpx><trk><trkseg>"])], names=["value"])
        for b in batches:
            yield pa.record_batch([b.column(0)], names=["value"])
        yield pa.record_batch([pa.array(["</trkseg></trk></gpx>"])], names=["value"])

    rows.select(point.alias("value")).mapInArrow(whole, "value string").write.text(path)
    return files.read_gpx(spark, path, "a").df.select("uid", "lat", "lng", micros("datetime").alias("us"))


@_query("SELECT uid::VARCHAR AS uid, round(floor(lat * 1e7) / 1e7, 7) AS lat, round(floor(lng * 1e7) / 1e7, 7) AS lng, epoch_us(datetime) // 1000 * 1000 AS us FROM privacy_toy WHERE uid IS NOT NULL AND lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AND datetime IS NOT NULL AND ping_id % 50 < 40")
def timeline_points(spark: SparkSession, folder: str) -> DataFrame:
    """Location histories, one document per file; those reported as inaccurate are left out by the reader."""
    path = scratch(spark, "timeline")
    rows = _pings(spark, folder).where("uid is not null and datetime is not null and lat between -90 and 90 and lng between -180 and 180")
    one = F.to_json(F.struct(F.array(F.struct(F.floor(F.col("lat") * F.lit(1e7)).alias("latitudeE7"), F.floor(F.col("lng") * F.lit(1e7)).alias("longitudeE7"), F.floor(micros("datetime") / F.lit(1000)).cast("string").alias("timestampMs"), F.when(F.col("ping_id") % 50 < 40, 20).otherwise(900).alias("accuracy"))).alias("locations"), F.col("uid").cast("string").alias("who")))
    rows.select(one.alias("value")).write.text(path)
    # a line is a document here, and its owner one of its fields
    kind = "locations array<struct<latitudeE7:long,longitudeE7:long,timestampMs:string,accuracy:double>>, who string"
    t = files.timeline_of(spark.read.schema(kind).json(path), F.col("who"), min_accuracy_meters=100)
    return t.df.select("uid", F.round("lat", 7).alias("lat"), F.round("lng", 7).alias("lng"), micros("datetime").alias("us"))


@_query("SELECT column0 AS name, column1 AS data_type FROM (VALUES ('flow_foursquare_nyc', 'flow'), ('foursquare_nyc', 'trajectory'), ('nyc_boundaries', 'shape'), ('parking_san_francisco', 'auxiliar'), ('taxi_san_francisco', 'trajectory')) v(column0, column1)")
def dataset_catalog(spark: SparkSession, folder: str) -> DataFrame:
    rows = [(name, datasets.dataset_info(name)["data_type"]) for name in datasets.list_datasets()]
    return spark.createDataFrame(rows, "name string, data_type string")


@_query(f"WITH {TRAJ_SQL} SELECT uid::VARCHAR AS uid, lat, lng, epoch_us(date_trunc('second', datetime)) AS us FROM traj")
def dataset_checkins(spark: SparkSession, folder: str) -> DataFrame:
    """The catalog's check-ins: tab-separated, without header, times in words."""
    path = scratch(spark, "checkins")
    empty = F.lit("-")
    t = trajectories(spark, folder)
    t.select("uid", empty.alias("v"), empty.alias("c"), empty.alias("n"), "lat", "lng", F.lit("-240").alias("z"), F.date_format("datetime", "EEE MMM dd HH:mm:ss '+0000' yyyy")).write.csv(path, sep="\t")
    return datasets.load_dataset(spark, "foursquare_nyc", path, drop_columns=True).df.select("uid", "lat", "lng", micros("datetime").alias("us"))


@_query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name FROM supplier")
def dataset_parking(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "parking")
    table(spark, folder, "supplier").select("s_suppkey", "s_name").write.csv(path, header=True)
    return datasets.load_dataset(spark, "parking_san_francisco", path)


@_query(f"WITH {TRAJ_SQL} SELECT uid, round(lat, 6) AS lat, round(lng, 6) AS lng, epoch_us(datetime + INTERVAL 8 HOUR) AS us FROM traj")
def frame_timezone(spark: SparkSession, folder: str) -> DataFrame:
    t = Trajectories.of(trajectories(spark, folder)).convert_timezone("UTC", "Asia/Shanghai")
    return rounded(t.df.select("uid", "lat", "lng", micros("datetime").alias("us")))


_BOX_SQL = "SELECT min(p.x) AS min_lng, min(p.y) AS min_lat, max(p.x) AS max_lng, max(p.y) AS max_lat FROM (SELECT unnest(flatten(geometry)) AS p FROM tessellation)"


@_query(_BOX_SQL)
def area_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return spatial.area_bounds(table(spark, folder, "tessellation"))


@_query("SELECT tile_id, round(sum(radians(p.x) * 6378137.0::DOUBLE), 3) AS x, round(sum(6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(p.y) / 2))), 3) AS y FROM (SELECT tile_id, unnest(flatten(geometry)) AS p FROM tessellation) GROUP BY tile_id")
def tiles_in_metres(spark: SparkSession, folder: str) -> DataFrame:
    corners = spatial.to_web_mercator(table(spark, folder, "tessellation")).select("tile_id", F.explode(F.flatten("geometry")).alias("p"))
    return corners.groupBy("tile_id").agg(F.round(F.sum("p.x"), 3).alias("x"), F.round(F.sum("p.y"), 3).alias("y"))


@_query("SELECT tile_id, i - 1 AS i, p.x AS x, p.y AS y FROM (SELECT tile_id, generate_subscripts(geometry[1], 1) AS i, unnest(geometry[1]) AS p FROM tessellation WHERE tile_id = (SELECT min(tile_id) FROM tessellation))")
def flow_geometry(spark: SparkSession, folder: str) -> DataFrame:
    tiles = table(spark, folder, "tessellation")
    f = Flows(_once(spark, folder), tiles, "tile_id")
    found = f.get_geometry(tiles.agg(F.min("tile_id")).first()[0])
    return found.select("tile_id", F.posexplode(F.col("geometry")[0]).alias("i", "p")).select("tile_id", F.col("i").cast("long").alias("i"), "p.x", "p.y")


@_query("SELECT ping_id, round(lat + 30 / 60.0::DOUBLE + 36 / 3600.0::DOUBLE, 9) AS v FROM privacy_toy WHERE lat >= 0 UNION ALL SELECT ping_id, round(-(abs(lat) + 30 / 60.0::DOUBLE + 36 / 3600.0::DOUBLE), 9) FROM privacy_toy WHERE lat < 0")
def decimal_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return _pings(spark, folder).where("lat is not null").select("ping_id", F.round(geo.decimal_degrees("lat", F.lit(30.0), F.lit(36.0)), 9).alias("v"))


@_query("SELECT ping_id, round(2 / (1.852::DOUBLE * 60), 9) AS dlat, round(2 / (1.852::DOUBLE * 60) / cos(radians(lat)), 9) AS dlng FROM privacy_toy WHERE abs(lat) < 89")
def degree_offsets(spark: SparkSession, folder: str) -> DataFrame:
    dlat, dlng = geo.degree_offsets("lat", 2.0)
    return _pings(spark, folder).where("abs(lat) < 89").select("ping_id", F.round(dlat, 9).alias("dlat"), F.round(dlng, 9).alias("dlng"))


@_query("SELECT ping_id, round(6371.01::DOUBLE / 6371.0::DOUBLE * " + haversine_sql("lat", "lng", "40.0::DOUBLE", "-73.0::DOUBLE") + ", 6) AS km FROM privacy_toy WHERE lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180")
def haversine_radius(spark: SparkSession, folder: str) -> DataFrame:
    """Distances on a sphere of another radius."""
    rows = _pings(spark, folder).where("lat between -90 and 90 and lng between -180 and 180")
    return rows.select("ping_id", F.round(geo.haversine_km("lat", "lng", F.lit(40.0), F.lit(-73.0), 6371.01), 6).alias("km"))


@_query("SELECT strftime(datetime, '%Y%m%d%H') AS hour, strftime(datetime, '%Y%m') AS month, count(*) AS n FROM privacy_toy WHERE datetime >= TIMESTAMP '2005-01-01' AND datetime < TIMESTAMP '2036-01-01' GROUP BY ALL")
def time_precision(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("datetime")
    rows = _pings(spark, folder).where((t >= F.lit("2005-01-01").cast("timestamp")) & (t < F.lit("2036-01-01").cast("timestamp")))
    return rows.groupBy(time_bucket(t, "Hour").alias("hour"), time_bucket(t, "Month").alias("month")).agg(F.count("*").alias("n"))


@_query(f"WITH {TRAJ_SQL}, d AS (SELECT DISTINCT lat, lng FROM traj) SELECT (row_number() OVER (ORDER BY lat, lng) - 1)::VARCHAR AS tile_ID, round(lat, 6) AS lat, round(lng, 6) AS lng FROM d")
def point_tessellation(spark: SparkSession, folder: str) -> DataFrame:
    places = trajectories(spark, folder).select("lat", "lng").distinct()
    return rounded(tessellation.get("voronoi", places).select("tile_ID", "lat", "lng"))


@_query(f"WITH {TRAJ_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY datetime) - 1 AS i, count(*) OVER (PARTITION BY uid) AS n FROM traj) SELECT uid, epoch_us(datetime) AS us FROM r WHERE i % greatest(1, n // 20) = 0")
def drawn_points(spark: SparkSession, folder: str) -> DataFrame:
    """At most about 20 points of each individual, evenly along its time."""
    return drawing.every_nth(trajectories(spark, folder), 20).select("uid", micros("datetime").alias("us"))


@_query(f"WITH {TRAJ_SQL}, few AS (SELECT DISTINCT uid FROM traj ORDER BY uid LIMIT 10), r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY datetime) - 1 AS i, count(*) OVER (PARTITION BY uid) AS n FROM traj JOIN few USING (uid)) SELECT uid, count(*) AS n, round(sum(lat), 6) AS lat, round(sum(lng), 6) AS lng, epoch_us(min(datetime)) AS start_us, epoch_us(max(datetime)) AS end_us FROM r WHERE i % greatest(1, n // 30) = 0 GROUP BY uid")
def drawn_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = drawing.trajectory_lines(trajectories(spark, folder), max_points=30)
    total = lambda c: F.round(F.aggregate("line", F.lit(0.0), lambda a, p: a + p[c]), 6).alias(c)
    return lines.select("uid", F.size("line").cast("long").alias("n"), total("lat"), total("lng"), micros("start").alias("start_us"), micros("end").alias("end_us"))


@_query(f"WITH {TRAJ_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY datetime, uid, lat, lng) AS i, count(*) OVER () AS n FROM traj) SELECT greatest(1, ceil(any_value(n) / greatest(1, any_value(n) // 500)))::BIGINT AS n FROM r")
def heat_points(spark: SparkSession, folder: str) -> DataFrame:
    return drawing.heat_points(trajectories(spark, folder), 500).agg(F.count("*").alias("n"))


def _stops(spark: SparkSession, folder: str) -> DataFrame:
    return preprocess.cluster(preprocess.stay_locations(trajectories(spark, folder), minutes_for_a_stop=60, spatial_radius_km=2.5), 1.0)


@_query(f"WITH {TRAJ_SQL}, few AS (SELECT DISTINCT uid FROM traj ORDER BY uid LIMIT 10) SELECT uid, round(lat, 6) AS lat, round(lng, 6) AS lng, epoch_us(datetime) AS arrival_us, NULL::BIGINT AS leaving_us FROM traj JOIN few USING (uid)")
def stop_markers(spark: SparkSession, folder: str) -> DataFrame:
    m = drawing.stop_markers(trajectories(spark, folder))
    return rounded(m.select("uid", "lat", "lng", micros("arrival").alias("arrival_us"), F.col("leaving").cast("long").alias("leaving_us")))


@_query(f"WITH {TRAJ_SQL}, one AS (SELECT min(uid) AS uid FROM traj) SELECT epoch_us(datetime) AS start_us, epoch_us(datetime + INTERVAL 1 HOUR) AS end_us, user_hour AS cluster FROM (SELECT *, extract(hour FROM datetime)::BIGINT AS user_hour FROM traj JOIN one USING (uid)) WHERE datetime >= TIMESTAMP '2020-01-01'")
def diary_spans(spark: SparkSession, folder: str) -> DataFrame:
    t = trajectories(spark, folder).withColumns({"leaving_datetime": F.expr("datetime + interval 1 hour"), "cluster": F.hour("datetime").cast("long")})
    import datetime as dt

    spans = drawing.diary_spans(t, t.agg(F.min("uid")).first()[0], start=dt.datetime(2020, 1, 1))
    return spans.select(micros("start").alias("start_us"), micros("end").alias("end_us"), "cluster")


@_query(f"""WITH {_ONCE}, g AS (SELECT origin, destination, sum(flow)::BIGINT AS flow FROM f WHERE origin IS NOT NULL AND destination IS NOT NULL AND flow IS NOT NULL GROUP BY ALL), k AS (SELECT * FROM g WHERE origin <> destination AND flow >= 1000),
 r AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY flow DESC, destination) AS rank, avg(flow) OVER () AS mean FROM k)
 SELECT origin, destination, flow, rank, round(flow / mean, 6) AS weight, rank <= 10 AS in_popup FROM r""")
def flow_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = _once(spark, folder).dropna(subset=["flow", "origin", "destination"]).groupBy("origin", "destination").agg(F.sum("flow").alias("flow"))
    tiles = spatial.centroids(table(spark, folder, "tessellation")).withColumnRenamed("tile_id", "tile_ID")
    return rounded(drawing.flow_lines(rows, tiles, 1000).select("origin", "destination", "flow", "rank", "weight", "in_popup"))


@_query("SELECT tile_id, json_array_length(geometry)::BIGINT AS rings FROM (SELECT tile_id, to_json(geometry) AS geometry FROM tessellation ORDER BY tile_id LIMIT 50)")
def tile_features(spark: SparkSession, folder: str) -> DataFrame:
    """A map has room for so many features: the limit is its parameter."""
    f = drawing.tile_features(table(spark, folder, "tessellation").withColumnRenamed("tile_id", "tile_ID"), 50)
    made = F.from_json("feature", "type string, geometry struct<type:string,coordinates:array<array<array<double>>>>, properties struct<tile_ID:string>")
    return f.select(made.alias("f")).select(F.col("f.properties.tile_ID").alias("tile_id"), F.size("f.geometry.coordinates").cast("long").alias("rings"))


@_query(f"WITH {TRAJ_SQL}, c AS (SELECT uid, lat, lng, count(*) AS n FROM traj GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, lat, lng) AS rank FROM c) SELECT uid, round(lat, 6) AS lat, round(lng, 6) AS lng, n, rank FROM r WHERE rank <= 3")
def top_locations(spark: SparkSession, folder: str) -> DataFrame:
    t = collective.top_locations(trajectories(spark, folder), 3)
    return rounded(t.select("uid", "lat", "lng", "n", F.col("rank").cast("long").alias("rank")))


@_query(f"WITH {_ONCE} SELECT origin, destination, count(*) AS flow FROM f WHERE origin IS NOT NULL GROUP BY ALL")
def origin_destination_counts(spark: SparkSession, folder: str) -> DataFrame:
    return collective.origin_destination_counts(_once(spark, folder).where("origin is not null"))
