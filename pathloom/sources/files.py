"""Readers and writers of trajectories, flows and tiles."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.frames import Flows, Trajectories
from pathloom.operators import spatial
from pathloom.schema import GEOMETRY


def read_trajectories(spark: SparkSession, path: str, latitude="lat", longitude="lng", datetime="datetime", user_id="uid", trajectory_id="tid", columns: list[str] | None = None, header: bool = True, sep: str = ",", encoding: str = "UTF-8", timestamp: bool = False, crs: dict | None = None, parameters: dict | None = None) -> Trajectories:
    """From CSV files (also compressed). ``columns`` prunes the scan. Without a header the columns are given as positions ("0", "1", ...)."""
    df = spark.read.csv(path, header=header, sep=sep, encoding=encoding)
    if not header:
        df = df.toDF(*[str(i) for i in range(len(df.columns))])
    if columns:
        df = df.select(*[str(c) for c in columns])
    return Trajectories.of(df, spark, latitude, longitude, datetime, user_id, trajectory_id, timestamp, crs, {"from_file": path, **(parameters or {})})


def read_flows(spark: SparkSession, path: str, tiles: DataFrame | None = None, tile_id: str = "tile_ID", origin="origin", destination="destination", origin_lat=None, origin_lng=None, destination_lat=None, destination_lng=None, flow="flow", datetime="datetime", header: bool = True, sep: str = ",", encoding: str = "UTF-8", timestamp: bool = False, remove_na: bool = False) -> Flows:
    """From CSV files with ids of tiles, or with coordinates of both ends: those are mapped to ``tiles``, or if there are none, every
    distinct place becomes a point tile."""
    df = spark.read.csv(path, header=header, sep=sep, encoding=encoding)
    if not header:
        df = df.toDF(*[str(i) for i in range(len(df.columns))])
    df = df.withColumn(flow, F.col(flow).cast("double"))
    ends = [(origin_lat, origin_lng, "origin"), (destination_lat, destination_lng, "destination")]
    if origin_lat is not None:
        for a, b, _ in ends:
            df = df.withColumns({a: F.col(a).cast("double"), b: F.col(b).cast("double")})
        if tiles is None:
            places = df.select(F.col(origin_lat).alias("lat"), F.col(origin_lng).alias("lng")).union(df.select(destination_lat, destination_lng)).dropna().distinct()
            tiles, tile_id = places.withColumn("tile_ID", F.concat_ws(",", "lat", "lng")), "tile_ID"
        for a, b, name in ends:
            if "geometry" in tiles.columns:
                df = spatial.map_to_tiles(df, tiles, tile_id, remove_na, lat=a, lng=b)
            else:
                df = spatial.nearest_tile(df, tiles, tile_id, lat=a, lng=b)
            df = df.drop(name).withColumnRenamed("tile_ID", name)
            df = df.where(F.col(name).isNotNull()) if remove_na else df
        origin, destination = "origin", "destination"
    return Flows.of(df, tiles, origin, destination, flow, datetime, tile_id, timestamp, {"from_file": path})


def write(frame: Trajectories | Flows, path: str) -> None:
    """As Parquet in ``path``/data (and ``path``/tiles), with what else the frame knows in ``path``/meta."""
    spark = frame.df.sparkSession
    frame.df.write.mode("overwrite").parquet(f"{path}/data")
    meta = {"kind": type(frame).__name__, "parameters": frame.parameters}
    if isinstance(frame, Flows):
        frame.tiles.write.mode("overwrite").parquet(f"{path}/tiles")
        meta["tile_id"] = frame.tile_id
    else:
        meta["crs"] = frame.crs
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read(spark: SparkSession, path: str) -> Trajectories | Flows:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    df = spark.read.parquet(f"{path}/data")
    if meta["kind"] == "Flows":
        return Flows(df, spark.read.parquet(f"{path}/tiles"), meta["tile_id"], meta["parameters"])
    return Trajectories(df, meta["crs"], meta["parameters"])


def read_gpx(spark: SparkSession, path: str, user_id=None) -> Trajectories:
    """Track points of GPX files."""
    kind = T.StructType([T.StructField("_lat", T.DoubleType()), T.StructField("_lon", T.DoubleType()), T.StructField("time", T.StringType())])
    df = spark.read.format("xml").option("rowTag", "trkpt").schema(kind).load(path)
    df = df.select(F.to_timestamp("time").cast("timestamp_ntz").alias("datetime"), F.col("_lon").alias("lng"), F.col("_lat").alias("lat"))
    return Trajectories.of(df.withColumn("uid", F.lit(user_id)) if user_id is not None else df)


def read_plt(spark: SparkSession, path: str, user_ids: list[str] | None = None, filter_kwargs: dict | None = None, compress_kwargs: dict | None = None) -> Trajectories:
    """Logs ``Data/<uid>/Trajectory/*.plt`` below ``path``: lines lat, lng, 0, altitude, days, date, time; the lines at the head have
    no such form. The individual is the name of the folder; ``user_ids`` limits the folders that are read."""
    who = "{" + ",".join(user_ids) + "}" if user_ids else "*"
    lines = spark.read.text(f"{path}/Data/{who}/Trajectory/*.plt").select("value", F.col("_metadata.file_path").alias("file"))
    form = r"^([-\d.]+),([-\d.]+),[^,]*,[^,]*,[^,]*,(\d{4}-\d{2}-\d{2}),(\d{2}:\d{2}:\d{2})\s*$"
    part = lambda i: F.regexp_extract("value", form, i)
    rows = lines.where(F.col("value").rlike(form)).select(part(1).cast("double").alias("lat"), part(2).cast("double").alias("lng"), F.concat_ws(" ", part(3), part(4)).cast("timestamp_ntz").alias("datetime"), F.regexp_extract("file", r"/Data/([^/]+)/Trajectory/", 1).alias("uid"))
    return Trajectories.of(rows).filter(**(filter_kwargs or {"max_speed_kmh": 400.0})).compress(**(compress_kwargs or {"spatial_radius_km": 0.2}))


def read_timeline(spark: SparkSession, path: str, user_id=None, min_accuracy_meters: float | None = None) -> Trajectories:
    """Location histories as JSON: ``locations`` with latitudeE7, longitudeE7, timestampMs and accuracy."""
    kind = "locations array<struct<latitudeE7:long,longitudeE7:long,timestampMs:string,accuracy:double>>"
    return timeline_of(spark.read.schema(kind).option("multiLine", True).json(path), None if user_id is None else F.lit(user_id), min_accuracy_meters)


def timeline_of(documents: DataFrame, user: Column | None = None, min_accuracy_meters: float | None = None) -> Trajectories:
    """From documents that were read before, for instance one a line: ``user`` tells whose each is."""
    rows = documents.select(F.explode("locations").alias("l"), *([user.alias("uid")] if user is not None else []))
    if min_accuracy_meters is not None:
        rows = rows.where(F.col("l.accuracy") < min_accuracy_meters)
    own = ["uid"] if user is not None else []
    df = rows.select(*own, F.timestamp_millis(F.col("l.timestampMs").cast("long")).cast("timestamp_ntz").alias("datetime"), (F.col("l.latitudeE7") / 1e7).alias("lat"), (F.col("l.longitudeE7") / 1e7).alias("lng"))
    return Trajectories.of(df)


def read_geojson(spark: SparkSession, path: str, tile_id: str | None = None) -> DataFrame:
    """Features of a GeoJSON collection: their properties, and ``geometry`` as rings of {x, y} (those of all parts together).

    ``tile_id`` names the property that becomes ``tile_ID``; without it features are numbered by their text.
    """
    reader = spark.read.option("multiLine", True)
    found = reader.json(path).schema["features"].dataType.elementType
    shape = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])  # coordinates as text: their depth differs
    kind = T.StructType([T.StructField("features", T.ArrayType(T.StructType([f for f in found.fields if f.name == "properties"] + [T.StructField("geometry", shape)])))])
    raw = reader.schema(kind).json(path).select(F.explode("features").alias("f"))
    shape = F.col("f.geometry.coordinates")
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    polygon = F.transform(F.from_json(shape, "array<array<array<double>>>"), lambda r: F.transform(r, point))
    multi = F.transform(F.flatten(F.from_json(shape, "array<array<array<array<double>>>>")), lambda r: F.transform(r, point))
    geometry = F.when(F.col("f.geometry.type") == "MultiPolygon", multi).when(F.col("f.geometry.type") == "Polygon", polygon).cast(GEOMETRY)
    names = raw.select("f.properties.*").columns
    df = raw.select(*[F.col(f"f.properties.`{c}`").alias(c) for c in names], geometry.alias("geometry"))
    return df.withColumn("tile_ID", F.col(tile_id).cast("string") if tile_id else F.sha1(F.to_json(F.struct("*"))))
