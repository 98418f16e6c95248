"""What maps and diagrams are drawn from, as frames and GeoJSON features. Limits here are the feature: a map has room for so much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators.ordered import running


def every_nth(traj: DataFrame, most: int, keys: list[str] | None = None) -> DataFrame:
    """Of each group at most about ``most`` points, evenly along its time."""
    keys = keys if keys is not None else [c for c in ("uid",) if c in traj.columns]
    ranked = running(traj, [*keys, "datetime"], "_i")
    group = [F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)]
    sizes = ranked.groupBy(*group).agg(F.min("_i").alias("_least"), F.count("*").alias("_n"))
    same = F.lit(True)
    for j, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{j}"))
    ranked = ranked.join(sizes if keys else F.broadcast(sizes), same)  # without keys one row
    return ranked.where((F.col("_i") - F.col("_least")) % F.greatest(F.lit(1), F.floor(F.col("_n") / most)) == 0).select(*traj.columns)


def trajectory_lines(traj: DataFrame, max_users: int = 10, max_points: int = 1000) -> DataFrame:
    """``uid``, ``line`` (array of {lng, lat}), ``start``, ``end`` of the first ``max_users`` individuals."""
    some = traj.select("uid").distinct().orderBy("uid").limit(max_users)
    points = every_nth(traj.join(F.broadcast(some), "uid", "left_semi"), max_points)
    return points.groupBy("uid").agg(F.transform(F.sort_array(F.collect_list(F.struct("datetime", "lng", "lat"))), lambda p: F.struct(p["lng"].alias("lng"), p["lat"].alias("lat"))).alias("line"), F.min("datetime").alias("start"), F.max("datetime").alias("end"))


def heat_points(traj: DataFrame, max_points: int = 1000) -> DataFrame:
    return every_nth(traj, max_points, []).select("lat", "lng")


def stop_markers(stops: DataFrame, max_users: int = 10) -> DataFrame:
    """``uid``, ``lat``, ``lng``, ``arrival``, ``leaving``, ``cluster`` of the first individuals' stops."""
    some = stops.select("uid").distinct().orderBy("uid").limit(max_users)
    extra = [F.col(c) if c in stops.columns else F.lit(None).alias(c) for c in ("leaving_datetime", "cluster")]
    return stops.join(F.broadcast(some), "uid", "left_semi").select("uid", "lat", "lng", F.col("datetime").alias("arrival"), extra[0].alias("leaving"), extra[1])


def diary_spans(clustered: DataFrame, user, start=None, end=None) -> DataFrame:
    """``start``, ``end``, ``cluster`` of one individual's stops in a span of time; KeyError for an unknown individual."""
    own = clustered.where(F.col("uid") == user)
    if not own.limit(1).count():
        raise KeyError(user)
    rows = own.select(F.col("datetime").alias("start"), F.col("leaving_datetime").alias("end"), "cluster")
    if start is not None:
        rows = rows.where(F.col("start") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("end") <= F.lit(end))
    return rows.orderBy("start")


def flow_lines(flows: DataFrame, tiles: DataFrame, min_flow: float = 0, top: int = 10) -> DataFrame:
    """Flows between different tiles of at least ``min_flow``, with both centroids, ``weight`` (relative to the mean) and the rank among their
    origin's (``top`` of which a popup shows). ``tiles`` has tile_ID, lat, lng."""
    kept = flows.where((F.col("origin") != F.col("destination")) & (F.col("flow") >= min_flow))
    mean = kept.agg(F.avg("flow").alias("mean"))
    rank = F.row_number().over(Window.partitionBy("origin").orderBy(F.desc("flow"), "destination"))
    o, d = (tiles.select(F.col("tile_ID").alias(name), F.col("lat").alias(f"{name}_lat"), F.col("lng").alias(f"{name}_lng")) for name in ("origin", "destination"))
    out = kept.withColumn("rank", rank.cast("long")).join(o, "origin").join(d, "destination").crossJoin(F.broadcast(mean))  # one row
    return out.withColumns({"weight": F.col("flow") / F.col("mean"), "in_popup": F.col("rank") <= top}).drop("mean")


def feature(geometry: Column, *properties: str) -> Column:
    """A GeoJSON feature as text, from rings of {x, y}."""
    rings = F.transform(geometry, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties")))


def tile_features(tiles: DataFrame, most: int, *properties: str) -> DataFrame:
    return tiles.orderBy("tile_ID").limit(most).select(feature(F.col("geometry"), "tile_ID", *properties).alias("feature"))
