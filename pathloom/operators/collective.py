"""Measures of places and populations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.geo import haversine_km
from pathloom.operators.individual import home_location
from pathloom.operators.ordered import micros
from pathloom.schema import user_keys


def _users(traj: DataFrame) -> DataFrame:
    return traj if user_keys(traj) else traj.withColumn("uid", F.lit(0))


def random_location_entropy(traj: DataFrame) -> DataFrame:
    """Of each location the binary logarithm of the number of its visitors."""
    pairs = _users(traj).groupBy("lat", "lng", "uid").agg(F.count("*").alias("n"))
    return pairs.groupBy("lat", "lng").agg(F.log2(F.count("*")).alias("random_location_entropy"))


def uncorrelated_location_entropy(traj: DataFrame, normalize: bool = False) -> DataFrame:
    """Of each location the entropy (natural logarithm) of its visitors' shares; normalized by the binary logarithm of their number."""
    pairs = _users(traj).groupBy("lat", "lng", "uid").agg(F.count("*").alias("n"))
    # -sum p ln p = ln N - (sum n ln n) / N, one pass without a window over a location's visitors
    e = F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")
    out = pairs.groupBy("lat", "lng").agg(e.alias("e"), F.count("*").alias("m"))
    if normalize:
        return out.select("lat", "lng", F.when(F.col("m") > 1, F.col("e") / F.log2("m")).otherwise(F.lit(0.0)).alias("norm_uncorrelated_location_entropy"))
    return out.select("lat", "lng", F.when(F.col("m") > 1, F.col("e")).otherwise(F.lit(0.0)).alias("uncorrelated_location_entropy"))


def mean_square_displacement(traj: DataFrame, days: int = 0, hours: int = 1, minutes: int = 0) -> DataFrame:
    """One row: the mean over individuals of the squared distance (km) from their first position to the last within the time given."""
    span = (days * 86_400 + hours * 3600 + minutes * 60) * 1_000_000
    rows = _users(traj).where("uid is not null and lat is not null and lng is not null").select("uid", micros("datetime").alias("us"), "lat", "lng")
    first = rows.groupBy("uid").agg(F.min(F.struct("us", "lat", "lng")).alias("a"))
    late = rows.join(first, "uid").where(F.col("us") <= F.col("a.us") + span)
    last = late.groupBy("uid").agg(F.max(F.struct("us", "lat", "lng")).alias("b"), F.min("a").alias("a"))
    d = haversine_km(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng"))
    return last.agg(F.avg(d * d).alias("mean_square_displacement"))


def visits_per_location(traj: DataFrame) -> DataFrame:
    """``lat``, ``lng``, ``n_visits`` (rows with a datetime), the most first."""
    return traj.groupBy("lat", "lng").agg(F.count("datetime").alias("n_visits")).orderBy(F.desc("n_visits"), "lat", "lng")


def homes_per_location(traj: DataFrame, start_night: str = "22:00", end_night: str = "07:00") -> DataFrame:
    """``lat``, ``lng``, ``n_homes``: for how many a location is home."""
    homes = home_location(_users(traj), start_night, end_night)
    return homes.groupBy("lat", "lng").agg(F.count("*").alias("n_homes")).orderBy(F.desc("n_homes"), "lat", "lng")


def visits_per_time_unit(traj: DataFrame, time_unit: str = "1 hour") -> DataFrame:
    """``slot`` (its start), ``n_visits``: rows by tumbling window from the first to the last, empty ones included."""
    counts = traj.where("datetime is not null").groupBy(F.window("datetime", time_unit)["start"].alias("slot")).agg(F.count("*").alias("n"))
    span = counts.agg(F.min("slot").alias("a"), F.max("slot").alias("b")).where("a is not null")
    slots = span.select(F.explode(F.expr(f"sequence(a, b, interval {time_unit})")).alias("slot"))
    return slots.join(counts, "slot", "left").select("slot", F.coalesce("n", F.lit(0)).alias("n_visits"))


def origin_destination_counts(pairs: DataFrame) -> DataFrame:
    """Counts of (origin, destination) pairs."""
    return pairs.groupBy("origin", "destination").agg(F.count("*").alias("flow"))


def top_locations(traj: DataFrame, k: int) -> DataFrame:
    """The ``k`` most visited locations of each individual."""
    keys = user_keys(traj)
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(F.desc("n"), "lat", "lng")
    v = traj.groupBy(*keys, "lat", "lng").agg(F.count("*").alias("n"))
    return v.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
