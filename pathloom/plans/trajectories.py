"""Trajectories from the event table, which has no positions: they are derived from whole numbers, the same way in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.session import table


def trajectories(spark: SparkSession, folder: str) -> DataFrame:
    """``uid``, ``datetime``, ``lat``, ``lng``: one row per event, on a grid of about a kilometre."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("uid"),
        F.col("ts").alias("datetime"),
        ((F.lit(3990) + F.col("user_id") % 5 + k % 7).cast("double") / F.lit(100.0)).alias("lat"),
        ((F.lit(11630) + F.col("user_id") % 3 + k % 4).cast("double") / F.lit(100.0)).alias("lng"),
    )


TRAJ_SQL = """traj AS (SELECT user_id AS uid, ts AS datetime,
 CAST(3990 + user_id % 5 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS DOUBLE) / CAST(100 AS DOUBLE) AS lat,
 CAST(11630 + user_id % 3 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS DOUBLE) / CAST(100 AS DOUBLE) AS lng FROM events)"""


def haversine_sql(a: str, b: str, c: str, d: str) -> str:
    s = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(CAST(12742 AS DOUBLE) * atan2(sqrt({s}), sqrt(CAST(1 AS DOUBLE) - {s})))"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded: sums depend on order in their last bits."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])
