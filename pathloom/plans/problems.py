"""Queries over the problem tables: name -> callable(spark, folder), and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators import faults, keyed, near, sessions, trips
from pathloom.operators.ordered import micros
from pathloom.session import table

#: Datetimes from the first up to but not including the second are plausible.
DATED = ("2005-01-01", "2036-01-01")


def dated_pings(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("datetime")
    return table(spark, folder, "privacy_toy").where(F.col("uid").isNotNull() & (t >= F.lit(DATED[0]).cast("timestamp")) & (t < F.lit(DATED[1]).cast("timestamp")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return keyed.heavy_keys(table(spark, folder, "privacy_toy")).select("uid")


def p2_key_summary(spark: SparkSession, folder: str) -> DataFrame:
    s = keyed.key_summary(table(spark, folder, "privacy_toy"))
    return s.select("uid", "n_rows", "n_placed", "lat_min", "lat_max", "lng_min", "lng_max", micros("first_time").alias("first_us"), micros("last_time").alias("last_us"), "first_lat", "first_lng", "last_lat", "last_lng")


def p2_path_measures(spark: SparkSession, folder: str) -> DataFrame:
    m = keyed.path_measures(dated_pings(spark, folder).where("lat between -90 and 90 and lng between -180 and 180"))
    return m.select("uid", "n", F.round("path_km", 4).alias("path_km"), F.round("longest_jump_km", 4).alias("longest_jump_km"), F.round("longest_wait_s", 4).alias("longest_wait_s"))


def p3_stops_and_trips(spark: SparkSession, folder: str) -> DataFrame:
    return trips.stops_and_trips(table(spark, folder, "privacy_toy")).select("kind", "uid", F.floor(F.col("start_us") / 1e6).alias("start_s"), F.floor(F.col("end_us") / 1e6).alias("end_s"), "duration_s", "n", "distance_km", "lat", "lng")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_stops_and_trips(spark, folder).select("kind", "uid", "start_s").distinct()


def p4_near_places(spark: SparkSession, folder: str) -> DataFrame:
    found = near.near_places(table(spark, folder, "privacy_toy"), table(spark, folder, "places"))
    return found.select("place_id", "ping_id", F.round("distance_m", 3).alias("distance_m")).distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_places(table(spark, folder, "privacy_toy"), table(spark, folder, "places")).select("place_id", "ping_id").distinct()


def p4_near_places_partitioned(spark: SparkSession, folder: str) -> DataFrame:
    """With both sides partitioned, as for places that are too many to send to every task."""
    found = near.near_places(table(spark, folder, "privacy_toy"), table(spark, folder, "places"), most_broadcast=0)
    return found.select("place_id", "ping_id", F.round("distance_m", 3).alias("distance_m")).distinct()


def p5_sessions(spark: SparkSession, folder: str) -> DataFrame:
    s = sessions.sessions(dated_pings(spark, folder), copies=["lat", "lng"])
    return s.select("uid", (F.col("start_us") / 1e6).cast("long").alias("start_s"), (F.col("end_us") / 1e6).cast("long").alias("end_s"), "duration_s", "n")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_sessions(spark, folder).select("uid", "start_s").distinct()


def p6_faults(spark: SparkSession, folder: str) -> DataFrame:
    return faults.faults(table(spark, folder, "privacy_toy")).select("ping_id", "uid", "kind")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_faults(spark, folder).select("ping_id").distinct()


_DATED_SQL = "FROM privacy_toy WHERE uid IS NOT NULL AND datetime >= TIMESTAMP '2005-01-01' AND datetime < TIMESTAMP '2036-01-01'"
_SESSIONS_SQL = f"""
WITH p AS (SELECT DISTINCT uid, datetime, lat, lng {_DATED_SQL}),
f AS (SELECT uid, datetime, CASE WHEN datetime - lag(datetime) OVER w <= INTERVAL 1800 SECOND THEN 0 ELSE 1 END AS fresh FROM p WINDOW w AS (PARTITION BY uid ORDER BY datetime)),
g AS (SELECT uid, datetime, sum(fresh) OVER (PARTITION BY uid ORDER BY datetime RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM f),
r AS (SELECT uid, s, min(epoch_us(datetime)) AS a, max(epoch_us(datetime)) AS b, count(*) AS n FROM g GROUP BY uid, s)
"""

_NEAR_SQL = """
WITH p AS (SELECT DISTINCT ping_id, lat AS y, lng AS x FROM privacy_toy WHERE lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180),
s AS (SELECT place_id, radius_m, lat, lng, radius_m / 1000 / 6371.0::DOUBLE AS r FROM places WHERE geometry IS NULL),
near AS (SELECT place_id, ping_id, 1000 * 2 * 6371.0::DOUBLE * asin(sqrt(least(1::DOUBLE, pow(sin(radians(y - lat) / 2), 2) + cos(radians(lat)) * cos(radians(y)) * pow(sin(radians(x - lng) / 2), 2)))) AS d, radius_m
 FROM p JOIN s ON y BETWEEN lat - degrees(r) AND lat + degrees(r)),
rings AS (SELECT place_id, generate_subscripts(geometry, 1) AS k, unnest(geometry) AS ring FROM places WHERE geometry IS NOT NULL),
corners AS (SELECT place_id, k, generate_subscripts(ring, 1) AS i, unnest(ring) AS c FROM rings),
edges AS (SELECT place_id, c.x AS x0, c.y AS y0, lead(c.x) OVER w AS x1, lead(c.y) OVER w AS y1 FROM corners WINDOW w AS (PARTITION BY place_id, k ORDER BY i)),
inside AS (SELECT place_id, ping_id FROM p JOIN edges ON x >= least(x0, x1) AND x < greatest(x0, x1) WHERE y0 + (x - x0) * ((y1 - y0) / (x1 - x0)) > y GROUP BY place_id, ping_id HAVING count(*) % 2 = 1),
found AS (SELECT place_id, ping_id, round(d, 3) AS distance_m FROM near WHERE d <= radius_m UNION ALL SELECT place_id, ping_id, NULL FROM inside)
"""

QUERIES = {f.__name__: f for f in (p2_found, p2_key_summary, p2_path_measures, p3_found, p3_stops_and_trips, p4_found, p4_near_places, p4_near_places_partitioned, p5_found, p5_sessions, p6_found, p6_faults)}

ORACLE = {
    "p2_found": "SELECT uid FROM privacy_toy WHERE uid IS NOT NULL GROUP BY uid HAVING count(*) >= 0.04 * (SELECT count(*) FROM privacy_toy)",
    "p2_key_summary": """
WITH p AS (SELECT uid, datetime, lat, lng, lat IS NOT NULL AND lng IS NOT NULL AND datetime IS NOT NULL AS ok FROM privacy_toy),
a AS (SELECT *, row_number() OVER (PARTITION BY uid, ok ORDER BY datetime, lat, lng) AS i, row_number() OVER (PARTITION BY uid, ok ORDER BY datetime DESC, lat, lng) AS j FROM p)
SELECT uid, count(*) AS n_rows, sum(CASE WHEN ok THEN 1 ELSE 0 END)::BIGINT AS n_placed, min(lat) AS lat_min, max(lat) AS lat_max, min(lng) AS lng_min, max(lng) AS lng_max,
 epoch_us(min(datetime)) AS first_us, epoch_us(max(datetime)) AS last_us,
 max(lat) FILTER (WHERE ok AND i = 1) AS first_lat, max(lng) FILTER (WHERE ok AND i = 1) AS first_lng, max(lat) FILTER (WHERE ok AND j = 1) AS last_lat, max(lng) FILTER (WHERE ok AND j = 1) AS last_lng
FROM a GROUP BY uid""",
    "p2_path_measures": f"""
WITH p AS (SELECT DISTINCT uid, datetime, lat, lng {_DATED_SQL} AND lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180),
q AS (SELECT *, lag(lat) OVER w AS la, lag(lng) OVER w AS lo, lag(datetime) OVER w AS t FROM p WINDOW w AS (PARTITION BY uid ORDER BY datetime, lat, lng)),
r AS (SELECT uid, (epoch_us(datetime) - epoch_us(t)) / 1e6::DOUBLE AS wait,
 2 * 6371.0::DOUBLE * asin(sqrt(least(1::DOUBLE, pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lng - lo) / 2), 2)))) * CASE WHEN la IS NULL THEN NULL ELSE 1 END AS d FROM q)
SELECT uid, count(*) AS n, round(coalesce(sum(d), 0), 4) AS path_km, round(coalesce(max(d), 0), 4) AS longest_jump_km, round(coalesce(max(wait), 0), 4) AS longest_wait_s FROM r GROUP BY uid""",
    "p4_found": f"{_NEAR_SQL} SELECT DISTINCT place_id, ping_id FROM found",
    "p4_near_places": f"{_NEAR_SQL} SELECT place_id, ping_id, distance_m FROM found",
    "p4_near_places_partitioned": f"{_NEAR_SQL} SELECT place_id, ping_id, distance_m FROM found",
    "p5_found": f"{_SESSIONS_SQL} SELECT DISTINCT uid, a // 1000000 AS start_s FROM r",
    "p5_sessions": f"{_SESSIONS_SQL} SELECT uid, a // 1000000 AS start_s, b // 1000000 AS end_s, (b - a) / 1e6::DOUBLE AS duration_s, n FROM r",
}
