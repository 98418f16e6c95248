"""Queries for the measures of individuals, of places and of two columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.geo import haversine_km
from pathloom.operators import collective as c
from pathloom.operators import evaluation as g
from pathloom.operators import individual as i
from pathloom.operators.ordered import micros
from pathloom.plans.trajectories import TRAJ_SQL, haversine_sql, rounded, trajectories
from pathloom.session import table

QUERIES: dict = {}
ORACLE: dict = {}


PINGS_SQL = "traj AS (SELECT uid, datetime, lat, lng FROM privacy_toy WHERE uid IS NOT NULL AND datetime >= TIMESTAMP '2005-01-01' AND datetime < TIMESTAMP '2036-01-01' AND lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180)"
#: Measures that are also taken of the pings: copies, late ones, 180 degrees and heavy individuals.
_OF_PINGS = ("radius_of_gyration", "number_of_locations", "random_entropy", "uncorrelated_entropy", "maximum_distance", "distance_straight_line", "number_of_visits", "home_location", "max_distance_from_home", "individual_mobility_network", "frequency_rank", "recency_rank", "random_location_entropy", "visits_per_location", "homes_per_location", "visits_per_time_unit")


def _pings(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("datetime")
    rows = table(spark, folder, "privacy_toy").where((t >= F.lit("2005-01-01").cast("timestamp")) & (t < F.lit("2036-01-01").cast("timestamp")))
    return rows.where("uid is not null and lat between -90 and 90 and lng between -180 and 180").select("uid", "datetime", "lat", "lng")


def _told(df: DataFrame) -> DataFrame:
    """Values rounded, positions as they are."""
    at = [c for c in df.columns if c.startswith(("lat", "lng"))]
    kept = rounded(df.select(*[c for c in df.columns if c not in at], *[F.struct(c).alias(c) for c in at]), 4)
    return kept.select(*[F.col(f"{c}.{c}") if c in at else F.col(c) for c in kept.columns])


def _over_trajectories(name: str, measure, sql: str | None) -> None:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(measure(trajectories(spark, folder)))

    if name in _OF_PINGS:
        # sums of great size depend on order in more of their digits
        QUERIES[f"pings_{name}"] = lambda spark, folder: _told(measure(_pings(spark, folder)))
        ORACLE[f"pings_{name}"] = f"WITH {PINGS_SQL}, vis AS (SELECT uid, lat, lng, count(*) AS n, min(datetime) AS first, max(datetime) AS last FROM traj GROUP BY ALL), {_STEPS} " + re.sub(r"round\((lat|lng|la|lo), 6\)", r"\1", sql).replace(", 6)", ", 4)")

    QUERIES[name] = query
    if sql:
        ORACLE[name] = f"WITH {TRAJ_SQL}, vis AS (SELECT uid, lat, lng, count(*) AS n, min(datetime) AS first, max(datetime) AS last FROM traj GROUP BY ALL), {_STEPS} {sql}"


_H = haversine_sql
_STEPS = f"""prv AS (SELECT *, lag(lat) OVER w AS la, lag(lng) OVER w AS lo, lag(datetime) OVER w AS t FROM traj WINDOW w AS (PARTITION BY uid ORDER BY datetime, lat, lng)),
step AS (SELECT *, {_H("la", "lo", "lat", "lng")} AS d FROM prv)"""
_RG = f"""SELECT uid, round(sqrt(sum(n * pow({_H("lat", "lng", "y", "x")}, 2)) / sum(n)), 6) AS {{0}} FROM (SELECT v.*, y, x FROM {{1}} v JOIN (SELECT uid, sum(lat * n) / sum(n) AS y, sum(lng * n) / sum(n) AS x FROM {{1}} GROUP BY uid) c USING (uid)) GROUP BY uid"""
_NIGHT = "(CAST(datetime AS TIME) >= TIME '22:00:00' OR CAST(datetime AS TIME) <= TIME '07:00:00')"
_HOME = f"""SELECT uid, lat, lng FROM (SELECT uid, lat, lng, row_number() OVER (PARTITION BY uid ORDER BY night DESC, CASE WHEN night > 0 THEN 0 ELSE n END DESC, lat, lng) AS r
 FROM (SELECT uid, lat, lng, count(*) AS n, sum(CASE WHEN {_NIGHT} THEN 1 ELSE 0 END) AS night FROM traj GROUP BY ALL)) WHERE r = 1"""


def haversine(spark: SparkSession, folder: str) -> DataFrame:
    t = trajectories(spark, folder)
    return rounded(t.select("uid", micros("datetime").alias("us"), haversine_km(F.col("lat"), F.col("lng"), F.lit(39.9), F.lit(116.3)).alias("km")))


QUERIES["haversine"] = haversine
ORACLE["haversine"] = f"WITH {TRAJ_SQL} SELECT uid, epoch_us(datetime) AS us, round({_H('lat', 'lng', 'CAST(39.9 AS DOUBLE)', 'CAST(116.3 AS DOUBLE)')}, 6) AS km FROM traj"


def _us(df: DataFrame) -> DataFrame:
    return df.withColumn("us", micros("datetime")).drop("datetime")


_over_trajectories("radius_of_gyration", i.radius_of_gyration, _RG.format("radius_of_gyration", "vis"))
_over_trajectories("k_radius_of_gyration", lambda t: i.k_radius_of_gyration(t, 2).withColumnRenamed("2k_radius_of_gyration", "k2_radius_of_gyration"), _RG.format("k2_radius_of_gyration", "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, first, lat, lng) AS r FROM vis) WHERE r <= 2)"))
_over_trajectories("number_of_locations", i.number_of_locations, "SELECT uid, count(*) AS number_of_locations FROM vis GROUP BY uid")
_over_trajectories("random_entropy", i.random_entropy, "SELECT uid, round(log2(count(*)), 6) AS random_entropy FROM vis GROUP BY uid")
_P = "(SELECT uid, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY uid) AS p FROM vis)"
_over_trajectories("uncorrelated_entropy", i.uncorrelated_entropy, f"SELECT uid, round(CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) ELSE 0 END, 6) AS uncorrelated_entropy FROM {_P} GROUP BY uid")
_over_trajectories("norm_uncorrelated_entropy", lambda t: i.uncorrelated_entropy(t, normalize=True), f"SELECT uid, round(CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) / log2(count(*)) ELSE 0 END, 6) AS norm_uncorrelated_entropy FROM {_P} GROUP BY uid")
# Each location as one character, so that a match is a substring: the longest known one at i, plus one (one more if it reaches the end).
_over_trajectories("real_entropy", i.real_entropy, """, loc AS (SELECT uid, lat, lng, chr((200 + row_number() OVER (PARTITION BY uid ORDER BY lat, lng))::INTEGER) AS c FROM vis),
 seq AS (SELECT uid, string_agg(c, '' ORDER BY datetime, lat, lng) AS s, count(*) AS n FROM traj JOIN loc USING (uid, lat, lng) GROUP BY uid),
 pos AS (SELECT uid, s, n, unnest(range(1, n - 1)) AS i FROM seq),
 hit AS (SELECT uid, n, i, coalesce(max(m), 0) AS m FROM (SELECT uid, n, i, unnest(range(0, least(i, n - i) + 1)) AS m, s FROM pos) WHERE contains(s[1:i], s[i + 1:i + m]) GROUP BY ALL),
 tot AS (SELECT uid, sum(CASE WHEN i + m + 1 < n THEN m + 1 ELSE n - i + 1 END) AS t FROM hit GROUP BY uid)
 SELECT uid, round(CASE WHEN n < 2 THEN 0 ELSE n * log2(n) / (3 + coalesce(t, 0)) END, 6) AS real_entropy FROM seq LEFT JOIN tot USING (uid)""")
_over_trajectories("jump_lengths", lambda t: _us(i.jumps(t)), "SELECT uid, epoch_us(datetime) AS us, round(d, 6) AS jump_length FROM step WHERE t IS NOT NULL")
_over_trajectories("maximum_distance", i.maximum_distance, "SELECT uid, round(coalesce(max(d), 'NaN'::DOUBLE), 6) AS maximum_distance FROM step GROUP BY uid")
_over_trajectories("distance_straight_line", i.distance_straight_line, "SELECT uid, round(coalesce(sum(d), 0), 6) AS distance_straight_line FROM step GROUP BY uid")
_over_trajectories("waiting_times", lambda t: _us(i.waits(t)), "SELECT uid, epoch_us(datetime) AS us, round(CAST((epoch_us(datetime) - epoch_us(t)) // 1000000 AS DOUBLE), 6) AS waiting_time FROM step WHERE t IS NOT NULL")
_over_trajectories("number_of_visits", i.number_of_visits, "SELECT uid, count(*) AS number_of_visits FROM traj GROUP BY uid")
_over_trajectories("home_location", i.home_location, _HOME.replace("SELECT uid, lat, lng FROM", "SELECT uid, round(lat, 6) AS lat, round(lng, 6) AS lng FROM", 1))
_over_trajectories("max_distance_from_home", i.max_distance_from_home, f"SELECT uid, round(max({_H('v.lat', 'v.lng', 'h.lat', 'h.lng')}), 6) AS max_distance_from_home FROM vis v JOIN ({_HOME}) h USING (uid) GROUP BY uid")
_over_trajectories("location_frequency", i.location_frequency, "SELECT uid, round(lat, 6) AS lat, round(lng, 6) AS lng, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY uid), 6) AS location_frequency FROM vis")
_over_trajectories("location_frequency_ranks", lambda t: i.location_frequency(t, as_ranks=True), "SELECT rank, round(avg(f), 6) AS location_frequency FROM (SELECT CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY uid) AS f, row_number() OVER (PARTITION BY uid ORDER BY n DESC, lat, lng) AS rank FROM vis) GROUP BY rank")
_over_trajectories("individual_mobility_network", i.individual_mobility_network, "SELECT uid, round(la, 6) AS lat_origin, round(lo, 6) AS lng_origin, round(lat, 6) AS lat_dest, round(lng, 6) AS lng_dest, count(*) AS n_trips FROM step WHERE t IS NOT NULL AND (la <> lat OR lo <> lng) GROUP BY ALL")
_over_trajectories("recency_rank", i.recency_rank, "SELECT uid, round(lat, 6) AS lat, round(lng, 6) AS lng, row_number() OVER (PARTITION BY uid ORDER BY last DESC, lat, lng) AS recency_rank FROM vis")
_over_trajectories("frequency_rank", i.frequency_rank, "SELECT uid, round(lat, 6) AS lat, round(lng, 6) AS lng, row_number() OVER (PARTITION BY uid ORDER BY n DESC, lat, lng) AS frequency_rank FROM vis")
_over_trajectories("frequency_vector", i.frequency_vector, "SELECT uid, round(lat, 6) AS lat, round(lng, 6) AS lng, n AS freq FROM vis")
_over_trajectories("probability_vector", i.probability_vector, "SELECT uid, round(lat, 6) AS lat, round(lng, 6) AS lng, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY uid), 6) AS prob FROM vis")

_over_trajectories("random_location_entropy", c.random_location_entropy, "SELECT round(lat, 6) AS lat, round(lng, 6) AS lng, round(log2(count(*)), 6) AS random_location_entropy FROM vis GROUP BY lat, lng")
_L = "(SELECT lat, lng, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY lat, lng) AS p FROM vis)"
_over_trajectories("uncorrelated_location_entropy", c.uncorrelated_location_entropy, f"SELECT round(lat, 6) AS lat, round(lng, 6) AS lng, round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) ELSE 0 END, 6) AS uncorrelated_location_entropy FROM {_L} GROUP BY lat, lng")
_over_trajectories("norm_uncorrelated_location_entropy", lambda t: c.uncorrelated_location_entropy(t, normalize=True), f"SELECT round(lat, 6) AS lat, round(lng, 6) AS lng, round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / log2(count(*)) ELSE 0 END, 6) AS norm_uncorrelated_location_entropy FROM {_L} GROUP BY lat, lng")
_over_trajectories(
    "mean_square_displacement",
    lambda t: c.mean_square_displacement(t, days=1),
    f"""SELECT round(avg(pow({_H("y0", "x0", "y1", "x1")}, 2)), 6) AS mean_square_displacement FROM (SELECT uid, arg_min(lat, datetime) AS y0, arg_min(lng, datetime) AS x0, arg_max(lat, datetime) FILTER (WHERE datetime <= t0 + INTERVAL 25 HOUR) AS y1, arg_max(lng, datetime) FILTER (WHERE datetime <= t0 + INTERVAL 25 HOUR) AS x1
 FROM (SELECT *, min(datetime) OVER (PARTITION BY uid) AS t0 FROM traj) GROUP BY uid)""",
)
_over_trajectories("visits_per_location", c.visits_per_location, "SELECT round(lat, 6) AS lat, round(lng, 6) AS lng, count(datetime) AS n_visits FROM traj GROUP BY lat, lng")
_over_trajectories("homes_per_location", c.homes_per_location, f"SELECT round(lat, 6) AS lat, round(lng, 6) AS lng, count(*) AS n_homes FROM ({_HOME}) GROUP BY lat, lng")
_over_trajectories(
    "visits_per_time_unit",
    lambda t: c.visits_per_time_unit(t, "1 hour").select(micros("slot").alias("slot_us"), "n_visits"),
    """SELECT epoch_us(s) AS slot_us, coalesce(n, 0) AS n_visits FROM (SELECT unnest(generate_series(min(date_trunc('hour', datetime)), max(date_trunc('hour', datetime)), INTERVAL 1 HOUR)) AS s FROM traj)
 LEFT JOIN (SELECT date_trunc('hour', datetime) AS s, count(*) AS n FROM traj GROUP BY ALL) USING (s)""",
)


def _pair(spark: SparkSession, folder: str) -> DataFrame:
    """Truth and prediction: quantity and a tenth of the price in thousands, from the line items."""
    return table(spark, folder, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("t"), (F.col("l_extendedprice").cast("double") / F.lit(1500.0)).alias("p"))


_PAIR_SQL = "pair AS (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS t, CAST(l_extendedprice AS DOUBLE) / CAST(1500 AS DOUBLE) AS p FROM lineitem)"


def _over_pair(name: str, measure, sql: str) -> None:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(measure(_pair(spark, folder), "t", "p"))

    QUERIES[name] = query
    ORACLE[name] = f"WITH {_PAIR_SQL} {sql}"


_over_pair("common_part_of_commuters", g.common_part_of_commuters, "SELECT round(2 * sum(least(t, p)) / sum(t + p), 6) AS common_part_of_commuters FROM pair")
_over_pair("common_part_of_links", g.common_part_of_links, "SELECT round(2 * sum(CASE WHEN t > 0 AND p > 0 THEN 1 ELSE 0 END) / CAST(sum(CASE WHEN t > 0 THEN 1 ELSE 0 END + CASE WHEN p > 0 THEN 1 ELSE 0 END) AS DOUBLE), 6) AS common_part_of_links FROM pair")
_over_pair(
    "cpc_distance",
    g.common_part_of_commuters_distance,
    """, m AS (SELECT greatest(CAST(ceil(max(greatest(t, p)) / 2) AS BIGINT) - 1, 0) AS last, sum(t) AS total FROM pair),
 v AS (SELECT t AS v, 1 AS one FROM pair UNION ALL SELECT p, 0 FROM pair),
 b AS (SELECT CASE WHEN v = 2 * last THEN last - 1 ELSE floor(v / 2) END AS bin, sum(one) AS a, sum(1 - one) AS b FROM v, m WHERE v >= 0 AND v <= 2 * last AND last > 0 GROUP BY ALL)
 SELECT round((SELECT CAST(sum(least(a, b)) AS DOUBLE) FROM b) / (SELECT total FROM m), 6) AS common_part_of_commuters_distance""",
)
_over_pair("r_squared", g.r_squared, "SELECT round(1 - sum(pow(t - p, 2)) / (var_pop(t) * count(*)), 6) AS r_squared FROM pair")
_over_pair("mse", g.mse, "SELECT round(avg(pow(t - p, 2)), 6) AS mse FROM pair")
_over_pair("rmse", g.rmse, "SELECT round(sqrt(avg(pow(t - p, 2))), 6) AS rmse FROM pair")
_over_pair("nrmse", lambda d, t, p: g.nrmse(d, t, p, ["l_returnflag"]), "SELECT l_returnflag, round(sqrt(avg(pow(t - p, 2))) / sum(t), 6) AS nrmse FROM pair GROUP BY ALL")
_over_pair("information_gain", g.information_gain, "SELECT round(sum(t * ln(t / p)) / sum(t), 6) AS information_gain FROM pair WHERE t > 0 AND p > 0")
_over_pair("pearson", g.pearson_correlation, "SELECT round(corr(t, p), 6) AS pearson_correlation, count(*) AS n FROM pair")
_over_pair("spearman", g.spearman_correlation, "SELECT round(corr(a, b), 6) AS spearman_correlation, count(*) AS n FROM (SELECT rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0 AS a, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS b FROM pair)")
_over_pair("kl_divergence", g.kullback_leibler_divergence, "SELECT round(sum(t / (SELECT sum(t) FROM pair) * ln((t / (SELECT sum(t) FROM pair)) / (p / (SELECT sum(p) FROM pair)))), 6) AS kullback_leibler_divergence FROM pair")
_over_pair("max_error", g.max_error, "SELECT round(max(t - p), 6) AS max_error FROM pair")
