"""Queries of this subpackage: name -> callable(spark, folder), and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import languages, leaks, packing, quantiles, runs
from pathloom.session import table


WANTED = [0.05, 0.25, 0.5, 0.75, 0.95]


def p1_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Of each origin, destination and day, copies counted once; those of origins are put together from the sketches of their months."""
    once = table(spark, folder, "ny_commuting_flows_2011").where("flow is not null").dropDuplicates(["flow_id"])
    day = F.col("datetime").cast("date")
    of = lambda kind, key, month: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), month.alias("month"))
    none = F.lit(None).cast("date")
    kinds = F.array(of("origin", F.col("origin"), F.trunc(day, "month")), of("destination", F.col("destination"), none), of("day", day, none))
    rows = once.select("flow", F.explode(kinds).alias("of")).select("of.*", "flow")
    found = quantiles.percentiles(quantiles.sketch(rows, ["kind", "key", "month"], "flow"), ["kind", "key"], WANTED)
    return found.select("kind", "key", "n", *[F.col("percentiles")[i].alias(f"p{round(100 * q):02d}") for i, q in enumerate(WANTED)], "rank_error")


def p8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.count_tokens(table(spark, folder, "documents")), 2048)


def p7_runs(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("datetime")
    pings = table(spark, folder, "privacy_toy").where((t >= F.lit("2005-01-01").cast("timestamp")) & (t < F.lit("2036-01-01").cast("timestamp")))
    r = runs.collapse_runs(pings)
    return r.select("uid", (F.col("start_us") / 1e6).cast("long").alias("start_s"), "duration_s", "n", "lat", "lng")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_runs(spark, folder).where("n >= 3").select("uid", "start_s").distinct()


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("item_id", "doc_id", "how", "answered")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_leaks(spark, folder).select("item_id", "doc_id").distinct()


def p10_stretches(spark: SparkSession, folder: str) -> DataFrame:
    return languages.stretches(table(spark, folder, "documents"), languages.fit_profiles(table(spark, folder, "lang_samples")))


def p10_documents(spark: SparkSession, folder: str) -> DataFrame:
    return languages.document_languages(table(spark, folder, "documents"), languages.fit_profiles(table(spark, folder, "lang_samples")))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    found = languages.unlabelled_languages(table(spark, folder, "documents"), languages.fit_profiles(table(spark, folder, "lang_samples")))
    return found.select("doc_id", "lang").distinct()


_RUNS_SQL = """
WITH p AS (SELECT DISTINCT uid, datetime, lat, lng FROM privacy_toy WHERE uid IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL AND datetime >= TIMESTAMP '2005-01-01' AND datetime < TIMESTAMP '2036-01-01'),
q AS (SELECT *, lag(lat) OVER w AS la, lag(lng) OVER w AS lo, lag(datetime) OVER w AS t, row_number() OVER w AS i FROM p WINDOW w AS (PARTITION BY uid ORDER BY datetime, lat, lng)),
f AS (SELECT *, CASE WHEN epoch_us(datetime) - epoch_us(t) <= 86400000000 AND
 2 * 6371.0::DOUBLE * asin(sqrt(least(1::DOUBLE, pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lng - lo) / 2), 2)))) <= 0.01::DOUBLE THEN 0 ELSE 1 END AS c FROM q),
g AS (SELECT *, sum(c) OVER (PARTITION BY uid ORDER BY i ROWS UNBOUNDED PRECEDING) AS r FROM f),
s AS (SELECT uid, min(epoch_us(datetime)) AS a, max(epoch_us(datetime)) AS b, count(*) AS n, arg_min(lat, i) AS lat, arg_min(lng, i) AS lng FROM g GROUP BY uid, r)
"""

QUERIES = {f.__name__: f for f in (p1_percentiles, p7_found, p7_runs, p8_packing, p9_found, p9_leaks, p10_documents, p10_found, p10_stretches)}

ORACLE = {
    "p7_found": f"{_RUNS_SQL} SELECT DISTINCT uid, a // 1000000 AS start_s FROM s WHERE n >= 3",
    "p7_runs": f"{_RUNS_SQL} SELECT uid, a // 1000000 AS start_s, (b - a) / 1e6::DOUBLE AS duration_s, n, lat, lng FROM s",
}
