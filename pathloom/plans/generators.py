"""Queries for the models of flows and of agents, over the sites derived from the nations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.models import agents, flows, social
from pathloom.operators import spatial
from pathloom.plans.movement import SITES_SQL, sites
from pathloom.plans.trajectories import haversine_sql, rounded, trajectories
from pathloom.session import table

QUERIES: dict = {}
ORACLE: dict = {}
_START, _END = dt.datetime(2020, 1, 1, 8), dt.datetime(2020, 1, 10, 8)
_KM = haversine_sql("a.lat", "a.lng", "b.lat", "b.lng")
_PAIR = f"WITH {SITES_SQL}, pair AS (SELECT a.tile_ID AS origin, b.tile_ID AS destination, a.relevance AS m, b.relevance AS n, a.tot_outflow AS o, {_KM} AS d FROM site a JOIN site b ON a.tile_ID <> b.tile_ID)"


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@_query(f"{_PAIR} SELECT origin, destination, round(o * n / pow(d, 2) / sum(n / pow(d, 2)) OVER (PARTITION BY origin), 6) AS flow FROM pair")
def gravity_singly(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(flows.Gravity().generate(sites(spark, folder)))


@_query(f"{_PAIR} SELECT origin, destination, round(sqrt(m) * n * exp(-0.2::DOUBLE * d) / sum(sqrt(m) * n * exp(-0.2::DOUBLE * d)) OVER () * (SELECT sum(tot_outflow) FROM site), 6) AS flow FROM pair")
def gravity_globally(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(flows.Gravity("exponential", 0.2, origin_exp=0.5, constraint="globally constrained").generate(sites(spark, folder)))


def _populated(spark: SparkSession, folder: str) -> DataFrame:
    """The tiles with their centroids, population and an outflow."""
    tiles = spatial.centroids(table(spark, folder, "tessellation"))
    return tiles.select(F.col("tile_id").alias("tile_ID"), "lat", "lng", F.col("population").cast("double").alias("population"), (F.col("relevance").cast("long") % 1000 + 1).alias("tot_outflow"))


_TILES = """c AS (SELECT tile_id, generate_subscripts(geometry[1], 1) AS i, unnest(geometry[1]) AS p, geometry[1][1] AS o FROM tessellation),
 e AS (SELECT tile_id, o.x AS ox, o.y AS oy, p.x - o.x AS x, p.y - o.y AS y, lead(p.x - o.x) OVER w AS x2, lead(p.y - o.y) OVER w AS y2 FROM c WINDOW w AS (PARTITION BY tile_id ORDER BY i)),
 s AS (SELECT tile_id, any_value(ox) AS ox, any_value(oy) AS oy, sum(x * y2 - x2 * y) AS a, sum((x + x2) * (x * y2 - x2 * y)) AS mx, sum((y + y2) * (x * y2 - x2 * y)) AS my FROM e WHERE x2 IS NOT NULL GROUP BY tile_id),
 site AS (SELECT tile_id AS tile_ID, oy + my / (3 * a) AS lat, ox + mx / (3 * a) AS lng, population::DOUBLE AS relevance, relevance % 1000 + 1 AS tot_outflow FROM s JOIN tessellation USING (tile_id))"""
_TILE_PAIR = f"WITH {_TILES}, pair AS (SELECT a.tile_ID AS origin, b.tile_ID AS destination, a.relevance AS m, b.relevance AS n, a.tot_outflow AS o, {_KM} AS d FROM site a JOIN site b ON a.tile_ID <> b.tile_ID)"


@_query(f"{_TILE_PAIR} SELECT origin, destination, round(o * n / pow(d, 2) / sum(n / pow(d, 2)) OVER (PARTITION BY origin), 4) AS flow FROM pair WHERE n > 0")
def gravity_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Between all tiles of the tessellation, by population."""
    return rounded(flows.Gravity().generate(_populated(spark, folder), relevance="population"), 4)


@_query(f"""{_TILE_PAIR}, near AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY origin ORDER BY round(d, 9), destination ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM pair),
 p AS (SELECT *, m * n / ((m + s) * (m + s + n)) / (1 - m / (SELECT sum(relevance) FROM site)) AS p FROM near WHERE m > 0)
 SELECT origin, destination, round_even(o * p, 0) AS flow FROM p WHERE round_even(o * p, 0) > 0""")
def radiation_tiles(spark: SparkSession, folder: str) -> DataFrame:
    return flows.Radiation().generate(_populated(spark, folder), relevance="population")


@_query()
def gravity_fit_commuting(spark: SparkSession, folder: str) -> DataFrame:
    """Parameters of the gravity model of the commuting flows between the tiles."""
    once = table(spark, folder, "ny_commuting_flows_2011").dropDuplicates(["flow_id"]).dropna(subset=["flow", "origin", "destination"])
    seen = once.groupBy("origin", "destination").agg(F.sum("flow").alias("flow"))
    found = flows.Gravity().fit(seen, _populated(spark, folder), relevance="population")
    return spark.createDataFrame([(round(found.argument, 4), round(found.destination_exp, 4))], "deterrence double, destination_exp double")


@_query()
def density_epr_tiles(spark: SparkSession, folder: str) -> DataFrame:
    return agents.density_epr().generate(spark, _START, _END, _populated(spark, folder), n_agents=200, relevance="population", seed=7)


@_query()
def gravity_sample(spark: SparkSession, folder: str) -> DataFrame:
    return flows.Gravity().generate(sites(spark, folder), out_format="flows_sample", seed=1)


@_query(f"""{_PAIR}, s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY origin ORDER BY d, destination ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM pair),
 p AS (SELECT *, m * n / ((m + s) * (m + s + n)) / (1 - m / (SELECT sum(relevance) FROM site)) AS p FROM s)
 SELECT origin, destination, round_even(o * p, 0) AS flow FROM p WHERE round_even(o * p, 0) > 0""")
def radiation(spark: SparkSession, folder: str) -> DataFrame:
    return flows.Radiation().generate(sites(spark, folder))


@_query()
def gravity_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Parameters recovered from flows made with known ones."""
    tiles = sites(spark, folder)
    made = flows.Gravity(argument=-1.5, destination_exp=0.8).generate(tiles)
    found = flows.Gravity().fit(made, tiles)
    return spark.createDataFrame([(round(found.argument, 4), round(found.destination_exp, 4))], "deterrence double, destination_exp double")


@_query()
def density_epr(spark: SparkSession, folder: str) -> DataFrame:
    return agents.density_epr().generate(spark, _START, _END, sites(spark, folder), n_agents=200, seed=7)


@_query()
def spatial_epr(spark: SparkSession, folder: str) -> DataFrame:
    return agents.spatial_epr().generate(spark, _START, _END, sites(spark, folder), n_agents=200, seed=7)


def _diary(spark: SparkSession, folder: str) -> agents.MarkovDiary:
    t = trajectories(spark, folder)
    return agents.MarkovDiary().fit(t.withColumn("location", F.concat_ws(",", "lat", "lng")))


@_query()
def diary_fit(spark: SparkSession, folder: str) -> DataFrame:
    chain = _diary(spark, folder).chain
    rows = [(int(a), int(b), round(float(chain[a, b]), 6)) for a, b in zip(*chain.nonzero())]
    return spark.createDataFrame(rows, "state int, next int, prob double")


@_query()
def ditras(spark: SparkSession, folder: str) -> DataFrame:
    return agents.Ditras(_diary(spark, folder)).generate(spark, _START, _END, sites(spark, folder), n_agents=100, seed=7)


@_query()
def geosim(spark: SparkSession, folder: str) -> DataFrame:
    return social.geosim().generate(spark, _START, _END, sites(spark, folder), n_agents=60, seed=7, populations=4)


@_query()
def sts_epr(spark: SparkSession, folder: str) -> DataFrame:
    return social.sts_epr().generate(spark, _START, _END, sites(spark, folder), n_agents=60, diary=_diary(spark, folder), relevance="relevance", by_relevance=True, seed=7, populations=4)
