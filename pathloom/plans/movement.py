"""Queries for preparation, tiles and flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators import preprocess, spatial, tessellation
from pathloom.operators.ordered import micros
from pathloom.plans.trajectories import TRAJ_SQL, haversine_sql, rounded, trajectories
from pathloom.session import table

QUERIES: dict = {}
ORACLE: dict = {}

_H = haversine_sql
_BOX = (116.295, 39.895, 116.365, 40.015)
_M = 1700.0
_SEQ = f"{TRAJ_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY datetime, lat, lng) AS i, count(*) OVER (PARTITION BY uid) AS m FROM traj)"


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _us(df: DataFrame) -> DataFrame:
    for c in ("datetime", "leaving_datetime"):
        if c in df.columns:
            df = df.withColumn(c.replace("datetime", "us"), micros(c)).drop(c)
    return rounded(df)


@_query(f"""WITH RECURSIVE {_SEQ}, f AS (
 SELECT uid, i, m, lat, lng, datetime, lat AS la, lng AS lo, datetime AS t, true AS keep FROM q WHERE i = 1
 UNION ALL
 SELECT q.uid, q.i, q.m, q.lat, q.lng, q.datetime, CASE WHEN ok THEN q.lat ELSE f.la END, CASE WHEN ok THEN q.lng ELSE f.lo END, CASE WHEN ok THEN q.datetime ELSE f.t END, ok OR q.i = q.m
 FROM f JOIN q ON q.uid = f.uid AND q.i = f.i + 1, LATERAL (SELECT q.m <= 2 OR {_H("f.la", "f.lo", "q.lat", "q.lng")} / ((epoch_us(q.datetime) - epoch_us(f.t)) / 3600000000.0::DOUBLE) <= 0.5::DOUBLE AS ok))
 SELECT uid, epoch_us(datetime) AS us, round(lat, 6) AS lat, round(lng, 6) AS lng FROM f WHERE keep""")
def filter_speed(spark: SparkSession, folder: str) -> DataFrame:
    return _us(preprocess.filter_speed(trajectories(spark, folder), max_speed_kmh=0.5))


_LEFT = _H("here.lat", "here.lng", "p.lat", "p.lng")


@_query(f"""WITH RECURSIVE {TRAJ_SQL}, f AS (
 SELECT uid, list(struct_pack(lat := lat, lng := lng, us := epoch_us(datetime)) ORDER BY datetime, lat, lng) AS own, 1::BIGINT AS i FROM traj GROUP BY uid
 UNION ALL
 SELECT uid, CASE WHEN gone IS NULL THEN own ELSE list_concat(own[:gone - 1], own[gone + 1:]) END, CASE WHEN gone IS NULL THEN i + 1 ELSE i END FROM (
  SELECT uid, own, i, CASE WHEN late[1] = 0 OR far[1] / (late[1] / 3600) > 50::DOUBLE THEN i + 1
   WHEN home IS NOT NULL AND list_sum(far[:home - 1]) * 3600 > 0.2::DOUBLE * list_sum(late[:home - 1]) AND list_sum(late[:home - 1]) > 0 THEN i + apex END AS gone FROM (
   SELECT *, list_filter(range(apex + 1, m), lambda j: far[j] < 0.25::DOUBLE * far[apex])[1] AS home FROM (
    SELECT *, list_position(far[:m - 1], list_max(far[:m - 1])) AS apex FROM (
     SELECT uid, own, i, least(6, len(own) - i) AS m, list_transform(own[i + 1:i + least(6, len(own) - i)], lambda p: round({_LEFT.replace("here.", "own[i].")}, 9)) AS far,
      list_transform(own[i + 1:i + least(6, len(own) - i)], lambda p: (p.us - own[i].us) / 1e6::DOUBLE) AS late FROM f WHERE i <= len(own) - 2)))))
 SELECT uid, p.us AS us, round(p.lat, 6) AS lat, round(p.lng, 6) AS lng FROM (SELECT uid, unnest(own) AS p FROM f WHERE i > len(own) - 2)""")
def filter_loops(spark: SparkSession, folder: str) -> DataFrame:
    return _us(preprocess.filter_speed(trajectories(spark, folder), max_speed_kmh=50.0, include_loops=True, speed_kmh=0.2))


_RUNS = f"""f AS (
 SELECT uid, i, lat AS la, lng AS lo, 1 AS run FROM q WHERE i = 1
 UNION ALL
 SELECT q.uid, q.i, CASE WHEN far THEN q.lat ELSE f.la END, CASE WHEN far THEN q.lng ELSE f.lo END, CASE WHEN far THEN f.run + 1 ELSE f.run END
 FROM f JOIN q ON q.uid = f.uid AND q.i = f.i + 1, LATERAL (SELECT {_H("f.la", "f.lo", "q.lat", "q.lng")} > 2.5::DOUBLE AS far))"""


@_query(f"""WITH RECURSIVE {_SEQ}, {_RUNS}
 SELECT uid, epoch_us(min(datetime)) AS us, round(median(lat), 6) AS lat, round(median(lng), 6) AS lng FROM f JOIN q USING (uid, i) GROUP BY uid, run""")
def compress(spark: SparkSession, folder: str) -> DataFrame:
    return _us(preprocess.compress(trajectories(spark, folder), 2.5))


@_query(f"""WITH RECURSIVE {_SEQ}, {_RUNS}, r AS (SELECT uid, run, min(i) AS a, max(i) AS b, max(m) AS m, min(datetime) AS t, median(lat) AS lat, median(lng) AS lng,
 median(lat) FILTER (WHERE i < m) AS lat_open, median(lng) FILTER (WHERE i < m) AS lng_open FROM f JOIN q USING (uid, i) GROUP BY uid, run),
 s AS (SELECT r.*, n.datetime AS leave FROM r JOIN q n ON n.uid = r.uid AND n.i = least(r.b + 1, r.m) WHERE r.a < r.m)
 SELECT uid, epoch_us(t) AS us, epoch_us(leave) AS leaving_us, round(CASE WHEN b = m THEN lat_open ELSE lat END, 6) AS lat, round(CASE WHEN b = m THEN lng_open ELSE lng END, 6) AS lng
 FROM s WHERE leave - t > INTERVAL 60 MINUTE""")
def stay_locations(spark: SparkSession, folder: str) -> DataFrame:
    return _us(preprocess.stay_locations(trajectories(spark, folder), minutes_for_a_stop=60, spatial_radius_km=2.5))


@_query(f"""WITH RECURSIVE {TRAJ_SQL}, loc AS (SELECT uid, lat, lng, count(*) AS n, min(datetime) AS seen FROM traj GROUP BY ALL),
 link AS (SELECT a.uid, a.lat AS la, a.lng AS lo, b.lat, b.lng FROM loc a JOIN loc b ON a.uid = b.uid AND {_H("a.lat", "a.lng", "b.lat", "b.lng")} * 6371.0088 / 6371.0 <= 1::DOUBLE),
 reach AS (SELECT uid, lat AS la, lng AS lo, lat, lng FROM loc UNION SELECT r.uid, r.la, r.lo, l.lat, l.lng FROM reach r JOIN link l ON l.uid = r.uid AND l.la = r.lat AND l.lo = r.lng),
 comp AS (SELECT r.uid, r.la, r.lo, min(loc.seen) AS seen FROM reach r JOIN loc ON loc.uid = r.uid AND loc.lat = r.lat AND loc.lng = r.lng GROUP BY ALL),
 size AS (SELECT c.uid, c.seen, sum(loc.n) AS n FROM comp c JOIN loc ON loc.uid = c.uid AND loc.lat = c.la AND loc.lng = c.lo GROUP BY ALL),
 lab AS (SELECT uid, seen, row_number() OVER (PARTITION BY uid ORDER BY n DESC, seen DESC) - 1 AS cluster FROM size)
 SELECT t.uid, epoch_us(t.datetime) AS us, round(t.lat, 6) AS lat, round(t.lng, 6) AS lng, lab.cluster FROM traj t JOIN comp c ON c.uid = t.uid AND c.la = t.lat AND c.lo = t.lng JOIN lab ON lab.uid = c.uid AND lab.seen = c.seen""")
def cluster_min1(spark: SparkSession, folder: str) -> DataFrame:
    return _us(preprocess.cluster(trajectories(spark, folder), cluster_radius_km=1.0))


@_query(f"""WITH RECURSIVE {TRAJ_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY datetime, lat, lng) AS i FROM traj), loc AS (SELECT uid, lat, lng, count(*) AS n, min(i) AS seen FROM q GROUP BY ALL),
 link AS (SELECT a.uid, a.seen AS x, b.seen AS y, b.n FROM loc a JOIN loc b ON a.uid = b.uid AND {_H("a.lat", "a.lng", "b.lat", "b.lng")} * 6371.0088 / 6371.0 <= 1::DOUBLE),
 core AS (SELECT uid, x FROM link GROUP BY ALL HAVING sum(n) >= 4),
 tie AS (SELECT l.uid, l.x, l.y FROM link l JOIN core a ON a.uid = l.uid AND a.x = l.x JOIN core b ON b.uid = l.uid AND b.x = l.y),
 reach AS (SELECT uid, x, x AS y FROM core UNION SELECT r.uid, r.x, t.y FROM reach r JOIN tie t ON t.uid = r.uid AND t.x = r.y),
 comp AS (SELECT uid, x, min(y) AS c FROM reach GROUP BY ALL),
 held AS (SELECT l.uid, l.x, min(c.c) AS c FROM link l JOIN comp c ON c.uid = l.uid AND c.x = l.y GROUP BY ALL),
 own AS (SELECT uid, x, coalesce(comp.c, held.c) AS c FROM held LEFT JOIN comp USING (uid, x)),
 size AS (SELECT own.uid, c, sum(n) AS n FROM own JOIN loc ON loc.uid = own.uid AND loc.seen = own.x GROUP BY ALL),
 lab AS (SELECT uid, c, row_number() OVER (PARTITION BY uid ORDER BY n DESC, c DESC) - 1 AS cluster FROM size)
 SELECT t.uid, epoch_us(t.datetime) AS us, round(t.lat, 6) AS lat, round(t.lng, 6) AS lng, coalesce(cluster, -1) AS cluster FROM traj t JOIN loc USING (uid, lat, lng) LEFT JOIN own ON own.uid = t.uid AND own.x = loc.seen LEFT JOIN lab ON lab.uid = own.uid AND lab.c = own.c""")
def dbscan(spark: SparkSession, folder: str) -> DataFrame:
    return _us(preprocess.cluster(trajectories(spark, folder), cluster_radius_km=1.0, min_samples=4))


_R = "6378137.0::DOUBLE"
_SQUARES = f"""ext AS (SELECT radians({_BOX[0]}::DOUBLE) * {_R} AS ax, {_R} * ln(tan(pi() / 4 + radians({_BOX[1]}::DOUBLE) / 2)) AS ay, radians({_BOX[2]}::DOUBLE) * {_R} AS bx, {_R} * ln(tan(pi() / 4 + radians({_BOX[3]}::DOUBLE) / 2)) AS b_y),
 dim AS (SELECT *, ceil((bx - ax) / {_M})::BIGINT AS nx, ceil((b_y - ay) / {_M})::BIGINT AS ny FROM ext),
 sq AS (SELECT id, ax + (id // ny) * {_M}::DOUBLE AS x, ay + (id % ny) * {_M}::DOUBLE AS y FROM dim, LATERAL (SELECT unnest(range(nx * ny)) AS id)),
 tile AS (SELECT id::VARCHAR AS tile_ID, degrees(x / {_R}) AS x0, degrees((x + {_M}::DOUBLE) / {_R}) AS x1, degrees(2 * atan(exp(y / {_R})) - pi() / 2) AS y0, degrees(2 * atan(exp((y + {_M}::DOUBLE) / {_R})) - pi() / 2) AS y1 FROM sq)"""


@_query(f"WITH {_SQUARES} SELECT tile_ID, round(x0, 6) AS x0, round(x1, 6) AS x1, round(y0, 6) AS y0, round(y1, 6) AS y1 FROM tile")
def squared_tessellation(spark: SparkSession, folder: str) -> DataFrame:
    ring = F.col("geometry")[0]
    return rounded(tessellation.get("squared", spark, _BOX, meters=_M).select("tile_ID", ring[0]["x"].alias("x0"), ring[2]["x"].alias("x1"), ring[0]["y"].alias("y0"), ring[2]["y"].alias("y1")))


_MAPPED = f"{TRAJ_SQL}, {_SQUARES}, mapped AS (SELECT t.*, tile.tile_ID FROM traj t LEFT JOIN tile ON t.lng > x0 AND t.lng < x1 AND t.lat > y0 AND t.lat < y1)"


def _mapped(spark: SparkSession, folder: str) -> DataFrame:
    return spatial.map_to_tiles(trajectories(spark, folder), tessellation.get("squared", spark, _BOX, meters=_M))


@_query(f"WITH {_MAPPED} SELECT uid, epoch_us(datetime) AS us, round(lat, 6) AS lat, round(lng, 6) AS lng, tile_ID FROM mapped")
def mapping_polygons(spark: SparkSession, folder: str) -> DataFrame:
    return _us(_mapped(spark, folder))


def _sites(spark: SparkSession, folder: str) -> DataFrame:
    """Point tiles: every nation at a place of its own near the trajectories."""
    k = F.col("n_nationkey")
    return table(spark, folder, "nation").select(F.col("n_name").alias("tile_ID"), (F.lit(39.9) + (k * 7 % 25) / F.lit(250.0)).alias("lat"), (F.lit(116.3) + (k * 11 % 25) / F.lit(400.0)).alias("lng"), (k + 1).cast("double").alias("relevance"), ((k * 13) % 37 + 5).cast("long").alias("tot_outflow"))


SITES_SQL = "site AS (SELECT n_name AS tile_ID, 39.9::DOUBLE + (n_nationkey * 7 % 25) / 250.0::DOUBLE AS lat, 116.3::DOUBLE + (n_nationkey * 11 % 25) / 400.0::DOUBLE AS lng, (n_nationkey + 1)::DOUBLE AS relevance, ((n_nationkey * 13) % 37 + 5)::BIGINT AS tot_outflow FROM nation)"
sites = _sites


@_query(f"""WITH {TRAJ_SQL}, {SITES_SQL}, loc AS (SELECT DISTINCT lat, lng FROM traj),
 near AS (SELECT l.lat, l.lng, arg_min(tile_ID, (round({_H("l.lat", "l.lng", "s.lat", "s.lng")}, 9), tile_ID)) AS tile_ID, min({_H("l.lat", "l.lng", "s.lat", "s.lng")}) AS km FROM loc l, site s GROUP BY ALL)
 SELECT uid, epoch_us(datetime) AS us, round(lat, 6) AS lat, round(lng, 6) AS lng, tile_ID, round(km, 6) AS km FROM traj JOIN near USING (lat, lng)""")
def mapping_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return _us(spatial.nearest_tile(trajectories(spark, folder), _sites(spark, folder), km="km"))


_FLOWS = f"{_MAPPED}, pr AS (SELECT lag(tile_ID) OVER (PARTITION BY uid ORDER BY datetime, lat, lng) AS origin, tile_ID AS destination FROM mapped), flows AS (SELECT origin, destination, count(*) AS flow FROM pr WHERE origin IS NOT NULL AND destination IS NOT NULL GROUP BY ALL)"


@_query(f"WITH {_FLOWS} SELECT * FROM flows")
def to_flows(spark: SparkSession, folder: str) -> DataFrame:
    return spatial.to_flows(_mapped(spark, folder))


@_query(f"WITH {_FLOWS} SELECT a.tile_ID AS origin, b.tile_ID AS destination, coalesce(flow, 0) AS flow FROM tile a CROSS JOIN tile b LEFT JOIN flows f ON f.origin = a.tile_ID AND f.destination = b.tile_ID")
def flow_matrix(spark: SparkSession, folder: str) -> DataFrame:
    tiles = tessellation.get("squared", spark, _BOX, meters=_M)
    wide = spatial.flow_matrix(to_flows(spark, folder), tiles)
    return wide.unpivot("origin", [c for c in wide.columns if c != "origin"], "destination", "flow")


@_query(f"WITH {_FLOWS} SELECT '0' AS origin, '1' AS destination, coalesce(max(flow), 0) AS flow FROM flows WHERE origin = '0' AND destination = '1'")
def get_flow(spark: SparkSession, folder: str) -> DataFrame:
    return spatial.flow_between(to_flows(spark, folder), tessellation.get("squared", spark, _BOX, meters=_M), "0", "1")


@_query("""WITH f AS (SELECT DISTINCT ON (flow_id) * FROM ny_commuting_flows_2011)
 SELECT origin, destination, sum(flow)::BIGINT AS flow, count(*) AS n_rows FROM f WHERE origin IS NOT NULL AND destination IS NOT NULL AND flow IS NOT NULL GROUP BY ALL""")
def commuting_flows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "ny_commuting_flows_2011").dropDuplicates(["flow_id"]).dropna(subset=["flow", "origin", "destination"])
    spatial.check_flows(rows, table(spark, folder, "tessellation"), "tile_id")
    return rows.groupBy("origin", "destination").agg(F.sum("flow").alias("flow"), F.count("*").alias("n_rows"))


@_query(f"""WITH {TRAJ_SQL}, w AS (SELECT *, floor((epoch_us(datetime) - epoch_us(date_trunc('day', (SELECT min(datetime) FROM traj))) - 10800000000) / 86400000000) AS s FROM traj),
 k AS (SELECT w.* FROM w WHERE s >= 0 AND (s + 1) * 86400000000 + epoch_us(date_trunc('day', (SELECT min(datetime) FROM traj))) <= epoch_us(date_trunc('day', (SELECT max(datetime) FROM traj))) + 86400000000),
 d AS (SELECT s, dense_rank() OVER (ORDER BY s) - 1 AS g FROM (SELECT DISTINCT s FROM k))
 SELECT uid, epoch_us(datetime) AS us, round(lat, 6) AS lat, round(lng, 6) AS lng, g AS "group" FROM k JOIN d USING (s)""")
def group_by_time(spark: SparkSession, folder: str) -> DataFrame:
    return _us(spatial.group_by_time(trajectories(spark, folder), "1 day", "3 hours").drop("window_start"))


@_query(f"WITH {TRAJ_SQL} SELECT uid, epoch_us(datetime) AS us, epoch_us(datetime + INTERVAL 8 HOUR) AS local_us FROM traj")
def timezone_conversion(spark: SparkSession, folder: str) -> DataFrame:
    t = trajectories(spark, folder)
    local = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Shanghai"), F.col("datetime"))
    return t.select("uid", micros("datetime").alias("us"), micros(local).alias("local_us"))


@_query(f"WITH {TRAJ_SQL} SELECT round(min(lng), 6) AS min_lng, round(min(lat), 6) AS min_lat, round(max(lng), 6) AS max_lng, round(max(lat), 6) AS max_lat FROM traj")
def bounds(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(spatial.bounds(trajectories(spark, folder)))


@_query("""WITH c AS (SELECT tile_id, generate_subscripts(geometry[1], 1) AS i, unnest(geometry[1]) AS p, geometry[1][1] AS o FROM tessellation),
 e AS (SELECT tile_id, o.x AS ox, o.y AS oy, p.x - o.x AS x, p.y - o.y AS y, lead(p.x - o.x) OVER w AS x2, lead(p.y - o.y) OVER w AS y2 FROM c WINDOW w AS (PARTITION BY tile_id ORDER BY i)),
 s AS (SELECT tile_id, any_value(ox) AS ox, any_value(oy) AS oy, sum(x * y2 - x2 * y) AS a, sum((x + x2) * (x * y2 - x2 * y)) AS mx, sum((y + y2) * (x * y2 - x2 * y)) AS my FROM e WHERE x2 IS NOT NULL GROUP BY tile_id)
 SELECT tile_id, round(oy + my / (3 * a), 6) AS lat, round(ox + mx / (3 * a), 6) AS lng FROM s""")
def tile_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(spatial.centroids(table(spark, folder, "tessellation")).select("tile_id", "lat", "lng"))


@_query("""WITH rings AS (SELECT tile_id, generate_subscripts(geometry, 1) AS k, unnest(geometry) AS ring FROM tessellation),
 corners AS (SELECT tile_id, k, generate_subscripts(ring, 1) AS i, unnest(ring) AS c FROM rings),
 edges AS (SELECT tile_id, c.x AS x0, c.y AS y0, lead(c.x) OVER w AS x1, lead(c.y) OVER w AS y1 FROM corners WINDOW w AS (PARTITION BY tile_id, k ORDER BY i)),
 edge AS (SELECT tile_id, least(x0, x1) AS xa, CASE WHEN x0 < x1 THEN y0 ELSE y1 END AS ya, greatest(x0, x1) AS xb, CASE WHEN x0 < x1 THEN y1 ELSE y0 END AS yb FROM edges WHERE x0 <> x1),
 p AS (SELECT row_number() OVER () AS r, lat AS y, lng AS x FROM privacy_toy),
 met AS (SELECT r, tile_id FROM p JOIN edge ON x >= xa AND x < xb WHERE ya + (x - xa) * ((yb - ya) / (xb - xa)) > y GROUP BY r, tile_id HAVING count(*) % 2 = 1)
 SELECT tile_id AS tile_ID, count(*) AS n_pings FROM p LEFT JOIN met USING (r) GROUP BY tile_id""")
def mapped_pings(spark: SparkSession, folder: str) -> DataFrame:
    """Pings by tile of the tessellation table."""
    pings = table(spark, folder, "privacy_toy").select("ping_id", "lat", "lng")
    return spatial.map_to_tiles(pings, table(spark, folder, "tessellation"), "tile_id").groupBy("tile_ID").agg(F.count("*").alias("n_pings"))
