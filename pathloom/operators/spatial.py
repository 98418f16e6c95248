"""Points and tiles: which tile holds a point, which is nearest, flows between tiles, windows of time, bounds and centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions.geo import mercator_x, mercator_y
from pathloom.operators.near import MOST_BROADCAST, Sites, Zones, _rings
from pathloom.operators.ordered import with_previous


def _tiles(tiles: DataFrame, tile_id: str) -> pd.DataFrame:
    rows = tiles.select(F.col(tile_id).cast("string").alias("tile"), "geometry").collect()
    return pd.DataFrame([(r[0], _rings([[{"x": p[0], "y": p[1]} for p in ring] for ring in r[1]]) if r[1] else []) for r in rows], columns=["tile", "rings"])


def _corners(tiles: DataFrame) -> int:
    n = F.expr("aggregate(geometry, 0, (n, r) -> n + coalesce(size(r), 0))")
    return int(tiles.select(F.coalesce(F.sum(F.coalesce(n, F.lit(0))), F.lit(0))).first()[0])


def within(geometry: str, x: str, y: str) -> Column:
    """Whether a point lies in rings of {x, y} (even-odd), as an expression: for tables of tiles too large to send to every task."""
    # The rule of Zones.containing: edges that span x, their left corner included, and lie above the point.
    ring = "filter(r, p -> p.x is not null and p.y is not null)"
    edges = f"transform({ring}, (p, i) -> if(p.x < {ring}[(i + 1) % size({ring})].x, struct(p as a, {ring}[(i + 1) % size({ring})] as b), struct({ring}[(i + 1) % size({ring})] as a, p as b)))"
    above = f"e -> e.a.x <= {x} and {x} < e.b.x and e.a.y + ({x} - e.a.x) * ((e.b.y - e.a.y) / (e.b.x - e.a.x)) > {y}"
    return F.expr(f"aggregate(filter({geometry}, r -> r is not null), 0, (n, r) -> n + size(filter({edges}, {above}))) % 2 = 1")


def map_to_tiles(points: DataFrame, tiles: DataFrame, tile_id: str = "tile_ID", remove_na: bool = False, lat: str = "lat", lng: str = "lng", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``points`` with ``tile_ID`` of the tile that holds them; a point in several tiles gives several rows, one in none a null, or no
    row with ``remove_na``. Tiles have rings of {x, y} in degrees.

    Up to ``most_broadcast`` corners the tiles are sent to every task and points don't move. Beyond, both sides meet in
    cells of a grid as wide as the tiles usually are, and the exact test follows.
    """
    names = points.columns
    if _corners(tiles) <= most_broadcast:
        own = _tiles(tiles, tile_id)
        held = points.sparkSession.sparkContext.broadcast((own["tile"].to_numpy(), Zones(own["rings"].tolist())))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, zones = held.value
            for b in batches:
                y, x = (b.column(names.index(c)).to_numpy(zero_copy_only=False).astype(float) for c in (lat, lng))
                ok = np.flatnonzero(np.isfinite(y) & np.isfinite(x))
                i, z = zones.containing(y[ok], x[ok])
                i, tile = ok[i], ids[z] if len(z) else np.empty(0, object)
                if not remove_na:
                    lone = np.setdiff1d(np.arange(b.num_rows), i)
                    i, tile = np.r_[i, lone].astype(np.int64), np.r_[tile, np.full(len(lone), None)]
                out = b.take(pa.array(i))
                yield pa.record_batch([*out.columns, pa.array(tile.tolist(), pa.string())], names=[*names, "tile_ID"])

        return points.mapInArrow(run, T.StructType([*points.schema.fields, T.StructField("tile_ID", T.StringType())]))
    ends = {n: F.expr(f"array_{f}(flatten(transform(filter(geometry, r -> r is not null), r -> transform(r, p -> p.{c}))))") for n, f, c in (("_x0", "min", "x"), ("_x1", "max", "x"), ("_y0", "min", "y"), ("_y1", "max", "y"))}
    box = tiles.select(F.col(tile_id).cast("string").alias("_tile"), "geometry").withColumns(ends).withColumn("_wide", F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))).where("_wide is not null")
    # Cells are so wide that the tiles wider than four of them can be sent to every task; the others touch 25 cells at most.
    steps = [0.5, 0.9, 0.99, 0.999, 1.0]
    wide = box.select(F.percentile_approx("_wide", F.array(*[F.lit(s) for s in steps]), F.lit(10_000))).first()[0] or [1.0]
    for size in [max(w, 1e-6) for w in wide] + [max(wide[-1], 1e-6) * 2]:
        large = box.where(F.col("_wide") > 4 * size)
        if _corners(large) <= most_broadcast:
            break
    few = _tiles(large.withColumnRenamed("_tile", "tile_ID"), "tile_ID")
    held = points.sparkSession.sparkContext.broadcast((few["tile"].to_numpy(), Zones(few["rings"].tolist())))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with the list of the large tiles that hold them."""
        ids, zones = held.value
        for b in batches:
            y, x = (b.column(names.index(c)).to_numpy(zero_copy_only=False).astype(float) for c in (lat, lng))
            ok = np.flatnonzero(np.isfinite(y) & np.isfinite(x))
            i, z = zones.containing(y[ok], x[ok])
            o = np.argsort(ok[i], kind="stable")
            ends_ = np.r_[0, np.cumsum(np.bincount(ok[i], minlength=b.num_rows))].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends_), pa.array(ids[z[o]].tolist() if len(z) else [], pa.string()))
            yield pa.record_batch([*b.columns, lists], names=[*names, "_large"])

    left = points.mapInArrow(seen, T.StructType([*points.schema.fields, T.StructField("_large", T.ArrayType(T.StringType()))]))
    cell = lambda c: F.floor(F.col(c) / F.lit(size))
    right = box.where(F.col("_wide") <= 4 * size).withColumn("_cx", F.explode(F.sequence(cell("_x0"), cell("_x1")))).withColumn("_cy", F.explode(F.sequence(cell("_y0"), cell("_y1"))))
    right = right.select(F.col("_cx").alias("_rx"), F.col("_cy").alias("_ry"), F.col("geometry").alias("_rings"), "_tile")
    cells = left.withColumns({"_cx": cell(lng), "_cy": cell(lat)})
    met = cells.join(right, (F.col("_cx") == F.col("_rx")) & (F.col("_cy") == F.col("_ry")) & within("_rings", f"`{lng}`", f"`{lat}`"), "inner" if remove_na else "left")
    met = met.where(F.col("_tile").isNotNull() | (F.size("_large") == 0))
    return met.select(*names, F.col("_tile").alias("tile_ID")).unionByName(left.select(*names, F.explode("_large").alias("tile_ID")))


def nearest_tile(points: DataFrame, tiles: DataFrame, tile_id: str = "tile_ID", tile_lat: str = "lat", tile_lng: str = "lng", lat: str = "lat", lng: str = "lng", km: str | None = None, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``points`` with ``tile_ID`` of the nearest of point tiles (ties: the smallest id), and its distance as column ``km`` if named.

    Tiles are sent to every task as k-d splits, ``most_broadcast`` at a time if there are more; each search widens its reach
    until something is found. Points without position have none.
    """
    all_ = tiles.select(F.col(tile_id).cast("string").alias("t"), F.col(tile_lat).cast("double").alias("y"), F.col(tile_lng).cast("double").alias("x")).dropna()
    blocks = max(1, -(-all_.count() // most_broadcast))
    out = points.withColumns({"_tile": F.lit(None).cast("string"), "_km": F.lit(None).cast("double")})
    for k in range(blocks):  # of each block the nearest so far is handed on
        rows = sorted(map(tuple, all_.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k).collect()))
        held = points.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], object), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)))
        out = out.mapInArrow(_nearer(held, out.columns, lat, lng), out.schema)
    kept = [F.col("_km").alias(km)] if km else []
    return out.select(*points.columns, F.col("_tile").alias("tile_ID"), *kept)


def _nearer(held, names: list[str], lat: str, lng: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ty, tx = held.value
        finders: dict[float, Sites] = {}
        for b in batches:
            y, x, before = (b.column(names.index(c)).to_numpy(zero_copy_only=False).astype(float) for c in (lat, lng, "_km"))
            best, far = np.full(len(y), -1), np.full(len(y), np.inf)
            left, reach = np.flatnonzero(np.isfinite(y) & np.isfinite(x)) if len(ids) else np.empty(0, int), 1000.0
            while len(left):
                if reach not in finders:
                    finders[reach] = Sites(ty, tx, np.full(len(ty), reach))
                i, s, d = finders[reach].within(y[left], x[left])
                o = np.lexsort((s, d, i))
                i, s, d = i[o], s[o], d[o]
                first = np.r_[True, i[1:] != i[:-1]][: len(i)]
                best[left[i[first]]], far[left[i[first]]] = s[first], d[first] / 1000
                left = left[(best[left] < 0) & ~(before[left] <= reach / 1000)]  # what an earlier block has nearer needn't be looked for
                reach *= 4
            old = b.column(names.index("_tile")).to_pylist()
            tile = [(ids[k] if k >= 0 and (o is None or f < g or (f == g and ids[k] < o)) else o) for k, f, g, o in zip(best, far, before, old)]
            yield pa.record_batch([*b.columns[:-2], pa.array(tile, pa.string()), pa.array(np.where(np.isfinite(np.fmin(far, before)), np.fmin(far, before), np.nan), from_pandas=True)], names=names)

    return run


def to_flows(mapped: DataFrame, self_loops: bool = True) -> DataFrame:
    """Flows between the tiles of consecutive points of an individual (order: tid if present, datetime): ``origin``, ``destination``, ``flow``.

    A point without a tile breaks the chain on both sides.
    """
    order = [c for c in ("tid",) if c in mapped.columns] + ["datetime", "lat", "lng"]
    pairs = with_previous(mapped, "uid", order, {"_from": "tile_ID"}, time="datetime") if order[0] == "datetime" else _by_trip(mapped)
    moved = pairs.where(F.col("_from").isNotNull() & F.col("tile_ID").isNotNull())
    if not self_loops:
        moved = moved.where(F.col("_from") != F.col("tile_ID"))
    return moved.groupBy(F.col("_from").alias("origin"), F.col("tile_ID").alias("destination")).agg(F.count("*").alias("flow"))


def _by_trip(mapped: DataFrame) -> DataFrame:
    """The tile of the point before: in the same trip, or for a trip's first point the last of the individual's trip before."""
    from pyspark.sql import Window

    rows = mapped.where(F.col("uid").isNotNull()).select("uid", "tid", "datetime", "lat", "lng", "tile_ID").withColumn("_trip", F.to_json(F.struct("uid", "tid")))
    rows = with_previous(rows, "_trip", ["datetime", "lat", "lng"], {"_from": "tile_ID", "_was": "datetime"}, time="datetime")
    last = rows.groupBy("_trip", "uid", "tid").agg(F.max(F.struct("datetime", "lat", "lng", "tile_ID"))["tile_ID"].alias("_last"))
    before = last.select(F.col("_trip").alias("_t"), F.lag("_last").over(Window.partitionBy("uid").orderBy("tid")).alias("_edge"))  # a row per trip
    out = rows.join(before, F.col("_trip") == F.col("_t"))
    return out.withColumn("_from", F.when(F.col("_was").isNull(), F.col("_edge")).otherwise(F.col("_from")))


def group_by_time(traj: DataFrame, every: str = "1 day", offset: str = "0 hours", add_starting_location: bool = False) -> DataFrame:
    """``traj`` with ``group`` (from 0) and ``window_start``: windows of length ``every`` from midnight of the first day plus ``offset``.

    Windows without points have no number. Points before the first window, or in one that doesn't fit before the day after
    the last plus the offset, are left out. With ``add_starting_location`` the last point of a group also leads the next.
    """
    rows = traj.where(F.col("datetime").isNotNull())
    span = rows.agg(F.date_trunc("day", F.min("datetime")).alias("a"), F.date_trunc("day", F.max("datetime")).alias("b"))
    span = span.select(F.unix_micros(F.expr(f"a + interval {offset}").cast("timestamp")).alias("a"), F.unix_micros(F.expr(f"b + interval 1 day + interval {offset}").cast("timestamp")).alias("b"), F.unix_micros(F.expr(f"(a + interval {every})").cast("timestamp")).alias("_e"), F.unix_micros(F.col("a").cast("timestamp")).alias("_a"))
    first = span.first()
    if first is None or first["a"] is None:
        return rows.limit(0).withColumns({"window_start": F.col("datetime"), "group": F.lit(0).cast("long")})
    start, end, length = first["a"], first["b"], first["_e"] - first["_a"]
    us = F.unix_micros(F.col("datetime").cast("timestamp"))
    slot = F.floor((us - F.lit(start)) / F.lit(length))
    kept = rows.withColumn("_slot", slot).where((F.col("_slot") >= 0) & ((F.col("_slot") + 1) * F.lit(length) + F.lit(start) <= F.lit(end)))
    used = sorted(r[0] for r in kept.select("_slot").distinct().collect())  # one number per window of time
    table = traj.sparkSession.createDataFrame([(int(s), i) for i, s in enumerate(used)] or [(-1, -1)], "_s long, group long")
    out = kept.join(F.broadcast(table), kept["_slot"] == table["_s"])
    names = [*traj.columns, "group", "window_start"]
    out = out.withColumn("window_start", F.timestamp_micros(F.lit(start) + F.col("_slot") * F.lit(length)).cast(traj.schema["datetime"].dataType)).select(*names)
    if add_starting_location:
        fields = F.struct("datetime", *[c for c in traj.columns if c != "datetime"])
        last = out.groupBy("group").agg(F.max(fields).alias("p"))
        starts = out.select("group", "window_start").distinct()
        lead = last.select((F.col("group") + 1).alias("group"), "p").join(starts, "group").select(*[F.col("p")[c].alias(c) for c in traj.columns], "group", "window_start")
        out = out.unionByName(lead)
    return out


def bounds(points: DataFrame) -> DataFrame:
    """One row: ``min_lng``, ``min_lat``, ``max_lng``, ``max_lat``."""
    return points.agg(F.min("lng").alias("min_lng"), F.min("lat").alias("min_lat"), F.max("lng").alias("max_lng"), F.max("lat").alias("max_lat"))


def area_bounds(tiles: DataFrame) -> DataFrame:
    """One row: the bounds of all corners of tiles with rings of {x, y}."""
    corners = tiles.select(F.explode(F.flatten("geometry")).alias("p"))
    return corners.agg(F.min("p.x").alias("min_lng"), F.min("p.y").alias("min_lat"), F.max("p.x").alias("max_lng"), F.max("p.y").alias("max_lat"))


def to_web_mercator(tiles: DataFrame) -> DataFrame:
    """Tiles with their rings in metres of Web-Mercator instead of degrees."""
    return tiles.withColumn("geometry", F.transform("geometry", lambda r: F.transform(r, lambda p: F.struct(mercator_x(p["x"]).alias("x"), mercator_y(p["y"]).alias("y")))))


def _shoelace() -> Column:
    """{a, x, y}: twice the signed area, and the moments of the first ring, relative to its first corner."""
    ring = "geometry[0]"
    term = f"i -> named_struct('c', ({ring}[i].x - {ring}[0].x) * ({ring}[i + 1].y - {ring}[0].y) - ({ring}[i + 1].x - {ring}[0].x) * ({ring}[i].y - {ring}[0].y), 'x', {ring}[i].x + {ring}[i + 1].x - 2 * {ring}[0].x, 'y', {ring}[i].y + {ring}[i + 1].y - 2 * {ring}[0].y)"
    return F.expr(f"aggregate(transform(sequence(0, size({ring}) - 2), {term}), named_struct('a', 0D, 'x', 0D, 'y', 0D), (s, t) -> named_struct('a', s.a + t.c, 'x', s.x + t.x * t.c, 'y', s.y + t.y * t.c))")


def centroids(tiles: DataFrame) -> DataFrame:
    """``tiles`` with ``lat``, ``lng``: the planar centroid of the border (of a degenerate one its first corner)."""
    s = _shoelace()
    x = F.when(s["a"] == 0, F.lit(0.0)).otherwise(s["x"] / (3 * F.nullif(s["a"], F.lit(0.0))))
    y = F.when(s["a"] == 0, F.lit(0.0)).otherwise(s["y"] / (3 * F.nullif(s["a"], F.lit(0.0))))
    return tiles.withColumns({"lat": F.expr("geometry[0][0].y") + y, "lng": F.expr("geometry[0][0].x") + x})


def flow_between(flows: DataFrame, tiles: DataFrame, origin: str, destination: str, tile_id: str = "tile_ID") -> DataFrame:
    """One row ``origin``, ``destination``, ``flow``: 0 where there is none, the sum where there are several. Unknown tiles are an error."""
    known = {r[0] for r in tiles.where(F.col(tile_id).cast("string").isin(origin, destination)).select(F.col(tile_id).cast("string")).distinct().collect()}
    if {origin, destination} - known:
        raise ValueError(f"unknown tiles: {sorted({origin, destination} - known)}")
    found = flows.where((F.col("origin") == origin) & (F.col("destination") == destination)).agg(F.coalesce(F.sum("flow"), F.lit(0)).alias("flow"))
    return found.select(F.lit(origin).alias("origin"), F.lit(destination).alias("destination"), "flow")


def flow_matrix(flows: DataFrame, tiles: DataFrame, tile_id: str = "tile_ID") -> DataFrame:
    """The matrix of flows: a row per tile (``origin``), a column per tile, zeros where there is none; several rows of a pair are added.

    As many columns as tiles: the pivot's own limit (``spark.sql.pivotMaxValues``) holds.
    """
    ids = sorted(r[0] for r in tiles.select(F.col(tile_id).cast("string")).distinct().collect())
    wide = flows.groupBy("origin").pivot("destination", ids).agg(F.sum("flow"))
    out = tiles.select(F.col(tile_id).cast("string").alias("origin")).distinct().join(wide, "origin", "left")
    return out.fillna(0)


def check_flows(flows: DataFrame, tiles: DataFrame, tile_id: str = "tile_ID") -> None:
    """Raises ValueError if an origin or destination isn't a tile."""
    ids = tiles.select(F.col(tile_id).cast("string").alias("t"))
    for c in ("origin", "destination"):
        if flows.where(F.col(c).isNotNull()).join(ids, F.col(c).cast("string") == F.col("t"), "left_anti").limit(1).count():
            raise ValueError(f"there are values of {c} that are no tiles")

