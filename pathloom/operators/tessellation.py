"""Tessellations: squares, point tiles (whose cells are the nearest-point regions), and a registry by name."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.functions.geo import EARTH_RADIUS_KM, mercator_lat, mercator_lng
from pathloom.operators.near import Zones
from pathloom.operators.ordered import running

_REGISTRY: dict[str, Callable] = {}


def register(name: str, build: Callable) -> None:
    _REGISTRY[name] = build


def get(name: str, *args, **kwargs) -> DataFrame:
    """The tessellation of the builder registered as ``name``; ValueError if there is none."""
    if name not in _REGISTRY:
        raise ValueError(f"unknown tessellation {name!r}; there are {sorted(_REGISTRY)}")
    return _REGISTRY[name](*args, **kwargs)


def _metres(lng: float, lat: float) -> tuple[float, float]:
    return math.radians(lng) * 6378137.0, 6378137.0 * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))


def _crosses(x0, y0, x1, y1, edges: np.ndarray) -> np.ndarray:
    """Which squares [x0, x1] x [y0, y1] touch any of the edges (ax, ay, bx, by)."""
    hit = np.zeros(len(x0), bool)
    for ax, ay, bx, by in edges:
        dx, dy = bx - ax, by - ay
        low, high = np.zeros(len(x0)), np.ones(len(x0))
        ok = np.ones(len(x0), bool)
        for d, a, lo, hi in ((dx, ax, x0, x1), (dy, ay, y0, y1)):
            if d == 0:
                ok &= (a >= lo) & (a <= hi)
            else:
                t0, t1 = (lo - a) / d, (hi - a) / d
                low, high = np.maximum(low, np.minimum(t0, t1)), np.minimum(high, np.maximum(t0, t1))
        hit |= ok & (low <= high)
    return hit


def squares(spark: SparkSession, base: list | tuple, meters: float = 50) -> DataFrame:
    """Squares of ``meters`` in Web-Mercator: ``tile_ID`` (running from "0", x before y), ``geometry`` in degrees.

    ``base`` is a bounding box (min lng, min lat, max lng, max lat), or a list of rings of (lng, lat), of which squares
    that touch none are left out.
    """
    rings = None
    if isinstance(base, tuple) and len(base) == 4:
        box = base
    else:
        rings = [[_metres(*p) for p in ring] for ring in base]
        points = [p for ring in base for p in ring]
        box = (min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points))
    (ax, ay), (bx, by) = _metres(box[0], box[1]), _metres(box[2], box[3])
    nx, ny = max(1, math.ceil((bx - ax) / meters)), max(1, math.ceil((by - ay) / meters))
    i, j = F.floor(F.col("id") / ny), F.col("id") % ny
    grid = spark.range(nx * ny).select(F.col("id"), (F.lit(ax) + i * F.lit(float(meters))).alias("x0"), (F.lit(ay) + j * F.lit(float(meters))).alias("y0"))
    if rings is not None:
        edges = np.array([(*p, *q) for ring in rings for p, q in zip(ring, [*ring[1:], ring[0]])])
        zone = Zones([rings])

        def touching(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x0, y0 = b["x0"].to_numpy(), b["y0"].to_numpy()
                hit = _crosses(x0, y0, x0 + meters, y0 + meters, edges)
                inside, _ = zone.containing(y0, x0)
                hit[inside] = True
                yield b[hit]

        grid = grid.mapInPandas(touching, grid.schema)
        # ids run over the squares left: counts by block of ids, then a rank within the block
        block = F.floor(F.col("id") / 65536)
        grid = grid.withColumn("_b", block)
        before = grid.groupBy("_b").agg(F.count("*").alias("_n"))
        before = before.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
        rank = F.row_number().over(Window.partitionBy("_b").orderBy("id")) - 1
        grid = grid.withColumn("_r", rank).join(before, "_b").withColumn("id", F.col("_o") + F.col("_r"))
    x0, x1, y0, y1 = mercator_lng(F.col("x0")), mercator_lng(F.col("x0") + F.lit(float(meters))), mercator_lat(F.col("y0")), mercator_lat(F.col("y0") + F.lit(float(meters)))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(point(x0, y0), point(x0, y1), point(x1, y1), point(x1, y0), point(x0, y0))
    return grid.select(F.col("id").cast("string").alias("tile_ID"), F.array(ring).alias("geometry"))


def point_tiles(points: DataFrame, order: list[str] | None = None) -> DataFrame:
    """``points`` as tiles: ``tile_ID`` "0", "1", ... in the order given. Mapping to the nearest (see spatial) makes their cells."""
    return running(points, order or ["lat", "lng"], "_n").withColumn("tile_ID", F.col("_n").cast("string")).drop("_n")


# Average edge length (km) and area (km2) of the cells of the public hexagonal grid, by resolution 0 to 15.
HEXAGON_EDGE_KM = (1107.712591, 418.6760055, 158.2446558, 59.81085794, 22.6063794, 8.544408276, 3.229482772, 1.220629759, 0.461354684, 0.174375668, 0.065907807, 0.024910561, 0.009415526, 0.003559893, 0.001348575, 0.000509713)
HEXAGON_AREA_KM2 = (4250546.8477, 607220.9782429, 86745.8540347, 12392.2648621, 1770.3235517, 252.9033645, 36.1290521, 5.1612932, 0.7373276, 0.1053325, 0.0150475, 0.0021496, 0.0003071, 0.0000439, 0.0000063, 0.0000009)


def hexagon_resolution(meters: float, area_km2: float | None = None) -> int:
    """The resolution whose edges are nearest to ``meters``; if its cells (or finer ones) are larger than the area to cover, one
    coarser than the finest that still is."""
    res = int(np.argmin(np.abs(np.array(HEXAGON_EDGE_KM) - meters / 1000)))
    if area_km2 is not None:
        larger = [r for r, a in enumerate(HEXAGON_AREA_KM2) if a > area_km2]
        if larger and res <= larger[-1]:
            return max(0, larger[-1] - 1)
    return res


def area_km2(base: list | tuple) -> float:
    """The area of a bounding box, or of rings (the first less the others), by an equal-area projection of the sphere."""
    if isinstance(base, tuple) and len(base) == 4:
        x0, y0, x1, y1 = base
        base = [[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]]
    sizes = []
    for ring in base:
        p = np.array(ring, float)
        x, y = EARTH_RADIUS_KM * np.radians(p[:, 0]), EARTH_RADIUS_KM * np.sin(np.radians(p[:, 1]))
        sizes.append(abs(float(np.dot(x, np.roll(y, -1)) - np.dot(np.roll(x, -1), y))) / 2)
    return sizes[0] - sum(sizes[1:]) if sizes else 0.0


def hexagons(spark: SparkSession, base: list | tuple, meters: float = 500) -> DataFrame:
    """Hexagons with edges of the resolution nearest to ``meters``, in Web-Mercator rows: ``tile_ID``, ``geometry`` in degrees.

    The shape's area bounds the size of the cells (see :func:`hexagon_resolution`). Those whose centre lies in the shape are
    kept. ValueError if no centre does. The cells are this grid's own, not those
    of the public icosahedral grid, whose sizes it follows.
    """
    edge = HEXAGON_EDGE_KM[hexagon_resolution(meters, area_km2(base))] * 1000
    rings = None if isinstance(base, tuple) and len(base) == 4 else [[_metres(*p) for p in ring] for ring in base]
    if rings is None:
        (ax, ay), (bx, by) = _metres(base[0], base[1]), _metres(base[2], base[3])
    else:
        xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
        ax, ay, bx, by = min(xs), min(ys), max(xs), max(ys)
    wide, high = math.sqrt(3) * edge, 1.5 * edge
    i0, j0 = math.floor(ax / wide) - 1, math.floor(ay / high) - 1
    nx, ny = math.ceil(bx / wide) - i0 + 2, math.ceil(by / high) - j0 + 2
    i, j = F.col("id") % nx + F.lit(i0), F.floor(F.col("id") / nx) + F.lit(j0)
    x = (i + F.pmod(j, F.lit(2)) / F.lit(2.0)) * F.lit(wide)
    grid = spark.range(nx * ny).select(F.concat_ws("_", i, j).alias("tile_ID"), x.alias("x"), (j * F.lit(high)).alias("y"))
    if rings is None:
        grid = grid.where(F.col("x").between(ax, bx) & F.col("y").between(ay, by))
    else:
        zone = Zones([rings])

        def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                hit, _ = zone.containing(b["y"].to_numpy(), b["x"].to_numpy())
                yield b.iloc[np.sort(hit)]

        grid = grid.mapInPandas(inside, grid.schema)
    if not grid.limit(1).count():
        raise ValueError(f"no centre of hexagons with edges of {edge:.0f} m lies in the shape: give a smaller length")
    corner = [F.struct(mercator_lng(F.col("x") + F.lit(edge * math.sin(math.pi / 3 * k))).alias("x"), mercator_lat(F.col("y") + F.lit(edge * math.cos(math.pi / 3 * k))).alias("y")) for k in (*range(6), 0)]
    return grid.select("tile_ID", F.array(F.array(*corner)).alias("geometry"))


register("hexagonal", hexagons)
register("squared", squares)
register("voronoi", point_tiles)
