"""Per-key results where a handful of keys hold most rows.

Everything here is an algebraic aggregate or a mergeable ordered state: partial states are combined map-side in bounded,
spilling hash tables and only those cross the shuffle, so a hot key sends one small row per input partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.geo import haversine_km, haversine_np
from pathloom.operators.ordered import changed, column, find_cuts, micros, ordered_map


def key_summary(pings: DataFrame, key: str = "uid", lat: str = "lat", lng: str = "lng", time: str = "datetime") -> DataFrame:
    """Per key: rows, non-null positions, extents in space and time, and the first and last position in time.

    The null key is a group of its own. Extents leave nulls out and are null where all is null; of several positions at
    the first or last time the smallest (lat, lng) counts.
    """
    rows = pings.select(F.col(key).alias("k"), F.col(time).alias("t"), F.col(lat).alias("y"), F.col(lng).alias("x"))
    placed = F.col("y").isNotNull() & F.col("x").isNotNull() & F.col("t").isNotNull()
    # Only numbers are aggregated here, so that hash tables do it, map-side first.
    out = rows.groupBy("k").agg(
        F.count("*").alias("n_rows"), F.sum(placed.cast("long")).alias("n_placed"),
        F.min("y").alias("lat_min"), F.max("y").alias("lat_max"), F.min("x").alias("lng_min"), F.max("x").alias("lng_max"),
        F.min("t").alias("first_time"), F.max("t").alias("last_time"),
        F.min(F.when(placed, F.col("t"))).alias("_t0"), F.max(F.when(placed, F.col("t"))).alias("_t1"),
    )
    # Positions of the first and last time: rows meet these by key and time together, which no hot key makes lopsided.
    ends = out.where("_t0 is not null").select(F.col("k").alias("_k"), F.explode(F.array_distinct(F.array("_t0", "_t1"))).alias("_t"))
    found = rows.where(placed).join(ends, F.col("k").eqNullSafe(F.col("_k")) & (F.col("t") == F.col("_t")), "left_semi")
    found = found.groupBy("k", "t").agg(F.min(F.struct("y", "x")).alias("p"))
    for name, at in (("first", "_t0"), ("last", "_t1")):
        own = found.select(F.col("k").alias("_k"), F.col("t").alias("_t"), F.col("p.y").alias(f"{name}_lat"), F.col("p.x").alias(f"{name}_lng"))
        out = out.join(own, F.col("k").eqNullSafe(F.col("_k")) & (F.col(at) == F.col("_t")), "left").drop("_k", "_t")
    return out.select(F.col("k").alias(key), "n_rows", "n_placed", "lat_min", "lat_max", "lng_min", "lng_max", "first_time", "last_time", "first_lat", "first_lng", "last_lat", "last_lng")


def heavy_keys(rows: DataFrame, key: str = "uid", share: float = 0.04) -> DataFrame:
    """The non-null keys that hold at least ``share`` of all rows (rows with a null key count in the total)."""
    counts = rows.groupBy(F.col(key).alias(key)).agg(F.count("*").alias("n_rows"))
    total = rows.count()
    return counts.where(F.col(key).isNotNull() & (F.col("n_rows") >= F.lit(share) * F.lit(float(total)))).withColumn("share", F.col("n_rows") / F.lit(float(max(total, 1))))


def path_measures(pings: DataFrame, key: str = "uid", lat: str = "lat", lng: str = "lng", time: str = "datetime") -> DataFrame:
    """Measures that depend on order, per key: ``n``, ``path_km``, ``longest_jump_km``, ``longest_wait_s``.

    Rows with a null in key, time or position are left out, rows equal in all four count once, and ties in time are
    ordered by position. A chunk's state is (first, last, sums, maxima); states of a hot key's chunks are merged in order.
    """
    rows = pings.select(F.col(key).alias("k"), micros(time).alias("us"), F.col(lat).cast("double").alias("y"), F.col(lng).cast("double").alias("x")).dropna()
    rows = find_cuts(rows, "k", ["us", "y", "x"]).spread(rows, ["k", "us", "y", "x"])

    def kernel(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = starts.copy()
        for c in ("us", "y", "x"):
            new[1:] |= changed(t.column(c).chunk(0))
        t, starts = t.filter(pa.array(new)).combine_chunks(), starts[new]
        us, y, x = (column(t, c) for c in ("us", "y", "x"))
        at = np.flatnonzero(starts)
        end = np.r_[at[1:], len(us)] - 1
        jump, wait = np.zeros(len(us)), np.zeros(len(us))
        jump[1:], wait[1:] = haversine_np(y[:-1], x[:-1], y[1:], x[1:]), (us[1:] - us[:-1]) / 1e6
        jump[at] = wait[at] = 0
        yield pa.record_batch(
            [t.column("k").take(pa.array(at)).combine_chunks(), t.column("chunk").take(pa.array(at)).combine_chunks(), (end - at + 1).astype(np.int64), us[at], y[at], x[at], us[end], y[end], x[end], np.add.reduceat(jump, at), np.maximum.reduceat(jump, at), np.maximum.reduceat(wait, at)],
            names=["k", "chunk", "n", "us0", "y0", "x0", "us1", "y1", "x1", "path", "jump", "wait"],
        )

    kind = rows.schema["k"].dataType.simpleString()
    states = ordered_map(rows, "k", ["us", "y", "x"], kernel, f"k {kind}, chunk int, n long, us0 long, y0 double, x0 double, us1 long, y1 double, x1 double, path double, jump double, wait double")
    w = Window.partitionBy("k").orderBy("chunk")  # one row per chunk
    step = haversine_km(F.lag("y1").over(w), F.lag("x1").over(w), F.col("y0"), F.col("x0"))
    states = states.withColumns({"step": F.coalesce(step, F.lit(0.0)), "pause": F.coalesce((F.col("us0") - F.lag("us1").over(w)) / F.lit(1e6), F.lit(0.0))})
    return states.groupBy(F.col("k").alias(key)).agg(
        F.sum("n").alias("n"), F.sum(F.col("path") + F.col("step")).alias("path_km"), F.max(F.greatest("jump", "step")).alias("longest_jump_km"), F.max(F.greatest("wait", "pause")).alias("longest_wait_s")
    )
