"""Runs of identical or nearly identical consecutive events, each collapsed into one with its count and duration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.geo import haversine_km, haversine_np
from pathloom.operators.ordered import changed, column, find_cuts, micros, ordered_map
from pathloom.session import written


def collapse_runs(events: DataFrame, key: str = "uid", time: str = "datetime", lat: str = "lat", lng: str = "lng", near_km: float = 0.01, gap_s: float = 86_400) -> DataFrame:
    """One row per run: ``key``, ``start_us``, ``end_us``, ``duration_s``, ``n``, and the first event's ``lat``, ``lng``.

    An event continues the run of the event before it (its lag in the key's time order) if it lies at most ``near_km``
    from it and at most ``gap_s`` after it; else it changes to a new run. The flags of change, summed in order, number
    the runs, and each is aggregated. Rows with a null in any of the four columns are left out, rows equal in all four
    count once, ties in time are ordered by position, and other columns are ignored. Single events are runs of one.
    """
    gap = int(round(gap_s * 1e6))
    rows = events.select(F.col(key).alias("k"), micros(time).alias("us"), F.col(lat).cast("double").alias("y"), F.col(lng).cast("double").alias("x")).dropna()
    cuts = find_cuts(rows, "k", ["us", "y", "x"])
    rows = cuts.spread(rows, ["k", "us", "y", "x"])

    def kernel(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = starts.copy()
        for c in ("us", "y", "x"):
            new[1:] |= changed(t.column(c).chunk(0))
        t, starts = t.filter(pa.array(new)).combine_chunks(), starts[new]
        us, y, x = (column(t, c) for c in ("us", "y", "x"))
        change = starts.copy()
        change[1:] |= (us[1:] - us[:-1] > gap) | ~(haversine_np(y[:-1], x[:-1], y[1:], x[1:]) <= near_km)
        run = np.cumsum(change) - 1
        at = np.flatnonzero(change)
        end = np.r_[at[1:], len(us)] - 1
        first = starts[at]
        last = np.r_[first[1:], True]
        hot = column(t, "chunk")[at] >= 0
        yield pa.record_batch(
            [t.column("k").take(pa.array(at)).combine_chunks(), t.column("chunk").take(pa.array(at)).combine_chunks(), us[at], us[end], np.bincount(run).astype(np.int64), y[at], x[at], y[end], x[end], hot & first, hot & last],
            names=["k", "chunk", "start_us", "end_us", "n", "y0", "x0", "y1", "x1", "first", "last"],
        )

    kind = rows.schema["k"].dataType.simpleString()
    parts = ordered_map(rows, "k", ["us", "y", "x"], kernel, f"k {kind}, chunk int, start_us long, end_us long, n long, y0 double, x0 double, y1 double, x1 double, first boolean, last boolean")
    if cuts:
        # What touches a cut: at most two rows per chunk of the hot keys.
        parts = written(parts, "runs")
        w = Window.partitionBy("k").orderBy("chunk", "start_us", "end_us", "y0", "x0")
        joined = F.col("first") & F.lag("last").over(w) & (F.col("start_us") - F.lag("end_us").over(w) <= gap) & (haversine_km(F.lag("y1").over(w), F.lag("x1").over(w), F.col("y0"), F.col("x0")) <= near_km)
        run = F.sum((~F.coalesce(joined, F.lit(False))).cast("long")).over(w)
        head = F.min(F.struct("start_us", "end_us", "y0", "x0"))
        edge = parts.where("first or last").withColumn("run", run).groupBy("k", "run").agg(head.alias("h"), F.max("end_us").alias("end_us"), F.sum("n").alias("n"))
        names = ["k", "start_us", "end_us", "n", "y0", "x0"]
        parts = parts.where("not (first or last)").select(names).unionByName(edge.select("k", "h.start_us", "end_us", "n", "h.y0", "h.x0"))
    return parts.select(F.col("k").alias(key), "start_us", "end_us", ((F.col("end_us") - F.col("start_us")) / F.lit(1e6)).alias("duration_s"), "n", F.col("y0").alias("lat"), F.col("x0").alias("lng"))
