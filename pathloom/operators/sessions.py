"""Sessions: activity of a key between silences.

Each key has an open session and a timer (:mod:`pathloom.operators.timers`). Batch input is put in order by key and
time, and the timers run over it as over a stream, from one Arrow batch to the next; the same timers join what hot keys'
cuts have parted, and run in :mod:`pathloom.streaming.sessions`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.operators.ordered import changed, column, find_cuts, micros
from pathloom.operators.timers import Timer
from pathloom.session import written

_NAMES = ["k", "chunk", "start_us", "end_us", "n", "edge"]


def _closed(known: pa.Table, at: np.ndarray, start, last, n, edge) -> pa.RecordBatch:
    own = known.take(pa.array(at))
    return pa.record_batch([own.column("k").combine_chunks(), own.column("chunk").combine_chunks(), start, last, n, edge], names=_NAMES)


def _timed(batches: Iterator[pa.RecordBatch], gap: int, same: list[str], pieces: bool) -> Iterator[pa.RecordBatch]:
    """The sessions of ordered events, or of ordered ``pieces`` of sessions; rows equal in ``same`` to the one before are passed over."""
    timer, before, led = Timer(gap), None, False  # the last row, and whether the open session leads its group
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.table(b) if before is None else pa.concat_tables([before, pa.table(b)]).combine_chunks()
        fresh = np.zeros(t.num_rows, bool)
        fresh[1:] = changed(t.column("k").chunk(0))
        if not pieces:
            fresh[1:] |= changed(t.column("chunk").chunk(0))
        new = fresh.copy()
        for c in same:
            new[1:] |= changed(t.column(c).chunk(0))
        new = new if same else np.ones(len(new), bool)
        new[0] = before is None  # else it was taken in before
        before = t.slice(t.num_rows - 1)
        i = np.flatnonzero(new)
        if not len(i):
            continue
        other = fresh[i]
        start, last, n = (column(t, c)[i] for c in ("start_us", "end_us", "n")) if pieces else (column(t, "us")[i], None, None)
        begin, end, many, first, ended = timer.advance(start, last, n, other)
        # the key is that of the row before the one that ended the session
        edge = (column(t, "chunk")[i[ended] - 1] >= 0) & (np.where(first >= 0, other[first] | ((i[first] == 0) & new[0]), led) | other[ended])
        yield _closed(t, i[ended] - 1, begin, end, many, edge)
        if len(ended) or (new[0] and i[0] == 0):
            opened = int(ended[-1]) if len(ended) else 0
            led = bool(other[opened] or (opened == 0 and new[0]))
    if (left := timer.expire()) is not None:
        hot = column(before, "chunk") >= 0
        yield _closed(before, np.zeros(1, np.int64), *(np.array([v]) for v in left), hot)


def sessions(events: DataFrame, key: str = "uid", time: str = "datetime", gap_s: float = 1800, copies: list[str] | None = None) -> DataFrame:
    """One row per session: ``key``, ``start_us``, ``end_us`` (microseconds), ``duration_s``, ``n``.

    A session begins at a key's first event and at each event more than ``gap_s`` after the one before. Events with a
    null key or time are left out. Rows equal in key, time and the columns ``copies`` count as one event; without
    ``copies`` each row counts. Ties in time belong to one session. Other columns, whatever their names, are ignored;
    an empty table gives an empty result.
    """
    gap = int(round(gap_s * 1e6))
    # without copies the rows of one time are told apart by any number, so that even they can be cut
    extra = [F.col(c).alias(f"c{i}") for i, c in enumerate(copies)] if copies is not None else [F.monotonically_increasing_id().alias("c0")]
    rows = events.select(F.col(key).alias("k"), micros(time).alias("us"), *extra)
    rows = rows.where(F.col("k").isNotNull() & F.col("us").isNotNull())
    order = ["us", *rows.columns[2:]]
    ties = [c for c in order if isinstance(rows.schema[c].dataType, T.DoubleType | T.LongType)]
    cuts = find_cuts(rows, "k", ties if ties == order[: len(ties)] else ["us"])
    rows = cuts.spread(rows, ["k", *order] if copies is not None else None)
    kind = rows.schema["k"].dataType.simpleString()
    schema = f"k {kind}, chunk int, start_us long, end_us long, n long, edge boolean"
    same = order if copies is not None else []
    parts = rows.repartition("k", "chunk").sortWithinPartitions("k", "chunk", *order).mapInArrow(lambda b: _timed(b, gap, same, False), schema)
    if cuts:
        # What touches a cut: at most two pieces per chunk of the hot keys.
        parts = written(parts, "sessions")
        edges = parts.where("edge").repartition("k").sortWithinPartitions("k", "chunk", "start_us", "end_us")
        parts = parts.where("not edge").unionByName(edges.mapInArrow(lambda b: _timed(b, gap, [], True), schema))
    return parts.select(F.col("k").alias(key), "start_us", "end_us", ((F.col("end_us") - F.col("start_us")) / F.lit(1e6)).alias("duration_s"), "n")
