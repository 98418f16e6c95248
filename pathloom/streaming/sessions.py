"""Sessions over a stream, by keyed timers in event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pathloom.operators.timers import Timer


def session_stream(events: DataFrame, key: str = "uid", time: str = "datetime", gap_s: float = 1800, late: str = "60 days") -> DataFrame:
    """``key``, ``start_us``, ``end_us``, ``n`` of each session once its timer has run out (append mode).

    The key's state holds its sessions that aren't final yet, as (start, last, n): not events, so waiting long for late ones
    costs little. New events, late ones too, run through the timer together with these pieces, in order; a session is emitted
    when the watermark (``late`` behind the newest event) has passed its timer, as nothing can reach it then. Results are
    those of the batch operator as long as no event is later than ``late``; what is later, Spark's watermark drops.
    """
    gap = int(gap_s * 1e6)
    kind = events.schema[key].dataType.simpleString()
    rows = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("k"), F.col(time).cast("timestamp").alias("t")).withWatermark("t", late)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pieces = [np.array(c, np.int64) for c in (state.get if state.exists else ([], [], []))]
        events = [] if state.hasTimedOut else [b["t"].astype("datetime64[us]").astype("int64").to_numpy() for b in batches]
        us = np.concatenate([pieces[0], *events])
        last, n = (np.concatenate([c, *(e if v is None else np.full(len(e), v) for e in events)]) for c, v in ((pieces[1], None), (pieces[2], 1)))
        o = np.lexsort((last, us))
        timer, passed = Timer(gap), state.getCurrentWatermarkMs() * 1000
        start, last, n, *_ = timer.advance(us[o], last[o], n[o])
        if (open_ := timer.expire()) is not None:
            start, last, n = (np.r_[c, v] for c, v in zip((start, last, n), open_))
        final = last + gap < passed
        if final.all():
            state.remove()
        else:
            state.update(tuple(c[~final].tolist() for c in (start, last, n)))
            state.setTimeoutTimestamp(max((int(last[~final].min()) + gap) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if final.any():
            yield pd.DataFrame({"k": k[0], "start_us": start[final], "end_us": last[final], "n": n[final]})

    done = rows.groupBy("k").applyInPandasWithState(step, f"k {kind}, start_us long, end_us long, n long", "start array<long>, last array<long>, n array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return done.select(F.col("k").alias(key), "start_us", "end_us", "n")


def counts_stream(events: DataFrame, time: str = "datetime", window: str = "1 hour", late: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """``slot``, (``by``,) ``n_visits``: counts by tumbling window, each emitted when the watermark has passed its end (append mode)."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return rows.groupBy(F.window("_t", window), *(by or [])).agg(F.count("*").alias("n_visits")).select(F.col("window.start").alias("slot"), *(by or []), "n_visits")
