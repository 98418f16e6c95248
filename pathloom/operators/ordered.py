"""Ordered per-key work that stays balanced when one key holds a large part of all rows.

Rows are spread by (key, chunk) in one shuffle. A key with few rows is one group (chunk -1). A hot key is cut along
its order columns into chunks of a size that doesn't grow with the data; what spans a cut is joined afterwards from
compact states, two per chunk.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.session import written

#: Rows of a chunk, whatever the input; a key with clearly fewer isn't cut, and hardly any group has twice as many.
CHUNK_ROWS = 100_000
#: Rows of a chunk's share in the sample from which cuts are taken.
SAMPLE = 256
#: Cuts that are sent to every task (about 24 bytes each). Of more, every ``FAN_OUT``-th is sent, and rows meet the others in a join.
MOST_CUTS = 1_000_000
FAN_OUT = 1024


def micros(column) -> Column:
    """A timestamp as microseconds since 1970 in UTC (the session's time zone is taken to be UTC)."""
    return F.unix_micros((F.col(column) if isinstance(column, str) else column).cast("timestamp"))


def _below(bounds: list[np.ndarray], rows: list[np.ndarray]) -> np.ndarray:
    """For each row the number of bounds that are not above it, in the order of the columns; both are lists of columns, bounds sorted."""
    lo, hi = (np.searchsorted(bounds[0], rows[0], side) for side in ("left", "right"))
    out = hi
    tied = np.flatnonzero(hi > lo) if len(bounds) > 1 else ()
    if len(tied):
        for a in np.unique(lo[tied]):
            own = tied[lo[tied] == a]
            out[own] = a + _below([c[a : hi[own[0]]] for c in bounds[1:]], [c[own] for c in rows[1:]])
    return out


def _ranked(column: pa.Array) -> np.ndarray:
    """A column as numbers in Spark's order: nulls first."""
    if pa.types.is_floating(column.type):
        return column.fill_null(-np.inf).to_numpy(zero_copy_only=False)
    return column.fill_null(np.iinfo(np.int64).min).cast(pa.int64()).to_numpy(zero_copy_only=False)


@dataclasses.dataclass
class Cuts:
    """Where hot keys are cut: the rows at which their chunks after the first begin.

    ``bounds``: by key the columns of ``order``, ascending. ``fine``: None, or a table ``_ck, _coarse, _fine`` with the bounds
    between those, for inputs with more cuts than are sent to every task.
    """

    key: str
    order: list[str]
    bounds: dict
    fine: DataFrame | None = None

    def __bool__(self) -> bool:
        return bool(self.bounds)

    @classmethod
    def of(cls, table: DataFrame, key: str, order: list[str]) -> Cuts:
        """Cuts from a table of bounds, which is written in between."""
        table = written(table.select(key, *order), "cuts")
        fine = None
        if table.count() > MOST_CUTS:
            w = Window.partitionBy(key).orderBy(*order)
            table = written(table.withColumn("_n", F.row_number().over(w)), "cuts")
            coarse = F.floor((F.col("_n") - 1) / F.lit(FAN_OUT)).cast("int")
            fine = table.withColumn("_coarse", coarse).where(F.pmod("_n", F.lit(FAN_OUT)) != 1)
            fine = fine.groupBy(F.col(key).alias("_ck"), (F.col("_coarse") + 1).alias("_coarse")).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("_fine"))  # under FAN_OUT each
            table = table.where(F.pmod("_n", F.lit(FAN_OUT)) == 1).drop("_n")
        by: dict = {}
        for r in table.collect():  # at most MOST_CUTS, or a FAN_OUT-th of all
            by.setdefault(r[0], []).append(tuple(r)[1:])
        kinds = [np.float64 if isinstance(f.dataType, T.DoubleType) else np.int64 for f in table.select(*order).schema.fields]
        return cls(key, list(order), {k: [np.array(c, t) for c, t in zip(zip(*sorted(v)), kinds)] for k, v in by.items()}, fine)

    def spread(self, df: DataFrame, copies: list[str] | None = None) -> DataFrame:
        """``df`` with its ``chunk``: -1 for keys that aren't hot. Rows equal in ``copies`` are combined map-side on the way (see :func:`drop_copies`)."""
        if not self.bounds and not copies:
            return df.withColumn("chunk", F.lit(-1))
        key, order = self.key, self.order
        held = df.sparkSession.sparkContext.broadcast(self.bounds)  # at most MOST_CUTS entries

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bounds = held.value
            hot, known = pa.array(list(bounds)), None
            for b in batches:
                if copies:
                    b = drop_copies(b, copies)
                chunk = np.full(b.num_rows, -1, np.int32)
                if bounds and b.num_rows:
                    known = hot.cast(b.column(key).type) if known is None else known
                    which = pc.index_in(b.column(key), known).fill_null(-1).to_numpy(zero_copy_only=False)
                    own_key = np.unique(which[which >= 0])
                    columns = [_ranked(b.column(c)) for c in order] if len(own_key) else []
                    for j in own_key:
                        own = np.flatnonzero(which == j)
                        chunk[own] = _below(bounds[hot[int(j)].as_py()], [c[own] for c in columns])
                yield pa.record_batch([*b.columns, pa.array(chunk)], names=[*b.schema.names, "chunk"])

        out = df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("chunk", T.IntegerType())]))
        if self.fine is None:
            return out
        # chunk is coarse so far: what lies between two bounds that were sent meets those in between
        row = F.struct(*[F.coalesce(F.col(c), F.lit(-np.inf if isinstance(df.schema[c].dataType, T.DoubleType) else -(2**63)).cast(df.schema[c].dataType)).alias(c) for c in order])
        near = self.fine.withColumnRenamed("_coarse", "_cc")
        out = out.join(near, (F.col(key) == F.col("_ck")) & (F.col("chunk") == F.col("_cc")), "left")
        inner = F.coalesce(F.size(F.filter("_fine", lambda c: c <= row)), F.lit(0))
        inner = F.when(F.col("_fine").isNull(), 0).otherwise(inner)
        chunk = F.when(F.col("chunk") < 0, -1).otherwise(F.col("chunk") * F.lit(FAN_OUT) + inner).cast("int")
        return out.select(*df.columns, chunk.alias("chunk"))


def find_cuts(df: DataFrame, key: str, order: list[str], size: int | None = None) -> Cuts:
    """Where to cut the hot keys of ``df`` along the columns ``order`` (long or double), so that chunks hold about ``size`` rows.

    One pass takes an even sample, about ``SAMPLE`` rows for each chunk; in its order every so many-th row of a key begins
    a chunk. A key with fewer sampled rows isn't hot. Ties in the first column are cut along the next, and so on; only rows
    equal in all of them stay together. Nulls in key or the first column are left out.
    """
    size = size or CHUNK_ROWS
    each = min(SAMPLE, size)
    names = [f"_c{i}" for i in range(len(order))]
    rows = df.where(F.col(key).isNotNull() & F.col(order[0]).isNotNull()).select(F.col(key).alias("_k"), *[F.col(c).alias(n) for c, n in zip(order, names)])
    sample = rows.where(F.rand(20110201) < F.lit(each / size)) if each < size else rows
    for c, n in zip(order, names):
        least = F.lit(float("-inf")) if isinstance(df.schema[c].dataType, T.DoubleType) else F.lit(-(2**63)).cast("long")
        sample = sample.withColumn(n, F.coalesce(F.col(n), least))
    sample = written(sample, "sample")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(0)
            new = np.r_[k[0].as_py() != last, changed(k)]
            at = np.flatnonzero(new)
            place = np.arange(b.num_rows) + (0 if new[0] else n)
            if len(at):
                place[at[0] :] = np.arange(at[0], b.num_rows) - np.repeat(at, np.diff(np.r_[at, b.num_rows]))
            last, n = k[b.num_rows - 1].as_py(), int(place[-1]) + 1
            yield b.take(pa.array(np.flatnonzero((place > 0) & (place % each == 0))))

    hot = sample.groupBy("_k").agg(F.count("*").alias("_n")).where(F.col("_n") > each)
    if not hot.limit(1).count():
        return Cuts(key, list(order), {})
    near = sample.join(hot.select("_k"), "_k", "left_semi").select("_k", *names)
    picked = near.orderBy("_k", *names).mapInArrow(pick, near.schema)
    cuts = Cuts.of(picked.distinct(), "_k", names)
    return Cuts(key, list(order), cuts.bounds, cuts.fine)


def drop_copies(b: pa.RecordBatch, keys: list[str]) -> pa.RecordBatch:
    """Map-side combining of rows equal in ``keys`` (the first stays), so that a row copied without end shrinks before the shuffle.

    Only copies within one Arrow batch meet here; the ordered kernels drop the rest, which sorting has made neighbours.
    """
    h = np.zeros(b.num_rows, np.uint64)
    with np.errstate(over="ignore"):
        for k in keys:
            h = (h ^ bits(b.column(k))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    o = np.argsort(h, kind="stable")
    same = np.r_[False, h[o][1:] == h[o][:-1]][: len(o)]
    if same.any():
        for k in keys:  # equal hashes are not yet equal rows
            same[1:] &= ~changed(b.column(k).take(pa.array(o)))
        b = b.take(pa.array(np.sort(o[~same])))
    return b


def bits(column: pa.Array) -> np.ndarray:
    """64 bits for each value; equal values have equal bits."""
    if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
        x = column.fill_null(0).to_numpy(zero_copy_only=False)
        return (x + 0.0).view(np.uint64) if x.dtype == np.float64 else x.astype(np.int64).view(np.uint64)
    e = column.dictionary_encode()
    words = np.array([hash(x) & (2**64 - 1) for x in e.dictionary.to_pylist()] + [0], np.uint64)
    return words[e.indices.fill_null(len(words) - 1).to_numpy(zero_copy_only=False)]


def changed(column: pa.Array) -> np.ndarray:
    """For each value but the first, whether it differs from the one before; nulls are equal to nulls."""
    a, b = column.slice(1), column.slice(0, max(0, len(column) - 1))
    differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    if column.null_count:
        differs = differs | (np.asarray(a.is_null()) != np.asarray(b.is_null()))
    return differs


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 100_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of sorted rows that hold whole groups, and for each row whether a group starts there."""
    kept: list[pa.RecordBatch] = []
    rows = 0

    def joined() -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(kept).combine_chunks()
        starts = np.zeros(t.num_rows, bool)
        starts[:1] = True
        for k in keys:
            starts[1:] |= changed(t.column(k).combine_chunks() if t.column(k).num_chunks != 1 else t.column(k).chunk(0))
        return t, starts

    goal = least
    for b in batches:
        if b.num_rows:
            kept.append(b)
            rows += b.num_rows
        if rows >= goal:
            t, starts = joined()
            last = int(np.flatnonzero(starts)[-1])
            if last:
                yield t.slice(0, last).combine_chunks(), starts[:last]
                t = t.slice(last)
            kept, rows = t.to_batches(), t.num_rows
            goal = max(least, 2 * rows)  # a group larger than the buffer isn't looked at again for each batch
    if rows:
        yield joined()


def column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def ordered_map(df: DataFrame, key: str, order: list[str], kernel: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``kernel`` over whole (key, chunk) groups in the order of ``order``: one shuffle, no group beyond a chunk's size."""
    part = df.repartition(key, "chunk").sortWithinPartitions(key, "chunk", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, [key, "chunk"]):
            yield from kernel(t, starts)

    return part.mapInArrow(run, schema)


def running(df: DataFrame, order: list, name: str, value: Column | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` (default 1, which numbers the rows from 0) over the rows before in the order of all rows.

    Rows are sorted by ranges, each range is summed up by itself, and the sums of the ranges, one row each, are added.
    """
    names = df.columns
    ranges = df.withColumn("_v", F.lit(1).cast("long") if value is None else value).orderBy(*order).select(F.struct(*names).alias("_row"), "_v", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i"))
    ranges = written(ranges, "ranges")
    sums = ranges.groupBy("_p").agg(F.sum("_v").alias("_s"))
    sums = sums.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))  # a row per range
    own = F.coalesce(F.sum("_v").over(Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = ranges.withColumn("_b", own).join(F.broadcast(sums), F.col("_p") == F.col("_q"))
    return out.select(*[F.col("_row")[c].alias(c) for c in names], (F.col("_o") + F.col("_b")).alias(name))


def with_previous(df: DataFrame, key: str, order: list[str], values: dict[str, str], time: str | None = None) -> DataFrame:
    """``df`` with columns of the row before in the key's order: ``values`` maps new names to columns.

    ``time`` (default: the first of ``order``) is the timestamp along which hot keys are cut; a cut's first row gets the
    last row of the chunk before from a table of one row per chunk. Rows with a null key or time are left out.
    """
    time = time or order[0]
    # The row itself is packed, so that no column of it can clash with those in between.
    rows = df.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    rows = rows.select(F.col(key).alias("_k"), micros(time).alias("_us"), F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]).alias("_o"), F.struct("*").alias("_row"))
    cuts = find_cuts(rows.select("_k", "_us"), "_k", ["_us"])
    by = ["_k"]
    if cuts:
        rows, by = cuts.spread(rows), ["_k", "chunk"]
    own = F.struct(*[F.col("_row")[c].alias(n) for n, c in values.items()])
    rows = rows.withColumn("_prev", F.lag(own).over(Window.partitionBy(*by).orderBy("_o")))
    if cuts:
        last = rows.where("chunk >= 0").groupBy("_k", "chunk").agg(F.max(F.struct("_o", own.alias("_own")))["_own"].alias("_own"))
        before = last.withColumn("_edge", F.lag("_own").over(Window.partitionBy("_k").orderBy("chunk"))).select(F.col("_k").alias("_k2"), F.col("chunk").alias("_c"), "_edge")
        rows = rows.join(before, (F.col("_k") == F.col("_k2")) & (F.col("chunk") == F.col("_c")), "left")  # a row per chunk
        rows = rows.withColumn("_prev", F.coalesce("_prev", "_edge"))
    return rows.select(*[F.col("_row")[c].alias(c) for c in df.columns], *[F.col("_prev")[n].alias(n) for n in values])


def grouped_map(df: DataFrame, keys: list[str], order: list[str], kernel: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``kernel`` over tables of whole groups in order, many groups at a time; for folds that can't be cut. Without keys all rows are one group."""
    part = df.repartition(*keys) if keys else df.repartition(1)
    part = part.sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, keys):
            yield from kernel(t, starts)

    return part.mapInArrow(run, schema)
