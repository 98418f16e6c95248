"""Percentiles of very large numeric columns from dyadic Count-sketches.

A value is encoded as a code whose order is the value's and whose relative error is bounded: the highest bits of its
floating-point form. For each binary resolution (code without its lowest l bits) the codes are counted: exactly where a
resolution has at most ``width`` codes, which gives all coarser ones by addition, else by a signed Count-sketch of
``depth`` rows of ``width`` cells. Sketches are merged by adding cells, and rows are deleted by adding them with weight
-1. Percentiles descend the levels: at each node the estimated count of the left half decides which half holds the rank.

Sketches are made map-side, in hash tables of bounded size by group, so that only they are shuffled. As long as a group
has fewer codes than half the cells, its sketch is the codes themselves with their counts: smaller, and exact.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.operators.ordered import changed

_PRIME = (1 << 31) - 1
#: Entries of one row of a sketch's table, and of the table a task holds before it passes its sketches on.
ROW = 1024
MOST_HELD = 1_000_000


@dataclasses.dataclass(frozen=True)
class Shape:
    """What a sketch's errors follow from; only sketches of one shape can be merged.

    ``bits``: bits kept of a value below its highest, so a value is off by at most 2 ** -bits of itself. ``width`` (a power of
    two) and ``depth``: cells and rows of each level. A level's estimate is the median of ``depth`` estimates that each miss by
    more than ``2 * sqrt(F2 / width)`` with a chance of at most 1/4, F2 being the sum of squared counts at that level; so the
    rank of a percentile is off by at most the sum of these terms over the levels, but for a chance that falls
    exponentially with ``depth``. :func:`percentiles` returns that sum as ``rank_error``, F2 being estimated from the sketch.
    """

    bits: int = 11
    width: int = 256
    depth: int = 3

    @property
    def code_bits(self) -> int:
        return 12 + self.bits

    @property
    def levels(self) -> int:
        """The levels that are sketched; the next coarser one is counted exactly."""
        return max(0, self.code_bits - (self.width.bit_length() - 1))

    @property
    def cells(self) -> int:
        return self.width * (1 + self.levels * self.depth)

    def seeds(self) -> np.ndarray:
        return np.random.default_rng(20110201).integers(1, _PRIME, (self.levels, self.depth, 4))


def encode(x: np.ndarray, shape: Shape = Shape()) -> np.ndarray:
    """The code of each number: sign, exponent and the highest bits of its fraction, in the order of the numbers."""
    u = (np.asarray(x, np.float64) + 0.0).view(np.int64)
    u = u ^ ((u >> 63) & np.int64(2**63 - 1))
    return (u >> (52 - shape.bits)) + (1 << (shape.code_bits - 1))


def decode(code: np.ndarray, shape: Shape = Shape()) -> np.ndarray:
    """A value for each code: the middle of the whole numbers with that code, where there are any, else of all values with it."""
    low = (np.asarray(code, np.int64) - (1 << (shape.code_bits - 1))) << (52 - shape.bits)
    ends = []
    for u in (low, low + ((1 << (52 - shape.bits)) - 1)):
        ends.append((u ^ ((u >> 63) & np.int64(2**63 - 1))).view(np.float64))
    with np.errstate(invalid="ignore"):
        lo, hi = np.minimum(*ends), np.maximum(*ends)
        whole = np.ceil(lo) <= np.floor(hi)
        a, b = np.where(whole, np.ceil(lo), lo), np.where(whole, np.floor(hi), hi)
        out = a / 2 + b / 2
    return np.where(np.isfinite(ends[0]) & np.isfinite(ends[1]), out, np.where(low < 0, -np.inf, np.inf)) + 0.0


def _cells(code: np.ndarray, w: np.ndarray, shape: Shape) -> np.ndarray:
    """All cells of the codes' sketch: the exact level first, then by level and row."""
    out = [np.bincount(code >> shape.levels, w, shape.width)]
    for level, rows in enumerate(shape.seeds()):
        key = code >> level
        for a, b, c, d in rows:
            sign = 1 - 2 * ((key * c + d) % _PRIME % 2)
            out.append(np.bincount((key * a + b) % _PRIME % shape.width, w * sign, shape.width))
    return np.rint(np.concatenate(out)).astype(np.int64)


class Sketch:
    """One group's sketch: its codes while they are few, then cells."""

    def __init__(self, shape: Shape, few: int | None = None):
        self.shape, self.few = shape, shape.cells // 2 if few is None else few
        self.code, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.cells: np.ndarray | None = None
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add_codes(self, code: np.ndarray, count: np.ndarray) -> None:
        self.kept.append((code, count))
        self.held += len(code)
        if self.held > 4 * self.few + ROW:
            self.settle()

    def add_cells(self, at: np.ndarray, value: np.ndarray) -> None:
        if self.cells is None:
            self.cells = np.zeros(self.shape.cells, np.int64)
        np.add.at(self.cells, at, value)

    def settle(self) -> None:
        """Combines the codes; too many of them become cells."""
        if self.kept:
            code = np.concatenate([self.code, *[c for c, _ in self.kept]])
            count = np.concatenate([self.count, *[n for _, n in self.kept]])
            self.code, back = np.unique(code, return_inverse=True)
            self.count = np.zeros(len(self.code), np.int64)
            np.add.at(self.count, back, count)
            keep = self.count != 0
            self.code, self.count, self.kept, self.held = self.code[keep], self.count[keep], [], 0
        if len(self.code) and (self.cells is not None or len(self.code) > self.few):
            new = _cells(self.code, self.count.astype(float), self.shape)
            self.cells = new if self.cells is None else self.cells + new
            self.code, self.count = np.empty(0, np.int64), np.empty(0, np.int64)

    def parts(self) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
        """The sketch as rows of a table: (whether cells, which, how many)."""
        self.settle()
        at, value = (self.code, self.count) if self.cells is None else (np.flatnonzero(self.cells), self.cells[self.cells != 0])
        for a in range(0, len(at), ROW):
            yield self.cells is not None, at[a : a + ROW], value[a : a + ROW]

    def percentiles(self, wanted: list[float]) -> tuple[int, list[float | None], float]:
        """(count, values, most error of the rank as a part of the count); a percentile q is the value of rank ceil(q * count)."""
        self.settle()
        if self.cells is None:
            upto = np.cumsum(np.maximum(self.count, 0))
            total = int(self.count.sum())
            if total <= 0:
                return max(total, 0), [None] * len(wanted), 0.0
            at = np.searchsorted(upto, [max(1, np.ceil(q * total)) for q in wanted])
            return total, decode(self.code[np.minimum(at, len(upto) - 1)], self.shape).tolist(), 0.0
        shape, width = self.shape, self.shape.width
        exact = np.maximum(self.cells[:width], 0)
        total = int(self.cells[:width].sum())
        if total <= 0:
            return max(total, 0), [None] * len(wanted), 0.0
        rows = self.cells[width:].reshape(shape.levels, shape.depth, width)
        upto = np.cumsum(exact)
        rank = np.array([max(1.0, np.ceil(q * total)) for q in wanted])
        key = np.minimum(np.searchsorted(upto, rank), width - 1)
        rest, size = rank - (upto[key] - exact[key]), exact[key].astype(float)
        error, seeds = 0.0, shape.seeds()
        for level in range(shape.levels - 1, -1, -1):
            guess = []
            for child in (key * 2, key * 2 + 1):
                found = []
                for row, (a, b, c, d) in zip(rows[level], seeds[level]):
                    found.append(row[(child * a + b) % _PRIME % width] * (1 - 2 * ((child * c + d) % _PRIME % 2)))
                guess.append(np.median(found, axis=0))
            # both halves are estimates, and together they are the node: the difference is shared
            first = np.clip((guess[0] + size - guess[1]) / 2, 0, size)
            right = rest > first
            rest, size = np.where(right, rest - first, rest), np.where(right, size - first, first)
            key = key * 2 + right
            f2 = np.median((rows[level].astype(float) ** 2).sum(axis=1))
            error += 2 * np.sqrt(f2 / width) / total
        return total, decode(key, shape).tolist(), min(1.0, float(error))


_TABLE = [T.StructField("_dense", T.BooleanType()), T.StructField("_at", T.ArrayType(T.IntegerType())), T.StructField("_value", T.ArrayType(T.LongType()))]


def _rows_of(groups: pa.Table, sketches: list[Sketch]) -> pa.RecordBatch:
    found = [(i, *part) for i, s in enumerate(sketches) for part in s.parts()]
    own = groups.take(pa.array([f[0] for f in found], pa.int64()))
    ends = np.r_[0, np.cumsum([len(f[2]) for f in found])].astype(np.int32)
    join = lambda k, t: pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([f[k] for f in found]) if found else [], t))
    return pa.record_batch([*[own.column(g).combine_chunks() for g in own.schema.names], pa.array([f[1] for f in found], pa.bool_()), join(2, pa.int32()), join(3, pa.int64())], names=[*own.schema.names, "_dense", "_at", "_value"])


def sketch(rows: DataFrame, groups: list[str], value: str, weight: Column | None = None, shape: Shape = Shape(), few: int | None = None) -> DataFrame:
    """The sketches of ``value`` (any numeric column) by ``groups``: a table of one or more rows for each group and task.

    Null and NaN values are left out; null group keys are keys of their own. ``weight`` (a whole number, default 1) counts a
    row several times, or with -1 deletes it. ``few``: the number of codes up to which a group is kept as codes (default: half
    the cells; 0: never). Sketches of several days or files can be united and merged; see :func:`merge`.
    """
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    names = [f"_g{i}" for i in range(len(groups))]
    kept = rows.select(*[F.col(g).alias(n) for g, n in zip(groups, names)], F.col(value).cast("double").alias("_x"), w.alias("_w")).where("_x is not null and not isnan(_x) and _w <> 0")

    def emit(held: pa.Table) -> pa.RecordBatch:
        by = held.group_by(names).aggregate([("_c", "list"), ("_n", "list")]) if names else pa.table({"_c_list": [held.column("_c").to_pylist()], "_n_list": [held.column("_n").to_pylist()]})
        made = []
        codes, counts = (by.column(c).combine_chunks() for c in ("_c_list", "_n_list"))
        for i in range(by.num_rows):
            s = Sketch(shape, few)
            s.add_codes(codes[i].values.to_numpy(), counts[i].values.to_numpy())
            made.append(s)
        return _rows_of(by.select(names) if names else pa.table({"_": [0]}), made)

    def combined(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by([*names, "_c"]).aggregate([("_n", "sum")]).rename_columns([*names, "_c", "_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows_ = [], 0
        for b in batches:
            code = pa.array(encode(b.column("_x").to_numpy(zero_copy_only=False), shape).astype(np.int32))
            held.append(pa.table([*[b.column(n) for n in names], code, b.column("_w")], names=[*names, "_c", "_n"]))
            rows_ += b.num_rows
            if rows_ > MOST_HELD:
                held = [combined(held)]
                rows_ = held[0].num_rows
                if rows_ > MOST_HELD // 2:
                    yield emit(held[0])
                    held, rows_ = [], 0
        if rows_:
            yield emit(combined(held))

    fields = [T.StructField(n, rows.schema[g].dataType) for g, n in zip(groups, names)]
    one = [] if groups else [T.StructField("_", T.LongType())]
    out = kept.mapInArrow(run, T.StructType([*fields, *one, *_TABLE]))
    return out.select(*[F.col(n).alias(g) for g, n in zip(groups, names)], "_dense", "_at", "_value")


def _added(sketches: DataFrame, groups: list[str], shape: Shape, few: int | None, give, schema: T.StructType) -> DataFrame:
    """``give(group columns, sketches)`` over groups' sketches, each the sum of its rows; one group is held at a time."""
    names = [f"_g{i}" for i in range(len(groups))]
    rows = sketches.select(*[F.col(g).alias(n) for g, n in zip(groups, names)], "_dense", "_at", "_value")
    spread = rows.repartition(*names).sortWithinPartitions(*names) if groups else rows.repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = None, None  # the open sketch, and its group
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.table(b)
            keys = t.select(names) if names else pa.table({"_": np.zeros(b.num_rows, np.int64)})
            seen = keys if last is None else pa.concat_tables([last, keys]).combine_chunks()
            new = np.zeros(seen.num_rows, bool)
            new[0] = last is None
            for c in seen.schema.names:
                new[1:] |= changed(seen.column(c).combine_chunks() if seen.column(c).num_chunks != 1 else seen.column(c).chunk(0))
            new = new[seen.num_rows - b.num_rows :]
            dense = b.column("_dense").to_numpy(zero_copy_only=False)
            at, value = b.column("_at"), b.column("_value")
            ends, which, many = at.offsets.to_numpy(), at.values.to_numpy(), value.values.to_numpy()
            done, whose = [], []
            for i in range(b.num_rows):
                if new[i]:
                    if own is not None:
                        done.append(own)
                        whose.append(last if i == 0 else keys.slice(i - 1, 1))
                    own = Sketch(shape, few)
                z = slice(ends[i], ends[i + 1])
                (own.add_cells if dense[i] else own.add_codes)(which[z].astype(np.int64), many[z])
            if done:
                yield give(pa.concat_tables(whose), done)
            last = keys.slice(b.num_rows - 1)
        if own is not None:
            yield give(last, [own])

    return spread.mapInArrow(run, schema)


def merge(sketches: DataFrame, groups: list[str], shape: Shape = Shape(), few: int | None = None) -> DataFrame:
    """One sketch for each of the coarser ``groups`` (some, or none, of the columns), by adding codes and cells. Sketches of several
    files are united first. What was deleted cancels out."""
    kept = [T.StructField(f"_g{i}", sketches.schema[g].dataType) for i, g in enumerate(groups)] or [T.StructField("_", T.LongType())]
    out = _added(sketches, groups, shape, few, _rows_of, T.StructType([*kept, *_TABLE]))
    return out.select(*[F.col(f"_g{i}").alias(g) for i, g in enumerate(groups)], "_dense", "_at", "_value")


def percentiles(sketches: DataFrame, groups: list[str], wanted: list[float], shape: Shape = Shape(), few: int | None = None) -> DataFrame:
    """``groups``, ``n``, ``percentiles`` (an array in the order of ``wanted``) and ``rank_error`` of each group, whose sketches, in
    however many rows, are added up on the way.

    A percentile q is the value of rank ceil(q * n), within 2 ** -bits of itself and ``rank_error`` * n ranks (0 for a group kept
    as codes; see :class:`Shape`). Groups without rows, or with all of them deleted, are left out.
    """

    def give(keys: pa.Table, found: list[Sketch]) -> pa.RecordBatch:
        out = [s.percentiles(wanted) for s in found]
        return pa.record_batch([*[keys.column(g).combine_chunks() for g in keys.schema.names], pa.array([n for n, *_ in out], pa.int64()), pa.array([p for _, p, _ in out], pa.list_(pa.float64())), pa.array([e for *_, e in out], pa.float64())], names=[*keys.schema.names, "n", "percentiles", "rank_error"])

    kept = [T.StructField(f"_g{i}", sketches.schema[g].dataType) for i, g in enumerate(groups)] or [T.StructField("_", T.LongType())]
    schema = T.StructType([*kept, T.StructField("n", T.LongType()), T.StructField("percentiles", T.ArrayType(T.DoubleType())), T.StructField("rank_error", T.DoubleType())])
    out = _added(sketches, groups, shape, few, give, schema).where("n > 0")
    return out.select(*[F.col(f"_g{i}").alias(g) for i, g in enumerate(groups)], "n", "percentiles", "rank_error")
