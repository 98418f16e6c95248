"""Implausible measurements of moving sources: impossible values, spikes and stuck readings.

Spikes are found by phase-space thresholding. For each ping the phase space has its offset from the way between its
neighbours (value), the speed of the step that leads to it (first difference) and the change of velocity there (second
difference). Robust scales, from medians, span an ellipsoid whose axes grow with the universal threshold sqrt(2 ln n);
pings outside are candidates. The speed axis is then iterated to its least fixed point: the highest speed left once
candidates that leave and regain the way at more than three times that speed are put aside. An exact check against
that speed follows. Runs of zero difference catch stuck readings, and bounds catch impossible values.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.geo import haversine_np
from pathloom.operators import ordered
from pathloom.operators.ordered import Cuts, changed, column, find_cuts, micros, ordered_map, whole_groups

DAY_US = 86_400_000_000


@dataclasses.dataclass(frozen=True)
class Limits:
    """What counts as a fault.

    ``first``, ``end``: plausible datetimes in microseconds; ``no_position``: pairs that stand for none; ``times``: how
    many times the highest normal speed a spike exceeds both ways; ``alone``: most pings of a spike; ``stuck``: least
    equal positions of a stuck run, which lasts less than ``stuck_s`` and after which the source is ``away_km`` off;
    ``repeats``: the share of repeated positions from which repeating is normal for a source.
    """

    first: int = 1_104_537_600_000_000
    end: int = 2_082_758_400_000_000
    no_position: tuple[tuple[float, float], ...] = ((0.0, 0.0),)
    times: float = 3.0
    alone: int = 3
    stuck: int = 6
    stuck_s: float = 1200
    away_km: float = 1.0
    repeats: float = 0.5

    def no_place(self) -> Column:
        """Positions out of range, or that stand for none; null where a null decides."""
        y, x = F.col("y"), F.col("x")
        out = F.isnan(y) | F.isnan(x) | (F.abs(y) > 90.0) | (F.abs(x) > 180.0)
        for a, b in self.no_position:
            out = out | ((y == a) & (x == b))
        return out

    def no_time(self) -> Column:
        return (F.col("us") < self.first) | (F.col("us") >= self.end)


#: Speeds in km/h are compared in steps of a hundredth of their size when chunks of a hot source are put together.
BINS_PER_E = 100


def _steps(us, y, x, starts):
    """Distance in km, hours and speed of the step to each ping; NaN at the start of a group."""
    d, h = np.full(len(us), np.nan), np.full(len(us), np.nan)
    d[1:], h[1:] = haversine_np(y[:-1], x[:-1], y[1:], x[1:]), (us[1:] - us[:-1]) / 3.6e9
    d[starts] = h[starts] = np.nan
    with np.errstate(divide="ignore", invalid="ignore"):
        v = d / h
    v[(h == 0) & (d == 0)] = 0
    return d, h, v


def _bridge(us, y, x, i, k):
    """Speed of the direct way from the ping before i to the one k after it."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return haversine_np(y[i - 1], x[i - 1], y[i + k], x[i + k]) / ((us[i + k] - us[i - 1]) / 3.6e9)


def _room(starts: np.ndarray) -> np.ndarray:
    """For each ping, how many of its group come after it."""
    at = np.flatnonzero(starts)
    end = np.r_[at[1:], len(starts)]
    return np.repeat(end, np.diff(np.r_[at, len(starts)])) - 1 - np.arange(len(starts))


def _runs(y, x, starts):
    """Start, length and group's end flag of the runs of equal positions."""
    new = starts.copy()
    new[1:] |= (y[1:] != y[:-1]) | (x[1:] != x[:-1])
    at = np.flatnonzero(new)
    return at, np.diff(np.r_[at, len(y)]), np.r_[starts[at][1:], True]


def stuck(us, y, x, starts, share, lim: Limits) -> np.ndarray:
    """Which pings repeat a stuck position. share: (repeats, pings) of the source, for each ping."""
    out = np.zeros(len(us), bool)
    at, n, last = _runs(y, x, starts)
    i = np.flatnonzero((n >= lim.stuck) & ~last)
    a, b = at[i], at[i] + n[i] - 1
    far = haversine_np(y[b], x[b], y[b + 1], x[b + 1]) >= lim.away_km
    short = us[b] - us[a] < lim.stuck_s * 1e6
    reps, total = share
    rest = total[a] - n[i]
    normal = np.where(rest > 0, (reps[a] - (n[i] - 1)) / np.maximum(rest, 1), 0) >= lim.repeats
    for j, k in zip(a[far & short & ~normal], b[far & short & ~normal]):
        out[j + 1 : k + 1] = True
    return out


#: Scales are taken from so many pings at least; of fewer the speed axis alone decides, which grows from nothing.
LEAST_SCALED = 12
#: Scales are taken anew while at most this part of a group's pings is put aside; more are its normal scatter, not spikes.
MOST_ASIDE = 0.1


def outside(us, y, x, starts) -> np.ndarray:
    """Phase-space thresholding by group: pings outside the robust ellipsoid of offset, speed and change of velocity.

    Iterated: pings outside are put aside and the axes taken anew from the rest, until no more fall outside, or so many do
    that they are the source's normal scatter.
    """
    n = len(us)
    out = np.zeros(n, bool)
    inner = np.zeros(n, bool)
    inner[1:-1] = ~starts[1:-1] & ~starts[2:]
    i = np.flatnonzero(inner)
    if not len(i):
        return out
    c = np.cos(np.radians(y))
    dy, dx = np.zeros(n), np.zeros(n)
    dy[1:] = (y[1:] - y[:-1]) * 111.195
    dx[1:] = ((x[1:] - x[:-1] + 180) % 360 - 180) * 111.195 * (c[1:] + c[:-1]) / 2
    h = np.maximum(np.r_[1, np.diff(us)], 1) / 3.6e9
    vy, vx = dy / h, dx / h
    part = h[i] / (h[i] + h[i + 1])
    space = np.stack([
        np.hypot(dy[i] - part * (dy[i] + dy[i + 1]), dx[i] - part * (dx[i] + dx[i + 1])),
        np.minimum(np.hypot(vy[i], vx[i]), 1e9),
        np.minimum(np.hypot(vy[i + 1] - vy[i], vx[i + 1] - vx[i]), 1e9),
    ])
    group = np.cumsum(starts)[i]
    cuts = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(i)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a < LEAST_SCALED:
            out[i[a:b]] = True
            continue
        own, left = space[:, a:b], np.ones(b - a, bool)
        while True:
            rest = own[:, left]
            axes = np.maximum(np.sqrt(2 * np.log(rest.shape[1])) * 1.4826 * np.median(rest, axis=1), 1e-9)
            still = left & (((own / axes[:, None]) ** 2).sum(axis=0) <= 1)
            if still.sum() == left.sum() or still.sum() < (1 - MOST_ASIDE) * (b - a):
                break
            left = still
        out[i[a:b]] = ~still
    return out


def _evidence(us, y, x, starts, v, odd, lim: Limits) -> np.ndarray:
    """For each step the highest speed at which it is part of a way left and regained by pings that are ``odd``; 0 if it isn't."""
    room, out = _room(starts), np.zeros(len(us))
    for k in range(1, lim.alone + 1):
        i = np.flatnonzero(~starts & (room >= k) & odd)
        i = i[odd[i + k - 1]]  # where the way is left and where it is regained; between, company may be quiet
        s = np.minimum(v[i], v[i + k])
        ok = (s > 0) & (_bridge(us, y, x, i, k) * lim.times <= s)
        i, s = i[ok], s[ok]
        for j in range(k + 1):  # the steps there, within and back
            np.maximum.at(out, i + j, s)
    return out


def profile(us, y, x, starts, lim: Limits):
    """Of each group: pings, repeats, and the staircase of (evidence bin, highest speed) from which the normal speed follows."""
    at = np.flatnonzero(starts)
    same = np.zeros(len(us), bool)
    same[1:] = (y[1:] == y[:-1]) & (x[1:] == x[:-1]) & ~starts[1:]
    total, reps = np.diff(np.r_[at, len(us)]), np.add.reduceat(same.astype(np.int64), at)
    sizes = total
    keep = ~stuck(us, y, x, starts, (np.repeat(reps, sizes), np.repeat(total, sizes)), lim)
    group = np.repeat(np.arange(len(at)), sizes)[keep]
    us, y, x, starts = us[keep], y[keep], x[keep], starts[keep]  # the first ping of a group is never stuck
    _, _, v = _steps(us, y, x, starts)
    evidence = _evidence(us, y, x, starts, v, outside(us, y, x, starts), lim)
    step = ~starts
    b = np.where(evidence > 0, np.minimum(1 + np.floor(np.log(np.maximum(evidence, 1e-3) / 1e-3) * BINS_PER_E), 65535), 0).astype(np.int64)  # leaps in no time are in the last
    key = (group[step] << 16) | b[step]
    o = np.lexsort((v[step], key))
    last = np.r_[key[o][1:] != key[o][:-1], True][: len(o)] if len(o) else np.empty(0, bool)
    return at, total, reps, (key[o][last] >> 16, key[o][last] & 65535, v[step][o][last])


def normal_speed(bins: np.ndarray, tops: np.ndarray, lim: Limits) -> float:
    """The least fixed point: the highest speed among steps that aren't explained as part of a spike at that speed."""
    o = np.argsort(bins, kind="stable")
    bins, tops = bins[o], np.maximum.accumulate(tops[o]) if len(o) else tops
    level = np.where(bins > 0, 1e-3 * np.exp(bins / BINS_PER_E), 0.0)
    speed = 0.0
    while True:
        n = np.searchsorted(level, lim.times * speed, "right")
        new = float(tops[n - 1]) if n else 0.0
        if new <= speed:
            return speed
        speed = new


def spikes(us, y, x, starts, speed, lim: Limits) -> np.ndarray:
    """The exact check: up to ``alone`` pings between two steps that are each faster than ``times`` the normal speed (one for each
    ping), while the direct way from the ping before to the one after isn't. From left to right, so the ping before is never a spike."""
    out = np.zeros(len(us), bool)
    _, _, v = _steps(us, y, x, starts)
    most = lim.times * speed
    hot, room = v > most, _room(starts)
    after = -1
    for i in np.flatnonzero(hot):
        if i < after:
            continue
        for k in range(1, lim.alone + 1):
            if room[i] < k:
                break
            if hot[i + k] and _bridge(us, y, x, i, k) <= most[i]:
                out[i : i + k] = True
                after = i + k + 1  # the step back is accounted for
                break
    return out


def flags(us, y, x, starts, speed, share, lim: Limits) -> tuple[np.ndarray, np.ndarray]:
    """(spikes, stuck) of distinct pings in order."""
    held = stuck(us, y, x, starts, share, lim)
    keep = np.flatnonzero(~held)
    out = np.zeros(len(us), bool)
    out[keep] = spikes(us[keep], y[keep], x[keep], starts[keep], speed[keep], lim)
    rest = np.flatnonzero(~out)  # a spike doesn't end a run, nor is it where the source is next seen
    held = np.zeros(len(us), bool)
    held[rest] = stuck(us[rest], y[rest], x[rest], starts[rest], (share[0][rest], share[1][rest]), lim)
    return out, held


def calm(us, y, x, starts, lim: Limits) -> np.ndarray:
    """Pings before which neither spike nor stuck run can reach across, so that a hot source may be cut there, moving or not.

    Of the eleven steps around it none exceeds the highest step of the group that is part of no way left and regained,
    with or without the pings of long runs: that one counts as normal whatever the ellipsoid is, so none of them is hot.
    If the position goes on unchanged, the run lasts too long on both sides to be stuck; else the step is short.
    """
    n = len(us)
    d, _, v = _steps(us, y, x, starts)
    at, size, _ = _runs(y, x, starts)
    group = np.cumsum(starts) - 1
    run = np.repeat(np.arange(len(at)), size)
    held = np.convolve((size >= lim.stuck)[run], np.ones(2 * lim.stuck - 1), "same") > 0 if n else np.zeros(0, bool)
    held = held[:n] if n >= 2 * lim.stuck - 1 else np.ones(n, bool)
    free = np.where((_evidence(us, y, x, starts, v, np.ones(n, bool), lim) == 0) & ~starts & ~held, v, 0.0)
    normal = np.maximum.reduceat(free, np.flatnonzero(starts))[group] if n else free
    low = np.zeros(n, bool)
    w = 5
    if n > 2 * w:
        quiet = ~starts & (v <= normal)
        low[w : n - w] = np.lib.stride_tricks.sliding_window_view(quiet, 2 * w + 1).all(axis=1)
    begin, end = us[at][run], us[at + size - 1][run]
    inside = np.zeros(n, bool)
    inside[1:] = run[1:] == run[:-1]
    before = np.r_[us[:1], us[:-1]]
    long_ = (before - begin >= lim.stuck_s * 1e6) & (end - us >= lim.stuck_s * 1e6)
    return low & np.where(inside, long_, d < lim.away_km)


def moving(us, y, x, starts) -> np.ndarray:
    """Pings amid steady movement, where no spike, stuck run or stay can reach across.

    Such a ping has nine steps of like speed around it, and is more than 0.45 km from five pings in a row before and after it
    that are together less than 20 minutes apart.
    """
    n = len(us)
    _, _, v = _steps(us, y, x, starts)
    around = np.stack([np.r_[np.full(max(0, -o), np.nan), v[max(0, o) : n + min(0, o)], np.full(max(0, o), np.nan)][:n] for o in range(-4, 5)]) if n > 8 else np.full((9, n), np.nan)
    with np.errstate(invalid="ignore"):
        low, mid = around.min(axis=0), np.sort(around, axis=0)[4]
        steady = (low > 0) & (around.max(axis=0) <= 3 * mid) & (v <= np.delete(around, 4, axis=0).max(axis=0))
    at = np.flatnonzero(steady)
    group = np.cumsum(starts)
    ok = np.zeros(len(at), bool)
    for o in (5, 10, 20, 40, 80, 160, 320):
        good = np.ones(len(at), bool)
        for p in range(o, o + 5):  # more than spikes come together
            a, b = np.maximum(at - p, 0), np.minimum(at + p, n - 1)
            good &= (at - p >= 0) & (at + p < n) & (group[a] == group[at]) & (group[b] == group[at]) & (us[b] - us[a] < 1_200_000_000)
            good &= (haversine_np(y[a], x[a], y[at], x[at]) > 0.45) & (haversine_np(y[b], x[b], y[at], x[at]) > 0.45)
        ok |= good
    out = np.zeros(n, bool)
    out[at[ok]] = True
    return out


def moved_cuts(rows: DataFrame, cuts: Cuts, fits: Callable) -> Cuts:
    """``cuts`` moved to the first ping of each chunk where ``fits(us, y, x, starts)``; a chunk without any joins the one before."""
    if not cuts:
        return cuts
    hot = cuts.spread(rows.select("k", *_ORDER)).where("chunk >= 0")

    def kernel(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = starts.copy()
        for c in ("us", "y", "x"):
            new[1:] |= changed(t.column(c).chunk(0))
        t, starts = t.filter(pa.array(new)).combine_chunks(), starts[new]
        us, y, x = (column(t, c) for c in ("us", "y", "x"))
        group = np.cumsum(starts)
        at = np.flatnonzero(fits(us, y, x, starts))
        at = at[np.r_[True, group[at][1:] != group[at][:-1]][: len(at)]]
        at = at[column(t, "chunk")[at] > 0]
        yield pa.record_batch([t.column("k").take(pa.array(at)).combine_chunks(), us[at], y[at], x[at]], names=["k", "us", "y", "x"])

    kind = rows.schema["k"].dataType.simpleString()
    return Cuts.of(ordered_map(hot, "k", ["us", "y", "x"], kernel, f"k {kind}, us long, y double, x double"), "k", ["us", "y", "x"])


_ORDER = ["us", "y", "x"]


def plausible(pings: DataFrame, lim: Limits, key: str, point_id: str, lat: str, lng: str, time: str) -> DataFrame:
    """``id, k, us, y, x`` of the rows with a key and a plausible time and position."""
    rows = _rows(pings, key, point_id, lat, lng, time)
    return rows.where(F.col("k").isNotNull() & F.col("us").between(lim.first, lim.end - 1) & ~lim.no_place() & F.col("y").isNotNull() & F.col("x").isNotNull())


def even_cuts(rows: DataFrame) -> Cuts:
    """Cuts of hot sources into chunks half as large as elsewhere, as moving cuts joins chunks."""
    return find_cuts(rows.select("k", *_ORDER), "k", _ORDER, ordered.CHUNK_ROWS // 2)


def scan(rows: DataFrame, kernel: Callable, schema: str, lim: Limits, cuts: Cuts) -> DataFrame:
    """``kernel(table of distinct ids, first row of each distinct ping, us, y, x, starts, spikes, stuck)`` over the ordered plausible pings.

    Two passes share one shuffle by (key, chunk): the first profiles each chunk, whose small states give each source's
    normal speed; the second flags. Rows are :func:`plausible`, and ``cuts`` are where nothing of interest reaches across.
    """
    kind = rows.schema["k"].dataType.simpleString()
    keys = ["k", "chunk"] if cuts else ["k"]
    # The filter is what the join below would infer; stated here, both passes have the same plan and so share the exchange.
    spread = cuts.spread(rows, ["k", "us", "y", "x", "id"]).where(" and ".join(f"{c} is not null" for c in keys)).repartition(*keys)
    sorting = ["k", "chunk", *_ORDER, "id"]

    def distinct(t: pa.Table, starts: np.ndarray):
        new = starts.copy()
        for c in ("us", "y", "x"):
            new[1:] |= changed(t.column(c).chunk(0))
        at = np.flatnonzero(new)
        return at, column(t, "us")[at], column(t, "y")[at], column(t, "x")[at], starts[at]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["k", "chunk"]):
            _, us, y, x, s = distinct(t, starts)
            at, total, reps, (g, b, v) = profile(us, y, x, s, lim)
            offsets = pa.array(np.searchsorted(g, np.arange(len(at) + 1)).astype(np.int32))
            rows, end = np.flatnonzero(starts), at + total - 1
            yield pa.record_batch(
                [t.column("k").take(pa.array(rows)).combine_chunks(), t.column("chunk").take(pa.array(rows)).combine_chunks(), total, reps, pa.ListArray.from_arrays(offsets, pa.array(b.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(v)), y[at], x[at], y[end], x[end]],
                names=["k", "chunk", "n", "reps", "bins", "tops", "y0", "x0", "y1", "x1"],
            )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["k"]):
            n, reps, at = column(t, "n"), column(t, "reps").copy(), np.flatnonzero(starts)
            y0, x0, y1, x1 = (column(t, c) for c in ("y0", "x0", "y1", "x1"))
            reps[1:] += ~starts[1:] & (y0[1:] == y1[:-1]) & (x0[1:] == x1[:-1])  # repeats across cuts
            bins, tops = (t.column(c).chunk(0) for c in ("bins", "tops"))
            ends = bins.offsets.to_numpy()
            b, v = bins.values.to_numpy(), tops.values.to_numpy()
            upto = np.r_[at[1:], len(starts)]
            speed = np.array([normal_speed(b[ends[i] : ends[j]], v[ends[i] : ends[j]], lim) for i, j in zip(at, upto)])
            many = upto - at
            yield pa.record_batch([t.column("k").chunk(0), t.column("chunk").chunk(0), np.repeat(speed, many), np.repeat(np.add.reduceat(n, at), many), np.repeat(np.add.reduceat(reps, at), many)], names=["pk", "pchunk", "speed", "n", "reps"])

    states = spread.sortWithinPartitions(*sorting).mapInArrow(first, f"k {kind}, chunk int, n long, reps long, bins array<int>, tops array<double>, y0 double, x0 double, y1 double, x1 double")
    sources = states.repartition("k").sortWithinPartitions("k", "chunk").mapInArrow(join, f"pk {kind}, pchunk int, speed double, n long, reps long")
    on = (F.col("k") == F.col("pk")) & (F.col("chunk") == F.col("pchunk")) if cuts else F.col("k") == F.col("pk")
    told = spread.join(sources.hint("shuffle_hash"), on).select("id", "k", "us", "y", "x", "chunk", "speed", "n", "reps")

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["k", "chunk"]):
            at, us, y, x, s = distinct(t, starts)
            sharp, held = flags(us, y, x, s, column(t, "speed")[at], (column(t, "reps")[at], column(t, "n")[at]), lim)
            yield from kernel(t, at, us, y, x, s, sharp, held)

    return told.sortWithinPartitions(*sorting).mapInArrow(second, schema)


def _rows(pings: DataFrame, key: str, point_id: str, lat: str, lng: str, time: str) -> DataFrame:
    return pings.select(F.col(point_id).alias("id"), F.col(key).alias("k"), micros(time).alias("us"), F.col(lat).cast("double").alias("y"), F.col(lng).cast("double").alias("x"))


def faults(pings: DataFrame, key: str = "uid", point_id: str = "ping_id", lat: str = "lat", lng: str = "lng", time: str = "datetime", limits: Limits | None = None) -> DataFrame:
    """The implausible pings: ``point_id``, ``key``, ``kind`` ('no_place', 'no_time', 'spike' or 'stuck'), one row per id and kind.

    Rows with a null key are left out; a null field is no fault by itself. Rows equal in key, time and position are one
    ping, and each of their ids is returned. Other columns are ignored; an empty table gives an empty result.
    """
    lim = limits or Limits()
    rows = _rows(pings, key, point_id, lat, lng, time).where(F.col("k").isNotNull())
    bounds = F.array_compact(F.array(F.when(lim.no_place(), "no_place"), F.when(lim.no_time(), "no_time")))
    plain = rows.where(lim.no_place() | lim.no_time()).select("id", "k", F.explode(bounds).alias("kind"))

    def kernel(t, at, us, y, x, starts, sharp, held):
        copies = np.diff(np.r_[at, t.num_rows])
        for name, hit in (("spike", sharp), ("stuck", held)):
            i = pa.array(np.flatnonzero(np.repeat(hit, copies)))
            yield pa.record_batch([t.column("id").take(i).combine_chunks(), t.column("k").take(i).combine_chunks(), pa.array([name] * len(i), pa.string())], names=["id", "k", "kind"])

    kinds = f"id {rows.schema['id'].dataType.simpleString()}, k {rows.schema['k'].dataType.simpleString()}, kind string"
    kept = plausible(pings, lim, key, point_id, lat, lng, time)
    moved = scan(kept, kernel, kinds, lim, moved_cuts(kept, even_cuts(kept), lambda us, y, x, starts: calm(us, y, x, starts, lim)))
    return plain.unionByName(moved).distinct().select(F.col("id").alias(point_id), F.col("k").alias(key), "kind")
