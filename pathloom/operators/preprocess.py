"""Preparation of trajectories: speed filter, compression, stay locations, clusters of locations.

Each is a fold over one trajectory's points in the order of time, by uid and, where present, tid; whole partitions of
trajectories go through one Arrow kernel. A step of more than twice the radius ends any run and any stay, so compression
and stay locations cut hot individuals (without tid) at such steps. The state of the speed filter is left
whole by no cut: there a trajectory is one group. Clusters are made of an individual's distinct positions.
Points with a null in datetime or position are left out. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions.geo import haversine_np, unit_vectors
from pathloom.operators.ordered import Cuts, find_cuts, grouped_map, micros, ordered_map

# Fixed value: the radius of the earth that clustering reckons with, in km.
CLUSTER_RADIUS_KM = 6371.0088


def _prepared(traj: DataFrame, by_trip: bool = True) -> tuple[DataFrame, list[str]]:
    keys = [c for c in (("uid", "tid") if by_trip else ("uid",)) if c in traj.columns]
    rows = traj.where(F.col("lat").isNotNull() & F.col("lng").isNotNull() & F.col("datetime").isNotNull())
    return rows.withColumn("_us", micros("datetime")), keys


def _leaps(rows: DataFrame, keys: list[str], radius_km: float) -> tuple[Cuts | None, dict]:
    """Cuts of hot individuals at the first step of each chunk that is longer than twice the radius, and by (uid, chunk) the point that
    follows: (us, lat, lng). None if nobody is hot."""
    if keys != ["uid"]:
        return None, {}
    order = ["_us", "lat", "lng"]
    cuts = find_cuts(rows.select("uid", *order), "uid", order)
    if not cuts:
        return None, {}
    hot = cuts.spread(rows.select("uid", *order)).where("chunk >= 0")

    def kernel(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        us, y, x = _arrays(t)
        far = np.zeros(len(us), bool)
        far[1:] = (haversine_np(y[:-1], x[:-1], y[1:], x[1:]) > 2 * radius_km * (1 + 1e-9)) & (us[1:] > us[:-1]) & ~starts[1:]
        at, group = np.flatnonzero(far), np.cumsum(starts)
        at = at[np.r_[True, group[at][1:] != group[at][:-1]][: len(at)]]
        yield pa.record_batch([t.column("uid").take(pa.array(at)).combine_chunks(), us[at], y[at], x[at]], names=["uid", "us", "lat", "lng"])

    kind = rows.schema["uid"].dataType.simpleString()
    found: dict = {k: [] for k in cuts.bounds}
    for r in ordered_map(hot, "uid", ["_us", "lat", "lng"], kernel, f"uid {kind}, us long, lat double, lng double").collect():  # at most one row per chunk
        found[r[0]].append((r[1], r[2], r[3]))
    found = {k: sorted(v) for k, v in found.items()}
    follows = {(k, c): p for k, v in found.items() for c, p in enumerate(v)}
    return Cuts("uid", ["_us"], {k: [np.array([p[0] for p in v], np.int64)] for k, v in found.items()}), follows


def _arrays(t: pa.Table):
    return t.column("_us").to_numpy(), t.column("lat").to_numpy(), t.column("lng").to_numpy()


def _spans(starts: np.ndarray):
    at = np.flatnonzero(starts)
    return zip(at.tolist(), [*at[1:].tolist(), len(starts)])


def _keep(us, y, x, a: int, b: int, max_speed: float) -> list[int]:
    """The points of one trajectory that the speed filter keeps: the first, each that is reached from the last kept in positive
    time at no more than ``max_speed``, and always the last."""
    if b - a <= 2:
        return list(range(a, b))
    hours = (us[a + 1 : b - 1] - us[a : b - 2]) / 3.6e9
    with np.errstate(divide="ignore", invalid="ignore"):
        bad = (hours <= 0) | (haversine_np(y[a : b - 2], x[a : b - 2], y[a + 1 : b - 1], x[a + 1 : b - 1]) / hours > max_speed)
    kept, i = [], a
    hits = iter((np.flatnonzero(bad) + a).tolist())
    for h in hits:  # the step from h to h + 1 is too fast
        if h < i:
            continue
        kept.extend(range(i, h + 1))
        j = h + 1
        while j < b - 1:
            dt = (us[j] - us[h]) / 3.6e9
            if dt > 0 and float(haversine_np(y[h], x[h], y[j], x[j])) / dt <= max_speed:
                break
            j += 1
        i = j
    return [*kept, *range(i, b)]


def _overreach(far: np.ndarray, late: np.ndarray, max_speed: float, speed: float, ratio: float) -> int | None:
    """Which of the points ahead is dropped, from their distances and seconds from a kept point, the last being only a bound:
    the first if it is reached too fast, else the farthest of a quick return, if there is one."""
    if late[0] == 0 or far[0] / (late[0] / 3600) > max_speed:
        return 0
    far, late = np.round(far[:-1], 9), late[:-1]  # to the micrometre, so that equal ways are equal
    apex = int(far.argmax())
    home = (np.arange(len(far)) > apex) & (far < ratio * far[apex])  # back near the kept point
    if not home.any():
        return None
    out = slice(0, int(home.argmax()))
    return apex if far[out].sum() * 3600 > speed * late[out].sum() > 0 else None


def _keep_without_loops(us, y, x, a: int, b: int, max_speed: float, speed: float, max_loop: int, ratio: float) -> list[int]:
    """As :func:`_keep`, and quick returns are dropped: of the next ``max_loop`` points but one the farthest, if a later one lies
    nearer than ``ratio`` of its distance and the way up to there was faster than ``speed``.

    Points are a linked list, so that dropping one costs the same however long the trajectory is.
    """
    after = list(range(a + 1, b + 1))  # after[i - a]: the next point that is left; b is the end
    kept, here = [], a
    while here < b:
        ahead, j = [], after[here - a]
        while j < b and len(ahead) < max_loop:
            ahead.append(j)
            j = after[j - a]
        gone = None
        if len(ahead) > 1:
            at = np.array(ahead)
            gone = _overreach(haversine_np(y[here], x[here], y[at], x[at]), (us[at] - us[here]) / 1e6, max_speed, speed, ratio)
        if gone is None:
            kept.append(here)
            here = after[here - a]
        else:
            before = ahead[gone - 1] if gone else here
            after[before - a] = after[ahead[gone] - a]
    return kept


def filter_speed(traj: DataFrame, max_speed_kmh: float = 500.0, include_loops: bool = False, speed_kmh: float = 5.0, max_loop: int = 6, ratio_max: float = 0.25) -> DataFrame:
    """Trajectories without points that are reached too fast (or in no time) from the last point kept; the last point of each always stays."""
    if include_loops and max_loop < 2:
        raise ValueError("max_loop must be at least 2")
    rows, keys = _prepared(traj)

    def kernel(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        us, y, x = _arrays(t)
        kept: list[int] = []
        for a, b in _spans(starts):
            kept += _keep_without_loops(us, y, x, a, b, max_speed_kmh, speed_kmh, max_loop, ratio_max) if include_loops else _keep(us, y, x, a, b, max_speed_kmh)
        yield from t.drop_columns(["_us"]).take(pa.array(kept, pa.int64())).combine_chunks().to_batches()

    return grouped_map(rows, keys, ["_us", "lat", "lng"], kernel, traj.schema)


def run_starts(y, x, starts: np.ndarray, radius_km: float) -> np.ndarray:
    """Where a run begins: at a group's first point, and at each point farther than ``radius_km`` from its run's first."""
    out = starts.copy()
    v = unit_vectors(y, x)
    c2 = (2 * np.sin(min(radius_km / (2 * 6371.0), np.pi / 2))) ** 2
    for a, b in _spans(starts):
        i = a
        while i < b:
            j, block = i + 1, 16
            while j < b:
                d = v[j : min(b, j + block)] - v[i]
                far = np.flatnonzero(np.einsum("ij,ij->i", d, d) > c2 * (1 + 1e-12))
                if len(far):
                    j += int(far[0])
                    break
                j += len(d)
                block *= 2
            if j < b:
                out[j] = True
            i = j
    return out


def compress(traj: DataFrame, spatial_radius_km: float = 0.2) -> DataFrame:
    """Runs of points within ``spatial_radius_km`` of their first, each as one point: medians of position, the first's time and extra columns."""
    rows, keys = _prepared(traj)
    traj_names = traj.columns

    def kernel(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, y, x = _arrays(t)
        at = np.flatnonzero(run_starts(y, x, starts, spatial_radius_km))
        out = t.select(traj_names).take(pa.array(at)).combine_chunks()
        for name, values in (("lat", _medians(y, at)), ("lng", _medians(x, at))):
            out = out.set_column(out.schema.get_field_index(name), name, pa.array(values))
        yield from out.to_batches()

    cuts, _ = _leaps(rows, keys, spatial_radius_km)
    return _folded(rows, keys, cuts, kernel, traj.schema)


def _folded(rows: DataFrame, keys: list[str], cuts: Cuts | None, kernel, schema) -> DataFrame:
    order = ["_us", "lat", "lng"]
    if cuts is None or "chunk" in rows.columns:
        return grouped_map(rows, keys, order, kernel, schema)
    return ordered_map(cuts.spread(rows), "uid", order, kernel, schema)


def _medians(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The median of each stretch that begins at ``at``."""
    size = np.diff(np.r_[at, len(v)])
    own = np.repeat(np.arange(len(at)), size)
    s = v[np.lexsort((v, own))]
    return (s[at + (size - 1) // 2] + s[at + size // 2]) / 2


def _stays(us, y, x, a: int, b: int, radius: float, least_us: float, silence_us: float, min_speed: float | None):
    """(first, last + 1, leaving time, row of the extra columns) of one trajectory's stops."""
    i = a
    while i < b - 1:
        # the point that closes the stay which starts at i: beyond the radius, after a silence, or the last
        j, block, found = i + 1, 16, b - 1
        while j < b:
            e = min(b, j + block)
            quiet = us[j:e] - us[j - 1 : e - 1] > silence_us
            hit = np.flatnonzero((haversine_np(y[i], x[i], y[j:e], x[j:e]) > radius) | quiet)
            if len(hit):
                found = j + int(hit[0])
                break
            j, block = e, block * 2
        if us[found] - us[found - 1] > silence_us:
            i = found
            continue
        leave, upto = us[found], found
        if min_speed is not None:
            hours = (us[i + 1 : found + 1] - us[i]) / 3.6e9
            with np.errstate(divide="ignore", invalid="ignore"):
                speed = np.where(hours > 0, haversine_np(y[i], x[i], y[i + 1 : found + 1], x[i + 1 : found + 1]) / hours, 0.0)
            slow = np.flatnonzero(speed[1:] < min_speed)
            way_out = 1 + (int(slow[-1]) if len(slow) else 0)  # steps after the last slow one lead away
            if way_out < len(speed) - 1:
                leave, upto = us[i + way_out + 1], i + way_out
        if upto > i and leave - us[i] > least_us:
            yield i, upto, int(leave), found - 1
        i = found


def stay_locations(traj: DataFrame, stop_radius_factor: float = 0.5, minutes_for_a_stop: float = 20.0, spatial_radius_km: float | None = 0.2, leaving_time: bool = True, no_data_for_minutes: float = 1e12, min_speed_kmh: float | None = None, compress_radius_km: float | None = None) -> DataFrame:
    """Stops: stretches longer than ``minutes_for_a_stop`` within a radius of their first point, up to the point that leaves it.

    The radius is ``spatial_radius_km``, or if that is None ``stop_radius_factor`` times ``compress_radius_km``. A silence
    over ``no_data_for_minutes`` starts anew. With ``min_speed_kmh`` the leaving time is moved back to where the way out
    began. Positions are medians, extra columns those of the last point; ``leaving_datetime`` is added.
    """
    if spatial_radius_km is None and compress_radius_km is None:
        raise ValueError("give spatial_radius_km, or compress_radius_km for stop_radius_factor")
    radius = spatial_radius_km if spatial_radius_km is not None else stop_radius_factor * compress_radius_km
    rows, keys = _prepared(traj)
    least, silence = minutes_for_a_stop * 6e7, no_data_for_minutes * 6e7
    fields = [*traj.schema.fields, *([T.StructField("leaving_datetime", traj.schema["datetime"].dataType)] if leaving_time else [])]

    traj_names = traj.columns
    cuts, follows = _leaps(rows, keys, radius)
    cuts = None if "chunk" in rows.columns else cuts

    def kernel(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        us, y, x = _arrays(t)
        found = []
        for a, b in _spans(starts):
            after = follows.get((t.column("uid")[a].as_py(), t.column("chunk")[a].as_py())) if cuts else None
            if after is None:
                found += _stays(us, y, x, a, b, radius, least, silence, min_speed_kmh)
            else:  # the point after the cut closes the last stay
                part = [np.r_[v[a:b], p] for v, p in zip((us, y, x), after)]
                found += [(i + a, j + a, leave, e + a) for i, j, leave, e in _stays(*part, 0, b - a + 1, radius, least, silence, min_speed_kmh)]
        first, extra = pa.array([f for f, *_ in found], pa.int64()), pa.array([e for *_, e in found], pa.int64())
        out = t.select(traj_names).take(extra).combine_chunks()
        names = out.schema.names
        out = out.set_column(names.index("lat"), "lat", pa.array([float(np.median(y[a:b])) for a, b, *_ in found], pa.float64()))
        out = out.set_column(names.index("lng"), "lng", pa.array([float(np.median(x[a:b])) for a, b, *_ in found], pa.float64()))
        out = out.set_column(names.index("datetime"), "datetime", t.column("datetime").take(first))
        if leaving_time:
            kind = t.schema.field("datetime").type
            out = out.append_column("leaving_datetime", pa.array([n for *_, n, _ in found], pa.timestamp("us", getattr(kind, "tz", None))))
        yield from out.combine_chunks().to_batches()

    return _folded(rows, keys, cuts, kernel, T.StructType(fields))


def dbscan(y: np.ndarray, x: np.ndarray, radius_km: float, min_samples: int, counts: np.ndarray | None = None) -> np.ndarray:
    """Labels of points in order: 0 for the largest cluster and so on (of two as large, the one first seen later comes first), -1 for noise.

    Equal positions are looked at once; ``counts`` tells how often each given one occurs. Neighbours are sought in the 27 cells
    around a cell as wide as the radius.
    """
    place, back = np.unique(np.column_stack([y, x]), axis=0, return_inverse=True)
    back = back.ravel()
    counts = np.ones(len(back), np.int64) if counts is None else counts
    weight = np.bincount(back, counts, len(place))
    order = np.full(len(place), len(back))
    np.minimum.at(order, back, np.arange(len(back)))  # when a position is first seen
    v = unit_vectors(place[:, 0], place[:, 1])
    reach = 2 * np.sin(min(radius_km / (2 * CLUSTER_RADIUS_KM), np.pi / 2))
    cells: dict[tuple, list[int]] = {}
    grid = np.floor(v / max(reach, 1e-12)).astype(np.int64)
    for i, c in enumerate(map(tuple, grid.tolist())):
        cells.setdefault(c, []).append(i)
    around = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]

    def near(i: int) -> np.ndarray:
        a, b, c = grid[i].tolist()
        own = np.array([j for d in around for j in cells.get((a + d[0], b + d[1], c + d[2]), ())])
        d = v[own] - v[i]
        return own[np.einsum("ij,ij->i", d, d) <= reach * reach * (1 + 1e-12)]

    neighbours = [near(i) for i in range(len(place))]
    core = np.array([weight[n].sum() >= min_samples for n in neighbours])
    label = np.full(len(place), -1)
    count = 0
    for i in np.argsort(order).tolist():
        if not core[i] or label[i] >= 0:
            continue
        stack = [i]
        label[i] = count
        while stack:
            for j in neighbours[stack.pop()].tolist():
                if label[j] < 0:
                    label[j] = count
                    if core[j]:
                        stack.append(j)
        count += 1
    points = label[back]
    size = np.bincount(points[points >= 0], counts[points >= 0], minlength=count)
    rank = np.empty(count + 1, np.int64)
    rank[sorted(range(count), key=lambda k: (-size[k], -k))] = np.arange(count)
    rank[count] = -1
    return rank[points]  # -1 takes the last


def cluster(traj: DataFrame, cluster_radius_km: float = 0.1, min_samples: int = 1) -> DataFrame:
    """Density-based clusters of each individual's points: ``cluster`` is added, 0 for the most frequent, -1 for noise."""
    rows, keys = _prepared(traj, by_trip=False)
    at = [*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("lat").alias("_y"), F.col("lng").alias("_x")]
    # An individual's distinct positions, combined map-side, are what is clustered; its rows only meet their labels.
    names = [f"_k{i}" for i in range(len(keys))]
    seen = rows.groupBy(*at).agg(F.count("*").alias("_n"), F.min("_us").alias("_us"))

    def kernel(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        y, x, n = (t.column(c).to_numpy() for c in ("_y", "_x", "_n"))
        label = np.concatenate([dbscan(y[a:b], x[a:b], cluster_radius_km, min_samples, n[a:b]) for a, b in _spans(starts)])
        yield from t.select([*names, "_y", "_x"]).append_column("_label", pa.array(label, pa.int64())).combine_chunks().to_batches()

    kinds = T.StructType([f for f in seen.schema.fields if f.name in (*names, "_y", "_x")] + [T.StructField("_label", T.LongType())])
    labels = grouped_map(seen, names, ["_us", "_y", "_x"], kernel, kinds)
    same = (F.col("lat") == F.col("_y")) & (F.col("lng") == F.col("_x"))
    for k, n in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return rows.join(labels, same).select(*traj.columns, F.col("_label").alias("cluster"))
