"""Stops and trips of moving sources from their pings.

Positions as points in space are averaged over short slots and denoised by total variation, which leaves piecewise
constant plateaus. Where the plateaus' levels stay near each other for long enough, an exact check on the pings themselves
trims them to stays: the longest stretch from some ping on that stays within a radius of it. Minimum-duration stays are
stops, and the original path between consecutive stops is a trip.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.geo import EARTH_RADIUS_KM, haversine_np, unit_vectors
from pathloom.operators.faults import Limits, calm, even_cuts, moved_cuts, moving, plausible, scan
from pathloom.operators.near import chord
from pathloom.operators.ordered import Cuts
from pathloom.session import written


@dataclasses.dataclass(frozen=True)
class Stay:
    """A stop lasts at least ``least_s`` within ``radius_km`` of its first ping; a silence over ``silence_s`` ends it.

    ``slot_s``, ``penalty_km``: the slots that are averaged, and the weight of the total variation.
    """

    least_s: float = 1200
    radius_km: float = 0.2
    silence_s: float = 86_400
    slot_s: float = 120
    penalty_km: float = 0.1


def total_variation(z: np.ndarray, penalty: float) -> np.ndarray:
    """The minimiser of 1/2 sum (u - z)^2 + penalty sum |u[i+1] - u[i]|, by the taut string: the shortest path through
    the tube of half-width ``penalty`` around the running sum of z, found with two hulls in one pass."""
    n = len(z)
    if n < 3 or penalty <= 0:
        return np.array(z, float)
    r = np.r_[0.0, np.cumsum(z)].tolist()
    out: list[float] = []
    # lower bound: greatest convex minorant of the upper tube wall; upper bound: least concave majorant of the lower wall
    x0, y0 = 0, 0.0
    up: list[tuple[int, float]] = []  # convex hull of the upper wall from the knot on
    low: list[tuple[int, float]] = []  # concave hull of the lower wall from the knot on
    i = 1
    while i <= n:
        w = 0.0 if i == n else penalty
        p, q = (i, r[i] + w), (i, r[i] - w)
        while up and (p[1] - (up[-2][1] if len(up) > 1 else y0)) * (up[-1][0] - (up[-2][0] if len(up) > 1 else x0)) <= (up[-1][1] - (up[-2][1] if len(up) > 1 else y0)) * (i - (up[-2][0] if len(up) > 1 else x0)):
            up.pop()
        up.append(p)
        while low and (q[1] - (low[-2][1] if len(low) > 1 else y0)) * (low[-1][0] - (low[-2][0] if len(low) > 1 else x0)) >= (low[-1][1] - (low[-2][1] if len(low) > 1 else y0)) * (i - (low[-2][0] if len(low) > 1 else x0)):
            low.pop()
        low.append(q)
        moved = False
        # the two first slopes cross: the string bends at the wall it touches first
        while up and low and (up[0][1] - y0) * (low[0][0] - x0) < (low[0][1] - y0) * (up[0][0] - x0):
            knot = up.pop(0) if up[0][0] < low[0][0] else low.pop(0)
            out += [(knot[1] - y0) / (knot[0] - x0)] * (knot[0] - x0)
            x0, y0 = knot
            moved = True
            if not up or not low:
                break
        if moved and (not up or not low):
            # the other hull starts anew at the knot and takes in the points from there to here
            up, low, i = [], [], x0
        i += 1
    out += [(r[n] - y0) / (n - x0)] * (n - x0) if x0 < n else []
    return np.array(out)


def _spread(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """max - min of each v[lo:hi], 0 where that is empty, from the extremes of stretches of 1, 2, 4 ... values."""
    out, many = np.zeros(len(lo)), np.maximum(hi - lo, 0)
    top, low, wide = v, v, 1
    while (many >= wide).any():
        own = np.flatnonzero((many >= wide) & (many < 2 * wide))
        i, j = lo[own], hi[own] - wide
        out[own] = np.maximum(top[i], top[j]) - np.minimum(low[i], low[j])
        top, low, wide = np.maximum(top[:-wide], top[wide:]), np.minimum(low[:-wide], low[wide:]), 2 * wide
    return out


def plateaus(us, p, starts, stay: Stay) -> list[tuple[int, int]]:
    """Where plateaus of the denoised path stay near each other for ``least_s``, as ranges of pings; ranges that meet are one.
    p are the pings' unit vectors.

    Of every shortest window of slots that lasts ``least_s``, from each slot on and back from each, the plateaus that lie wholly
    between its first and its last slot count. Total variation draws a plateau in by ``penalty_km`` over its slots for each end
    at which it stands out, and out again where the path goes on beyond it; with that undone, a plateau's level is the mean of
    its slots' averages. A window passes if these differ by no more than twice the radius along each axis.

    Every stay lies within one range: the windows from its first slot on and back from those that follow, to its last, cover it.
    The slots between a window's first and last lie wholly inside the stay, so that their averages and means of these are within
    the radius of its first ping, as a ball is convex.
    """
    n = len(us)
    group = np.cumsum(starts)
    slot = us // int(stay.slot_s * 1e6)
    new = starts.copy()
    new[1:] |= slot[1:] != slot[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.r_[at, n])
    mean = np.add.reduceat(p, at) / size[:, None] * EARTH_RADIUS_KM
    first, last = us[at], us[at + size - 1]
    fresh = np.r_[True, (group[at][1:] != group[at][:-1]) | (first[1:] - last[:-1] > stay.silence_s * 1e6)]
    edges = np.r_[np.flatnonzero(fresh), len(at)]
    least = int(stay.least_s * 1e6)
    # time along the slots, with silences and other sources just too far for a window
    gap = np.where(fresh, least + 1, np.r_[0, first[1:] - last[:-1]])
    until = np.cumsum(gap + last - first)
    since = until - (last - first)
    run, own = np.cumsum(fresh), np.arange(len(at))
    to = np.minimum(np.searchsorted(until, since + least), len(at) - 1)
    back = np.maximum(np.searchsorted(since, until - least, "right") - 1, 0)
    a, b = np.r_[own, back], np.r_[to, own]
    fits = (run[a] == run[b]) & (until[b] - since[a] >= least)
    a, b = a[fits], b[fits]
    u = np.zeros((3, len(at)))
    for i, j in zip(edges[:-1], edges[1:]):
        if last[j - 1] - first[i] >= least:
            u[:, i:j] = [total_variation(z, stay.penalty_km) for z in (mean[i:j] - mean[i]).T]
    near = np.ones(len(a), bool)
    for level in u:
        step = np.diff(level, prepend=0.0)
        step[fresh | (np.abs(step) < 1e-5)] = 0  # a centimetre: less may be rounding
        head = np.flatnonzero(fresh | (step != 0))
        count = np.diff(np.r_[head, len(at)])
        sign = np.r_[np.sign(step[head]), 0]
        drawn = max(stay.penalty_km, 0) * (sign[:-1] - sign[1:]) / count
        own = np.add.reduceat(level, head) / count + drawn
        near &= _spread(own, np.searchsorted(head, a, "right"), np.searchsorted(head, b, "right") - 1) <= 2.1 * stay.radius_km + 1e-4
    mark = np.zeros(len(at) + 1, np.int64)
    np.add.at(mark, a[near], 1)
    np.add.at(mark, b[near] + 1, -1)
    on = np.r_[False, np.cumsum(mark[:-1]) > 0, False]
    turns = np.flatnonzero(on[1:] != on[:-1])
    at = np.r_[at, n]
    return list(zip(at[turns[::2]].tolist(), at[turns[1::2]].tolist()))


def stays(us, y, x, starts, stay: Stay) -> list[tuple[int, int]]:
    """(first, last) ping of each stop, from left to right: plateaus, whose ends an exact check on the pings trims. A plateau may hold
    several stays, as its level may drift."""
    n = len(us)
    if not n:
        return []
    cut = starts.copy()
    cut[1:] |= us[1:] - us[:-1] > stay.silence_s * 1e6
    at = np.flatnonzero(cut)
    end = np.repeat(np.r_[at[1:], n], np.diff(np.r_[at, n]))  # no stay goes beyond
    p, c2 = unit_vectors(y, x), float(chord(stay.radius_km * 1000)) ** 2

    def near(i, j):
        d = p[i] - p[j]
        return np.einsum("ij,ij->i", d, d) <= c2

    # Necessary: the ping that completes the least duration, and some between, lie within the radius.
    seg = np.cumsum(cut) - 1
    wide = np.int64(int(us.max() - us.min()) + int(stay.least_s * 1e6) + 2)
    line = seg * wide + (us - us.min())
    k = np.searchsorted(line, line + int(stay.least_s * 1e6))
    ranges = plateaus(us, p, starts, stay)
    limit = np.zeros(n, np.int64)  # where a ping's plateau ends
    for lo, hi in ranges:
        limit[lo:hi] = hi
    limit = np.minimum(limit, end)
    i = np.flatnonzero(k < limit)
    for f in (1.0, 0.5, 0.25, 0.75):
        i = i[near(i, i + np.ceil((k[i] - i) * f).astype(np.int64))]
    out, free = [], 0
    for a in i.tolist():
        if a < free:
            continue
        d = p[a : k[a] + 1] - p[a]
        if (np.einsum("ij,ij->i", d, d) > c2).any():
            continue
        b, step, stop = int(k[a]), 256, int(limit[a])
        while b + 1 < stop:
            d = p[b + 1 : min(stop, b + 1 + step)] - p[a]
            far = np.flatnonzero(np.einsum("ij,ij->i", d, d) > c2)
            if len(far):
                b += int(far[0])
                break
            b += len(d)
            step *= 2
        out.append((a, b))
        free = b + 1
    return out


def stops_and_trips(pings: DataFrame, key: str = "uid", point_id: str = "ping_id", lat: str = "lat", lng: str = "lng", time: str = "datetime", stay: Stay | None = None, limits: Limits | None = None) -> DataFrame:
    """Stops and the trips between them: ``kind`` ('stop' or 'trip'), ``key``, ``start_us``, ``end_us``, ``duration_s``,
    ``n`` pings, ``distance_km`` along the pings, and ``lat``, ``lng`` (of a stop the mean, of a trip its first ping).

    Implausible pings (:mod:`pathloom.operators.faults`) are left aside. A stop is taken at the earliest ping from which
    the source stays, and the search goes on after it. A trip leads from the last ping of a stop to the first of the
    source's next, if no silence over ``silence_s`` lies between. Rows with a null in key, time or position are left
    out, copies count once, other columns are ignored and an empty table gives an empty result. Hot sources are cut
    amid movement, where no stay can reach across; trips across a cut are put together from the cuts' states. Hot sources
    that never leave are cut anywhere, as their stays follow from their chunks' extents.
    """
    stay, lim = stay or Stay(), limits or Limits()
    quiet = int(stay.silence_s * 1e6)

    def kernel(t, at, us, y, x, starts, sharp, held) -> Iterator[pa.RecordBatch]:
        keep = ~(sharp | held)
        group = np.cumsum(starts) - 1
        heads = np.flatnonzero(starts)
        keys, chunks = t.column("k").take(pa.array(at[heads])).combine_chunks(), t.column("chunk").to_numpy()[at[heads]]
        us, y, x, group = us[keep], y[keep], x[keep], group[keep]
        starts = np.r_[True, group[1:] != group[:-1]][: len(group)]
        jump, silent = np.zeros(len(us)), np.zeros(len(us))
        jump[1:] = haversine_np(y[:-1], x[:-1], y[1:], x[1:])
        silent[1:] = us[1:] - us[:-1] > quiet
        jump[starts] = silent[starts] = 0
        way, gaps = np.cumsum(jump), np.cumsum(silent)
        found = np.array(stays(us, y, x, starts, stay), np.int64).reshape(-1, 2)
        a, b = found[:, 0], found[:, 1]
        # a stop's mean longitude is taken around its first ping
        rows = [("stop", int(group[i]), int(us[i]), int(us[j]), int(j - i + 1), float(way[j] - way[i]), float(y[i : j + 1].mean()), float((x[i] + ((x[i : j + 1] - x[i] + 180) % 360 - 180).mean() + 180) % 360 - 180)) for i, j in zip(a, b)]
        same = np.flatnonzero((group[a[1:]] == group[b[:-1]]) & (gaps[a[1:]] == gaps[b[:-1]])) if len(a) else []
        rows += [("trip", int(group[b[m]]), int(us[b[m]]), int(us[a[m + 1]]), int(a[m + 1] - b[m] + 1), float(way[a[m + 1]] - way[b[m]]), float(y[b[m]]), float(x[b[m]])) for m in same]
        none = (None,) * 11
        rows = [r + none for r in rows]
        if len(us):
            first = np.flatnonzero(starts)
            last = np.r_[first[1:], len(us)] - 1
            for f, g in zip(first.tolist(), last.tolist()):
                if chunks[group[f]] < 0:
                    continue
                own = np.flatnonzero((a >= f) & (b <= g))
                i, j = (int(a[own[0]]), int(b[own[-1]])) if len(own) else (g, f)
                state = (bool(len(own)), int(us[f]), float(y[f]), float(x[f]), int(us[g]), float(y[g]), float(x[g]), float(way[i] - way[f]), bool(gaps[i] > gaps[f]), float(way[g] - way[j]), bool(gaps[g] > gaps[j]))
                rows.append(("edge", int(group[f]), int(us[i]), int(us[j]), int(i - f), float(g - j), float(y[j]), float(x[j])) + state)
        cols = list(zip(*rows)) if rows else [()] * 19
        yield pa.record_batch(
            [pa.array(cols[0], pa.string()), keys.take(pa.array(cols[1], pa.int64())), pa.array(np.array(chunks)[list(cols[1])] if rows else [], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.float64()), pa.array(cols[6], pa.float64()), pa.array(cols[7], pa.float64()), pa.array(cols[8], pa.bool_()), pa.array(cols[9], pa.int64()), pa.array(cols[10], pa.float64()), pa.array(cols[11], pa.float64()), pa.array(cols[12], pa.int64()), pa.array(cols[13], pa.float64()), pa.array(cols[14], pa.float64()), pa.array(cols[15], pa.float64()), pa.array(cols[16], pa.bool_()), pa.array(cols[17], pa.float64()), pa.array(cols[18], pa.bool_())],
            names=_NAMES,
        )

    kind = pings.schema[key].dataType.simpleString()
    kept = plausible(pings, lim, key, point_id, lat, lng, time)
    even = even_cuts(kept)
    cuts = moved_cuts(kept, even, moving)
    # Sources cut far less often than evenly stand still for long; those that never leave need no cuts amid movement.
    still = [k for k, b in even.bounds.items() if len(b[0]) - len(cuts.bounds.get(k, [[]])[0]) > 4]
    stood = None
    if still:
        stood, gone = _standing(kept, still, even, stay, lim)
        kept = kept.join(_listed(kept, gone), "k", "left_anti") if gone else kept
    schema = f"kind string, k {kind}, chunk int, start_us long, end_us long, n long, distance_km double, lat double, lng double, some boolean, us0 long, y0 double, x0 double, us1 long, y1 double, x1 double, before double, gap_before boolean, after double, gap_after boolean"
    parts = scan(kept, kernel, schema, lim, cuts)
    names = ["kind", "k", "start_us", "end_us", "n", "distance_km", "lat", "lng"]
    if cuts:
        parts = written(parts, "trips")
        across = parts.where("kind = 'edge'").groupBy("k").applyInPandas(lambda pdf: _across(pdf, quiet), f"kind string, k {kind}, start_us long, end_us long, n long, distance_km double, lat double, lng double")
        parts = parts.where("kind <> 'edge'").select(*names).unionByName(across)
    else:
        parts = parts.select(*names)
    parts = parts.unionByName(stood.select(*names)) if stood is not None else parts
    return parts.select("kind", F.col("k").alias(key), "start_us", "end_us", ((F.col("end_us") - F.col("start_us")) / F.lit(1e6)).alias("duration_s"), "n", "distance_km", "lat", "lng")


def _listed(rows: DataFrame, keys: list) -> DataFrame:
    """Hot sources, each with more than four chunks, so that there are at most a fourth of ``MOST_CUTS`` of them."""
    return F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in keys], f"k {rows.schema['k'].dataType.simpleString()}"))


def _standing(kept: DataFrame, still: list, even: Cuts, stay: Stay, lim: Limits) -> tuple[DataFrame, list]:
    """The stops of those of the sources ``still`` that never leave, and these sources.

    Each chunk tells the ball that holds its pings. If the balls between two silences all lie within the radius of the first
    ping there, that is one stay; a source with a ball that doesn't isn't one of these.
    """
    rows = kept.join(_listed(kept, still), "k", "left_semi")
    cuts = moved_cuts(rows, dataclasses.replace(even, bounds={k: even.bounds[k] for k in still}), lambda us, y, x, starts: calm(us, y, x, starts, lim))
    quiet = int(stay.silence_s * 1e6)
    names = ["k", "chunk", "us0", "us1", "y0", "x0", "y1", "x1", "n", "km", "sy", "sx", "p", "q", "r", "reach"]

    def kernel(t, at, us, y, x, starts, sharp, held) -> Iterator[pa.RecordBatch]:
        left = ~(sharp | held)
        group = np.cumsum(starts) - 1
        heads = at[np.flatnonzero(starts)]
        us, y, x, group = us[left], y[left], x[left], group[left]
        if not len(us):
            return
        new = np.r_[True, (group[1:] != group[:-1]) | (us[1:] - us[:-1] > quiet)]
        a = np.flatnonzero(new)
        n = np.diff(np.r_[a, len(us)])
        b = a + n - 1
        step = np.zeros(len(us))
        step[1:] = haversine_np(y[:-1], x[:-1], y[1:], x[1:])
        step[a] = 0
        v = unit_vectors(y, x)
        middle = np.add.reduceat(v, a) / n[:, None]
        far = v - np.repeat(middle, n, axis=0)
        reach = np.sqrt(np.maximum.reduceat(np.einsum("ij,ij->i", far, far), a))
        east = (x - np.repeat(x[a], n) + 180) % 360 - 180
        own = pa.array(heads[group[a]])
        yield pa.record_batch([t.column("k").take(own).combine_chunks(), t.column("chunk").take(own).combine_chunks(), us[a], us[b], y[a], x[a], y[b], x[b], n.astype(np.int64), np.add.reduceat(step, a), np.add.reduceat(y, a), np.add.reduceat(east, a), *np.ascontiguousarray(middle.T), reach], names=names)

    kind = kept.schema["k"].dataType.simpleString()
    parts = scan(rows, kernel, f"k {kind}, chunk int, us0 long, us1 long, y0 double, x0 double, y1 double, x1 double, n long, km double, sy double, sx double, p double, q double, r double, reach double", lim, cuts)
    reachable = float(chord(stay.radius_km * 1000))

    def join(f: pd.DataFrame) -> pd.DataFrame:  # a row per chunk and silence
        f = f.sort_values(["chunk", "us0"]).reset_index(drop=True)
        us0, us1 = f["us0"].to_numpy(), f["us1"].to_numpy()
        a = np.flatnonzero(np.r_[True, us0[1:] - us1[:-1] > quiet])
        many = np.diff(np.r_[a, len(f)])
        first = np.repeat(a, many)
        anchor = unit_vectors(f["y0"].to_numpy()[first], f["x0"].to_numpy()[first])
        out = np.linalg.norm(f[["p", "q", "r"]].to_numpy() - anchor, axis=1) + f["reach"].to_numpy() > reachable
        columns = ["kind", "k", "start_us", "end_us", "n", "distance_km", "lat", "lng"]
        if out.any():
            return pd.DataFrame([("moves", f["k"].iloc[0], 0, 0, 0, 0.0, 0.0, 0.0)], columns=columns)
        step = np.r_[0.0, haversine_np(f["y1"].to_numpy()[:-1], f["x1"].to_numpy()[:-1], f["y0"].to_numpy()[1:], f["x0"].to_numpy()[1:])]
        step[a] = 0
        n, x0 = np.add.reduceat(f["n"].to_numpy(), a), f["x0"].to_numpy()
        east = f["sx"].to_numpy() + f["n"].to_numpy() * ((x0 - x0[first] + 180) % 360 - 180)
        end = us1[a + many - 1]
        found = pd.DataFrame({"kind": "stop", "k": f["k"].iloc[0], "start_us": us0[a], "end_us": end, "n": n, "distance_km": np.add.reduceat(f["km"].to_numpy() + step, a), "lat": np.add.reduceat(f["sy"].to_numpy(), a) / n, "lng": (x0[a] + np.add.reduceat(east, a) / n + 180) % 360 - 180})
        return found[end - us0[a] >= stay.least_s * 1e6][columns]

    told = written(parts.groupBy("k").applyInPandas(join, f"kind string, k {kind}, start_us long, end_us long, n long, distance_km double, lat double, lng double"), "standing")
    moves = {r[0] for r in told.where("kind = 'moves'").select("k").collect()}  # hot sources at most
    return told.where("kind = 'stop'"), [k for k in still if k not in moves]


_NAMES = ["kind", "k", "chunk", "start_us", "end_us", "n", "distance_km", "lat", "lng", "some", "us0", "y0", "x0", "us1", "y1", "x1", "before", "gap_before", "after", "gap_after"]


def _across(edges: pd.DataFrame, quiet: int) -> pd.DataFrame:
    """Trips across cuts of one hot source, from one row per chunk (their number is bounded, see Cuts)."""
    out, left, prev = [], None, None
    for r in edges.sort_values("chunk").to_dict("records"):
        if prev is not None and left is not None:
            left["km"] += float(haversine_np(prev["y1"], prev["x1"], r["y0"], r["x0"]))
            left["gap"] |= r["us0"] - prev["us1"] > quiet
        if left is not None:
            if r["some"]:
                if not (left["gap"] or r["gap_before"]):
                    out.append(("trip", r["k"], left["us"], int(r["start_us"]), left["n"] + int(r["n"]) + 1, left["km"] + r["before"], left["lat"], left["lng"]))
            else:
                left["km"] += r["before"]
                left["n"] += int(r["n"]) + 1
                left["gap"] |= bool(r["gap_before"])
        if r["some"]:
            left = {"us": int(r["end_us"]), "n": int(r["distance_km"]) + 1, "km": r["after"], "gap": bool(r["gap_after"]), "lat": r["lat"], "lng": r["lng"]}
        prev = r
    return pd.DataFrame(out, columns=["kind", "k", "start_us", "end_us", "n", "distance_km", "lat", "lng"])
