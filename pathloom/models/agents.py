"""Trajectories of simulated agents: exploration and preferential return, with waiting times or with diaries.

Agents don't meet, so each is a group of its own with a random generator seeded by the seed and its number: the result
doesn't depend on partitions. Rows of the matrix of probabilities are made when an agent first needs them and kept.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.models.flows import Gravity, TileArrays, tile_arrays
from pathloom.operators.ordered import micros

_SCHEMA = "uid long, datetime timestamp_ntz, lat double, lng double"


def truncated_power_law(rng: np.random.Generator, exponent: float, rate: float, least: float) -> float:
    """A draw with density in proportion to x ** -exponent * exp(-rate x) above ``least``: Pareto draws, kept with the exponential's chance."""
    while True:
        x = least * (1 - rng.random()) ** (-1 / (exponent - 1))
        if rng.random() <= np.exp(-rate * (x - least)):
            return float(x)


#: Bytes of rows that a worker keeps.
MOST_ROW_BYTES = 64_000_000


class _Rows:
    """Rows of the matrix of probabilities, on demand."""

    def __init__(self, gravity: Gravity, tiles: TileArrays):
        self.gravity, self.tiles, self.kept = gravity, tiles, {}

    def __getitem__(self, i: int) -> np.ndarray:
        if i not in self.kept:
            if (len(self.kept) + 1) * 8 * len(self.tiles.ids) > MOST_ROW_BYTES:
                self.kept.clear()
            self.kept[i] = self.gravity.probabilities(self.tiles, i)
        return self.kept[i]


def _next(rng, here: int, visits: dict[int, int], rows, n: int, rho: float, gamma: float) -> int:
    """Where an agent goes: somewhere by the row of probabilities, or back to where it was before, as often as it was there."""
    s = len(visits)
    explore = s == 1 or (rng.random() <= rho * s**-gamma and s != n)
    if explore:
        p = rows[here]
        return int(rng.choice(n, p=p)) if p.sum() > 0 else here
    places = [k for k in visits if k != here]
    w = np.array([visits[k] for k in places], float)
    return int(places[rng.choice(len(places), p=w / w.sum())])


@dataclasses.dataclass
class EPR:
    """Exploration and preferential return; waits (hours) follow a truncated power law.

    With probability ``rho * S ** -gamma`` (S places known) an agent explores, else it returns. ``weighted``: whether
    relevances count in exploring (density EPR) or only distances (spatial EPR).
    """

    rho: float = 0.6
    gamma: float = 0.21
    beta: float = 0.8
    tau: float = 17.0
    min_wait_time_minutes: float = 20.0
    weighted: bool = True

    def generate(self, spark: SparkSession, start: dt.datetime, end: dt.datetime, tiles: DataFrame, gravity: Gravity | None = None, n_agents: int = 1, starting_locations: list[int] | None = None, relevance: str = "relevance", tile_id: str = "tile_ID", seed: int = 0) -> DataFrame:
        """``uid`` (from 1), ``datetime``, ``lat``, ``lng`` of every move. Starting locations are numbers of tiles in the order of their ids."""
        gravity = _singly(gravity)
        if starting_locations is not None and len(starting_locations) < n_agents:
            raise IndexError("fewer starting locations than agents")
        arrays = tile_arrays(tiles, tile_id, relevance if self.weighted else None, None)

        def life(rng, agent: int, rows: _Rows) -> Iterator[tuple[dt.datetime, int]]:
            n = len(arrays.ids)
            here = starting_locations[agent] if starting_locations is not None else int(rng.integers(n))
            visits: dict[int, int] = {here: 1}
            now = start
            yield now, here
            while True:
                now += dt.timedelta(hours=truncated_power_law(rng, 1 + self.beta, 1 / self.tau, self.min_wait_time_minutes / 60))
                if now >= end:
                    return
                here = _next(rng, here, visits, rows, n, self.rho, self.gamma)
                visits[here] = visits.get(here, 0) + 1
                yield now, here

        return _simulate(spark, n_agents, arrays, gravity, seed, life)


def density_epr(**kw) -> EPR:
    return EPR(**kw, weighted=True)


def spatial_epr(**kw) -> EPR:
    return EPR(**kw, weighted=False)


def _singly(gravity: Gravity | None) -> Gravity:
    gravity = gravity or Gravity()
    if gravity.constraint != "singly constrained":
        raise AttributeError("the gravity model must be singly constrained")
    return gravity


def _simulate(spark: SparkSession, n_agents: int, arrays: TileArrays, gravity: Gravity, seed: int, life) -> DataFrame:
    held = spark.sparkContext.broadcast(arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = held.value
        rows = _Rows(gravity, a)
        for b in batches:
            for agent in b.column("id").to_pylist():
                moves = list(life(np.random.default_rng([seed, agent]), agent, rows))
                at = np.array([i for _, i in moves], int)
                yield pa.record_batch([pa.array([agent + 1] * len(moves), pa.int64()), pa.array([t for t, _ in moves], pa.timestamp("us")), a.lat[at], a.lng[at]], names=["uid", "datetime", "lat", "lng"])

    parts = max(1, min(n_agents, spark.sparkContext.defaultParallelism * 4))
    return spark.range(n_agents).repartition(parts, "id").mapInArrow(run, _SCHEMA)


class MarkovDiary:
    """Diaries of abstract locations by the hour: a Markov chain over (hour of day, at home or not), fitted to trajectories."""

    def __init__(self, chain: np.ndarray | None = None):
        self.chain = chain  # 48 x 48: state = 2 * hour + (1 at home)

    def fit(self, traj: DataFrame, n_individuals: int | None = None, location: str = "location") -> MarkovDiary:
        """Counts transitions of each individual and adds them up. ``location`` names places (of several in an hour the most frequent
        counts, or if all are as frequent the one most frequent overall). Of all, or the first ``n_individuals`` by uid."""
        rows = traj.where(F.col(location).isNotNull() & F.col("datetime").isNotNull()).select("uid", micros("datetime").alias("us"), F.col(location).cast("string").alias("loc"))
        if n_individuals is not None:
            rows = rows.join(rows.select("uid").distinct().orderBy("uid").limit(n_individuals), "uid")
        hourly = rows.groupBy("uid", F.floor(F.col("us") / 3_600_000_000).alias("slot"), "loc").agg(F.count("*").alias("n"))

        def count(pdf: pd.DataFrame) -> pd.DataFrame:
            moves = transitions(pdf["slot"].to_numpy(), pdf["loc"].to_numpy(), pdf["n"].to_numpy())
            return pd.DataFrame([(a, b, n) for (a, b), n in moves.items()], columns=["a", "b", "n"])

        found = hourly.groupBy("uid").applyInPandas(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()  # at most 48 * 48
        chain = np.zeros((48, 48))
        for a, b, n in found:
            chain[a, b] = n
        total = chain.sum(axis=1, keepdims=True)
        self.chain = np.divide(chain, total, out=np.zeros_like(chain), where=total > 0)
        return self

    def generate(self, hours: int, start: dt.datetime, rng: np.random.Generator) -> list[tuple[dt.datetime, int]]:
        """(datetime, abstract location) of each change: 0 is home; others count from 1 after each return."""
        if self.chain is None:
            raise ValueError("fit the diary first")
        places: list[int] = []
        state, other = (0, 1), 0
        places.append(0)
        while len(places) < hours:
            p = self.chain[2 * state[0] + state[1]]
            if p.sum() == 0:
                nxt = ((state[0] + 1) % 24, state[1])
            else:
                k = int(rng.choice(48, p=p / p.sum()))
                nxt = (k // 2, k % 2)
            span = (nxt[0] - state[0]) % 24 or 24
            if nxt[1]:
                other = 0
                places.extend([0] * span)
            else:
                other += 1
                places.extend([other] * span)
            state = nxt
        places = places[:hours]
        return [(start + dt.timedelta(hours=h), p) for h, p in enumerate(places) if h == 0 or p != places[h - 1]]


def transitions(slot: np.ndarray, loc: np.ndarray, n: np.ndarray) -> dict[tuple[int, int], int]:
    """Transitions between (hour, home) states of one individual, from counts by hour and location."""
    if not len(slot):
        return {}
    overall: dict = {}
    for w, k in zip(loc, n):
        overall[w] = overall.get(w, 0) + int(k)
    first, last = int(slot.min()), int(slot.max())
    series: list = [None] * (last - first + 1)
    by: dict[int, list] = {}
    for s, w, k in zip(slot, loc, n):
        by.setdefault(int(s) - first, []).append((int(k), w))
    for s, own in by.items():
        counts = {k for k, _ in own}
        if len(own) > 1 and len(counts) == 1:
            series[s] = min(own, key=lambda e: (-overall[e[1]], e[1]))[1]
        else:
            series[s] = min(own, key=lambda e: (-e[0], e[1]))[1]
    for i in range(1, len(series)):  # silent hours: where one was before
        if series[i] is None:
            series[i] = series[i - 1]
    rank = {w: r for r, (w, _) in enumerate(sorted(overall.items(), key=lambda e: (-e[1], e[0])), start=1)}
    way = [rank[w] for w in series]
    out: dict[tuple[int, int], int] = {}

    def add(h0, home0, h1, home1):
        key = (2 * (h0 % 24) + home0, 2 * (h1 % 24) + home1)
        out[key] = out.get(key, 0) + 1

    i = 0
    while i < len(way) - 1:
        h, here, nxt = i + first, int(way[i] == 1), way[i + 1]
        if nxt == 1:
            add(h, here, h + 1, 1)
            i += 1
            continue
        if i + 2 >= len(way):
            break  # the stay that begins at the end has no known length
        j = i + 1
        while j + 1 < len(way) and way[j + 1] == nxt:
            j += 1
        add(h, here, h + (j - i), 0)
        i = j
    return out


@dataclasses.dataclass
class Ditras:
    """Agents with diaries: home where the diary says so, elsewhere exploration and preferential return."""

    diary: MarkovDiary
    rho: float = 0.3
    gamma: float = 0.21

    def generate(self, spark: SparkSession, start: dt.datetime, end: dt.datetime, tiles: DataFrame, gravity: Gravity | None = None, n_agents: int = 1, starting_locations: list[int] | None = None, relevance: str = "relevance", tile_id: str = "tile_ID", seed: int = 0) -> DataFrame:
        gravity = _singly(gravity)
        if self.diary.chain is None:
            raise ValueError("fit the diary first")
        if starting_locations is not None and len(starting_locations) < n_agents:
            raise IndexError("fewer starting locations than agents")
        arrays, diary = tile_arrays(tiles, tile_id, relevance, None), self.diary
        hours = int((end - start).total_seconds() // 3600)

        def life(rng, agent: int, rows: _Rows) -> Iterator[tuple[dt.datetime, int]]:
            n = len(arrays.ids)
            home = here = starting_locations[agent] if starting_locations is not None else int(rng.integers(n))
            visits: dict[int, int] = {home: 1}
            for k, (when, place) in enumerate(diary.generate(hours, start, rng)):
                here = home if place == 0 else _next(rng, here, visits, rows, n, self.rho, self.gamma)
                if k:
                    visits[here] = visits.get(here, 0) + 1
                yield when, here

        return _simulate(spark, n_agents, arrays, gravity, seed, life)
