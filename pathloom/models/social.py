"""Agents that meet: moves are drawn from one's own past or from that of a contact in a social graph.

Agents act on each other through their visits, so a connected population is one sequence of events in time and one task.
Populations (replicates) run side by side: each is a group with a seed of its own.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from pathloom.functions.geo import haversine_np

from pathloom.models.agents import MarkovDiary, truncated_power_law
from pathloom.models.flows import TileArrays, tile_arrays

# Fixed value: the radius of the earth that choices by gravity reckon with, in km.
GRAVITY_RADIUS_KM = 6371.01
_SCHEMA = "population long, uid long, datetime timestamp_ntz, lat double, lng double"


def geometric_graph(rng: np.random.Generator, n: int, radius: float = 0.5) -> list[list[int]]:
    """Contacts of n agents: points at random in the unit square, linked if nearer than ``radius``."""
    p = rng.random((n, 2))
    d = np.hypot(p[:, None, 0] - p[None, :, 0], p[:, None, 1] - p[None, :, 1])
    return [[j for j in np.flatnonzero(d[i] < radius).tolist() if j != i] for i in range(n)]


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    a = np.linalg.norm(x) * np.linalg.norm(y)
    return float(x @ y / a) if a else 0.0


def weighted_choice(rng: np.random.Generator, weights: np.ndarray) -> int:
    w = np.cumsum(np.asarray(weights, float))
    return int(np.searchsorted(w, rng.random() * w[-1], "right"))


@dataclasses.dataclass
class SocialModel:
    """Social and individual exploration and return.

    ``alpha``: the chance of a social choice. ``gravity``: whether individuals explore by relevance over squared distance
    (and neither go where they are nor home) instead of uniformly. Moves become known ``window_hours`` later; similarities
    between contacts are renewed after ``refresh_hours``.
    """

    rho: float = 0.6
    gamma: float = 0.21
    alpha: float = 0.2
    beta: float = 0.8
    tau: float = 17.0
    min_wait_time_hours: float = 1.0
    gravity: bool = False
    window_hours: float = 0.5
    refresh_hours: float = 168.0
    min_relevance: float = 0.1

    def generate(self, spark: SparkSession, start: dt.datetime, end: dt.datetime, tiles: DataFrame, social_graph: str | list = "random", n_agents: int = 500, diary: MarkovDiary | None = None, relevance: str | None = None, by_relevance: bool = False, tile_id: str = "tile_ID", seed: int = 0, populations: int = 1) -> DataFrame:
        """``population``, ``uid``, ``datetime``, ``lat``, ``lng`` of every move.

        ``social_graph``: "random", or a list of pairs of agents (their number is then that of the agents named). With a
        ``diary`` moves follow each agent's diary, else truncated power-law waits. ``by_relevance``: start by relevance.
        """
        if n_agents <= 0 or populations <= 0:
            raise ValueError("there must be agents and populations")
        if start >= end:
            raise ValueError("start must lie before end")
        if not 0 <= self.alpha <= 1 or not 0 < self.rho <= 1 or self.gamma < 0:
            raise ValueError("alpha and rho must lie between 0 and 1, gamma must not be negative")
        if not isinstance(social_graph, list) and social_graph != "random":
            raise ValueError('social_graph must be "random" or a list of pairs')
        if isinstance(social_graph, list) and not social_graph:
            raise ValueError("social_graph has no pairs")
        a = tile_arrays(tiles, tile_id, relevance, None)
        if len(a.ids) < 3:
            raise ValueError("at least three tiles are needed")
        held, model = spark.sparkContext.broadcast(a), self

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            k = int(pdf["id"].iloc[0])
            rows = model._run(np.random.default_rng([seed, k]), held.value, start, end, social_graph, n_agents, diary, by_relevance)
            at = np.array([r[2] for r in rows], int)
            return pd.DataFrame({"population": k, "uid": [r[1] + 1 for r in rows], "datetime": pd.to_datetime([r[0] for r in rows]).astype("datetime64[us]"), "lat": held.value.lat[at], "lng": held.value.lng[at]})

        return spark.range(populations).groupBy("id").applyInPandas(run, _SCHEMA)

    def _run(self, rng, a: TileArrays, start, end, graph, n_agents, diary, by_relevance) -> list[tuple[dt.datetime, int, int]]:
        n = len(a.ids)
        weight = np.where(a.relevance > 0, a.relevance, self.min_relevance)
        if isinstance(graph, list):
            names = sorted({v for pair in graph for v in pair})
            number = {v: i for i, v in enumerate(names)}
            n_agents = len(names)
            contacts: list[list[int]] = [[] for _ in names]
            for u, v in graph:
                contacts[number[u]].append(number[v])
                contacts[number[v]].append(number[u])
        else:
            contacts = geometric_graph(rng, n_agents)
        visits = np.zeros((n_agents, n), np.int64)
        home = np.array([weighted_choice(rng, weight) if by_relevance else int(rng.integers(n)) for _ in range(n_agents)])
        here = home.copy()
        out = [(start, i, int(home[i])) for i in range(n_agents)]
        visits[np.arange(n_agents), home] = 1
        similar: dict[tuple[int, int], tuple[float, dt.datetime]] = {}
        diaries = [diary.generate(int((end - start).total_seconds() // 3600), start, rng) for _ in range(n_agents)] if diary else None
        page = [0] * n_agents

        def wait(i: int, now: dt.datetime) -> dt.datetime | None:
            if diaries is None:
                return now + dt.timedelta(hours=truncated_power_law(rng, 1 + self.beta, 1 / self.tau, self.min_wait_time_hours))
            page[i] += 1
            return diaries[i][page[i]][0] if page[i] < len(diaries[i]) else None

        def allowed(i: int, explore: bool) -> np.ndarray:
            free = (visits[i] == 0) if explore else (visits[i] > 0)
            if self.gravity:
                free[[here[i], home[i]]] = False
            return np.flatnonzero(free)

        def social(i: int, explore: bool, now: dt.datetime) -> int:
            if not contacts[i]:
                return -1
            s = []
            for j in contacts[i]:
                edge = (min(i, j), max(i, j))
                if edge not in similar or similar[edge][1] <= now:
                    similar[edge] = (cosine(visits[i], visits[j]), now + dt.timedelta(hours=self.refresh_hours))
                s.append(similar[edge][0])
            j = contacts[i][weighted_choice(rng, s) if sum(s) else int(rng.integers(len(s)))]
            own = allowed(i, explore)
            w = visits[j][own]
            return int(own[weighted_choice(rng, w)]) if w.sum() else -1

        def individual(i: int, explore: bool) -> int:
            own = allowed(i, explore)
            if not len(own):
                return -1
            if not explore:
                return int(own[weighted_choice(rng, visits[i][own])])
            if not self.gravity:
                return int(own[rng.integers(len(own))])
            d = haversine_np(a.lat[here[i]], a.lng[here[i]], a.lat[own], a.lng[own], GRAVITY_RADIUS_KM)
            with np.errstate(divide="ignore", invalid="ignore"):
                w = weight[here[i]] * weight[own] / d**2
            w[~np.isfinite(w)] = 0
            return int(own[weighted_choice(rng, w)]) if w.sum() else -1

        due: list[tuple[dt.datetime, int]] = []
        for i in range(n_agents):
            t = wait(i, start)
            if t is not None:
                heapq.heappush(due, (t, i))
        pending: list[tuple[dt.datetime, int, int]] = []
        window = dt.timedelta(hours=self.window_hours)

        def confirm(upto: dt.datetime) -> None:
            while pending and pending[0][0] <= upto:
                t, i, tile = heapq.heappop(pending)
                visits[i, tile] += 1
                here[i] = tile
                out.append((t, i, tile))

        while due and due[0][0] < end:
            now, i = heapq.heappop(due)
            confirm(now - window)
            if diaries is not None and diaries[i][page[i]][1] == 0:
                tile = int(home[i])
            else:
                explore = rng.random() < self.rho * max(1, np.count_nonzero(visits[i])) ** -self.gamma
                tile = social(i, explore, now) if rng.random() < self.alpha else individual(i, explore)
                for second in (explore, not explore):  # what can't be done socially is done alone, else the other way
                    if tile < 0:
                        tile = individual(i, second)
            if tile >= 0:
                heapq.heappush(pending, (now, i, tile))
            t = wait(i, now)
            if t is not None:
                heapq.heappush(due, (t, i))
        confirm(end)
        return sorted(out, key=lambda r: (r[1], r[0]))


def geosim(**kw) -> SocialModel:
    """Uniform individual exploration and power-law waits."""
    return SocialModel(**kw)


def sts_epr(**kw) -> SocialModel:
    """Individual exploration by gravity; give a diary to :meth:`SocialModel.generate`."""
    return SocialModel(**kw, gravity=True)
