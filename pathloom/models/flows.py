"""Models of flows between tiles: gravity and radiation.

A tile table has ``tile_ID``, ``lat``, ``lng`` (see spatial.centroids), a relevance and, for flows, a total outflow. Every
origin is one row of a distributed scan; what it needs of all destinations are four columns, which are sent to every task
behind a check of their number. An origin's row of the matrix is made, normalized and emitted at once.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.geo import haversine_km, haversine_np
from pathloom.operators.ordered import column, whole_groups
from pathloom.session import written

MOST_TILES = 200_000
FORMATS = ("flows", "flows_sample", "probabilities")


@dataclasses.dataclass
class TileArrays:
    ids: np.ndarray
    lat: np.ndarray
    lng: np.ndarray
    relevance: np.ndarray
    outflow: np.ndarray | None


def tile_arrays(tiles: DataFrame, tile_id: str, relevance: str | None, outflow: str | None) -> TileArrays:
    """The tiles in the order of their ids; missing numbers are 0."""
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c else F.lit(1.0)
    rows = tiles.select(F.col(tile_id).cast("string").alias("t"), F.col("lat").cast("double"), F.col("lng").cast("double"), number(relevance).alias("m"), number(outflow).alias("o")).orderBy("t").limit(MOST_TILES + 1).collect()
    if len(rows) > MOST_TILES:
        raise ValueError(f"more than {MOST_TILES} tiles")
    cols = list(zip(*rows)) if rows else [()] * 5
    return TileArrays(np.array(cols[0], object), *(np.array(c, float) for c in cols[1:4]), np.array(cols[4], float) if outflow else None)


def _check(tiles: DataFrame, out_format: str, outflow: str) -> None:
    if out_format not in FORMATS:
        raise ValueError(f"out_format must be one of {FORMATS}")
    if out_format != "probabilities" and outflow not in tiles.columns:
        raise KeyError(f"the tiles have no column {outflow}")


def _by_origin(tiles: DataFrame, arrays: TileArrays, row, value: str = "flow double") -> DataFrame:
    """``row(arrays, i)`` gives (destinations, values) of origin i."""
    spark = tiles.sparkSession
    held = spark.sparkContext.broadcast(arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = held.value
        for b in batches:
            for i in b.column("id").to_pylist():
                j, v = row(a, i)
                keep = v > 0
                j, v = j[keep], v[keep]
                yield pa.record_batch([pa.array([a.ids[i]] * len(j), pa.string()), pa.array(a.ids[j].tolist(), pa.string()), pa.array(v)], names=["origin", "destination", "flow"])

    return spark.range(len(arrays.ids)).repartition(max(1, min(len(arrays.ids), spark.sparkContext.defaultParallelism * 4))).mapInArrow(run, f"origin string, destination string, {value}")


@dataclasses.dataclass
class Gravity:
    """Flows in proportion to relevances and a deterrence of distance: a power law (exponent) or an exponential (rate) in km.

    Singly constrained: the flows of an origin add up to its outflow; globally constrained: all flows add up to all outflows.
    """

    deterrence: str = "power_law"
    argument: float = -2.0
    origin_exp: float = 1.0
    destination_exp: float = 1.0
    constraint: str = "singly constrained"

    def __post_init__(self):
        if self.deterrence not in ("power_law", "exponential"):
            raise ValueError("deterrence must be power_law or exponential")
        if self.constraint not in ("singly constrained", "globally constrained"):
            raise ValueError("constraint must be singly constrained or globally constrained")

    def scores(self, a: TileArrays, i: int) -> np.ndarray:
        """Of origin i to all tiles; 0 to itself and wherever the formula has no finite value."""
        d = haversine_np(a.lat[i], a.lng[i], a.lat, a.lng)
        with np.errstate(all="ignore"):
            f = d**self.argument if self.deterrence == "power_law" else np.exp(-d * self.argument)
            s = f * a.relevance**self.destination_exp * (1.0 if self.constraint == "singly constrained" else a.relevance[i] ** self.origin_exp)
        s[~np.isfinite(s)] = 0
        s[i] = 0
        return s

    def probabilities(self, a: TileArrays, i: int) -> np.ndarray:
        s = self.scores(a, i)
        total = s.sum()
        return s / total if total > 0 else s

    def generate(self, tiles: DataFrame, tile_id: str = "tile_ID", tot_outflows: str = "tot_outflow", relevance: str = "relevance", out_format: str = "flows", seed: int = 0) -> DataFrame:
        """``origin``, ``destination``, ``flow`` above zero: mean flows, a random sample of them, or probabilities."""
        _check(tiles, out_format, tot_outflows)
        a = tile_arrays(tiles, tile_id, relevance, tot_outflows if out_format != "probabilities" else None)
        every = np.arange(len(a.ids))
        if self.constraint == "singly constrained":

            def row(a, i):
                p = self.probabilities(a, i)
                if out_format == "flows":
                    p = p * a.outflow[i]
                elif out_format == "flows_sample":
                    p = np.random.default_rng([seed, i]).multinomial(int(a.outflow[i]), p).astype(float) if p.sum() > 0 else p
                return every, p

            return _by_origin(tiles, a, row)
        total = _by_origin(tiles, a, lambda a, i: (np.array([i]), np.array([self.scores(a, i).sum()]))).agg(F.sum("flow")).first()[0] or 1.0
        amount = float(a.outflow.sum()) if a.outflow is not None else 1.0
        if out_format != "flows_sample":
            return _by_origin(tiles, a, lambda a, i: (every, self.scores(a, i) / total * amount))
        # A multinomial over all pairs: how many leave each origin, then where to.
        share = {r[0]: r[1] / total for r in _by_origin(tiles, a, lambda a, i: (np.array([i]), np.array([self.scores(a, i).sum()]))).select("origin", "flow").collect()}
        p = np.array([share.get(t, 0.0) for t in a.ids])
        leave = np.random.default_rng([seed]).multinomial(int(amount), p / p.sum()) if p.sum() > 0 else np.zeros(len(p), int)
        return _by_origin(tiles, a, lambda a, i: (every, np.random.default_rng([seed, i]).multinomial(leave[i], self.probabilities(a, i)).astype(float) if leave[i] else np.zeros(len(every))))

    def fit(self, flows: DataFrame, tiles: DataFrame, tile_id: str = "tile_ID", relevance: str = "relevance") -> Gravity:
        """A model with the exponents and the deterrence that fit the flows best: Poisson regression with a log link.

        Flows within a tile, with unknown tiles or to tiles without relevance are left out. Singly constrained models have
        a term for each origin, others one term in all. These terms drop out: given the sums of each origin the flows are
        multinomial, and Newton's method needs a few sums over the pairs for each step, one task for each share of origins.
        """
        t = tiles.select(F.col(tile_id).cast("string").alias("t"), F.col("lat").cast("double").alias("y"), F.col("lng").cast("double").alias("x"), F.col(relevance).cast("double").alias("m"))
        o, d = (t.select(*[F.col(c).alias(f"{p}{c}") for c in t.columns]) for p in ("o", "d"))
        rows = flows.where("origin <> destination and flow is not null").join(o, F.col("origin") == F.col("ot")).join(d, F.col("destination") == F.col("dt")).where("dm > 0")
        km = haversine_km(F.col("oy"), F.col("ox"), F.col("dy"), F.col("dx"))
        rows = rows.withColumn("_km", km).where("_km > 0")
        far = -F.col("_km") if self.deterrence == "exponential" else F.log("_km")
        single = self.constraint == "singly constrained"
        features = ["d", "f"] if single else ["d", "f", "o"]
        rows = rows.select("origin", F.col("flow").cast("double").alias("n"), F.log("dm").alias("d"), far.alias("f"), F.when(F.col("om") > 0, F.log("om")).alias("o"))
        rows = rows if single else rows.where("o is not null")
        rows = written(rows.select("origin", "n", *features).repartition("origin").sortWithinPartitions("origin"), "pairs")
        size = len(features)
        # one term in all: every share of the pairs tells its sums relative to its own greatest score
        shares = rows.repartition("origin").sortWithinPartitions("origin") if single else rows

        def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            """Log-likelihood, gradient and Hessian at ``w``."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                groups = whole_groups(batches, ["origin"]) if single else ((pa.table(b), np.arange(b.num_rows) == 0) for b in batches if b.num_rows)
                for t, starts in groups:
                    x, n = np.column_stack([column(t, c) for c in features]), column(t, "n")
                    score = x @ w
                    at = np.flatnonzero(starts)
                    top = np.maximum.reduceat(score, at)
                    e = np.exp(score - np.repeat(top, np.diff(np.r_[at, len(n)])))
                    add = lambda v: np.add.reduceat(v, at, axis=0)
                    pair = (x[:, :, None] * x[:, None, :]).reshape(len(n), -1)
                    cells = np.column_stack([top, add(e), add(n), add(n * score), add(e[:, None] * x), add(n[:, None] * x), add(e[:, None] * pair)])
                    if single:
                        cells = _multinomial(cells, size).sum(axis=0)[None]
                    yield pa.record_batch([pa.array(cells.tolist(), pa.list_(pa.float64()))], names=["v"])

            parts = np.array([r[0] for r in shares.mapInArrow(run, "v array<double>").collect()])  # a row for every batch of pairs at most
            if not len(parts):
                return 0.0, np.zeros(size), np.zeros((size, size))
            if not single:
                parts[:, [1, *range(4, 4 + size), *range(4 + 2 * size, parts.shape[1])]] *= np.exp(parts[:, :1] - parts[:, 0].max())
                parts[:, 0] = parts[:, 0].max()
                parts = _multinomial(np.r_[parts[:1, :1], parts[:, 1:].sum(axis=0)[:, None]].reshape(1, -1), size)
            v = parts.sum(axis=0)
            return float(v[0]), v[1 : 1 + size], v[1 + size :].reshape(size, size)

        w = np.array([1.0, 0.0 if self.deterrence == "exponential" else -1.0, 1.0][:size])
        value, slope, bend = sums(w)
        for _ in range(50):
            step = np.linalg.lstsq(-bend, slope, rcond=None)[0]
            if not np.isfinite(step).all() or np.abs(step).max() < 1e-9:
                break
            for _ in range(30):
                new = sums(w + step)
                if new[0] >= value - 1e-9 * abs(value):
                    break
                step = step / 2
            w, (value, slope, bend) = w + step, new
        return dataclasses.replace(self, destination_exp=float(w[0]), argument=float(w[1]), origin_exp=self.origin_exp if single else float(w[2]))


def _multinomial(cells: np.ndarray, size: int) -> np.ndarray:
    """By group: log-likelihood, its gradient and its Hessian, from the greatest score, sums of weights, flows, flows times score, weighted
    features, features times flows and weighted products of features."""
    top, e, n, score = cells[:, 0], cells[:, 1], cells[:, 2], cells[:, 3]
    mean = cells[:, 4 : 4 + size] / e[:, None]
    products = cells[:, 4 + 2 * size :] / e[:, None]
    spread = products - (mean[:, :, None] * mean[:, None, :]).reshape(len(cells), -1)
    return np.column_stack([score - n * (top + np.log(e)), cells[:, 4 + size : 4 + 2 * size] - n[:, None] * mean, -n[:, None] * spread])


@dataclasses.dataclass
class Radiation:
    """Flows by the relevance that lies nearer than the destination."""

    def probabilities(self, a: TileArrays, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(destinations in the order of distance, probabilities); ties in distance, to the micrometre, in the order of tiles."""
        d = haversine_np(a.lat[i], a.lng[i], a.lat, a.lng)
        j = np.lexsort((np.arange(len(d)), np.round(d, 9)))
        j = j[j != i]
        m, n = a.relevance[i], a.relevance[j]
        inside = np.r_[0.0, np.cumsum(n)[:-1]] if len(n) else n
        with np.errstate(all="ignore"):
            p = m * n / ((m + inside) * (m + inside + n)) / (1 - m / a.relevance.sum())
        p[~np.isfinite(p)] = 0
        return j, p

    def generate(self, tiles: DataFrame, tile_id: str = "tile_ID", tot_outflows: str = "tot_outflow", relevance: str = "relevance", out_format: str = "flows", seed: int = 0) -> DataFrame:
        """``origin``, ``destination``, ``flow`` above zero: mean flows (whole numbers), a random sample, or probabilities. Origins without outflow have none."""
        _check(tiles, out_format, tot_outflows)
        a = tile_arrays(tiles, tile_id, relevance, tot_outflows if out_format != "probabilities" else None)

        def row(a, i):
            j, p = self.probabilities(a, i)
            if a.outflow is None:
                return j, p
            if a.outflow[i] <= 0:
                return j[:0], p[:0]
            if out_format == "flows":
                return j, np.rint(a.outflow[i] * p)
            rest = max(0.0, 1 - p.sum())
            return j, np.random.default_rng([seed, i]).multinomial(int(a.outflow[i]), np.r_[p, rest] / (p.sum() + rest))[:-1].astype(float)

        return _by_origin(tiles, a, row)
