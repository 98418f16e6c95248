"""Points near other points, and points in regions.

Sites become vectors on the unit sphere, so that distance is chord length and neither the poles nor 180 degrees are
seams. k-d splits cut the sphere into leaves; a site is copied into every leaf that its reach touches (its halo), so a
point needs only the one leaf it lies in. Regions are found by a sweep over the edges of their rings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.geo import EARTH_RADIUS_KM, haversine_np, unit_vectors

#: With at most so many places (and ring corners) they are collected and sent to every task; else both sides are partitioned.
MOST_BROADCAST = 200_000
#: Rows of points that one task of the partitioned form takes from one leaf.
LEAF_POINTS = 500_000
#: Sites from which the splits of the partitioned form are fitted.
SPLIT_SAMPLE = 100_000
#: Places of a leaf or stripe, about (before halo copies); there are at least 16 stripes and at most 4,000.
LEAF_PLACES = 5_000


class KDSplits:
    """k-d splits over sites with reaches; ``leaves[i]`` has the sites whose reach touches leaf i."""

    def __init__(self, vectors: np.ndarray, reach: np.ndarray, leaf: int = 16):
        self.axis, self.at, self.kids, self.leaf_of, self.leaves = [], [], [], [], []
        self._grow(vectors, reach, np.arange(len(vectors)), leaf)
        self.axis, self.at = np.array(self.axis), np.array(self.at)
        self.kids, self.leaf_of = np.array(self.kids).reshape(-1, 2), np.array(self.leaf_of)

    def _grow(self, v: np.ndarray, r: np.ndarray, own: np.ndarray, leaf: int) -> int:
        node = len(self.axis)
        for x, y in ((self.axis, 0), (self.at, 0.0), (self.kids, (-1, -1)), (self.leaf_of, -1)):
            x.append(y)
        if len(own) > leaf:
            a = int(np.argmax(np.ptp(v[own], axis=0)))
            cut = float(np.median(v[own, a]))
            low, high = own[v[own, a] - r[own] <= cut], own[v[own, a] + r[own] > cut]
            if max(len(low), len(high)) < 0.9 * len(own):
                self.axis[node], self.at[node] = a, cut
                self.kids[node] = (self._grow(v, r, low, leaf), self._grow(v, r, high, leaf))
                return node
        self.leaf_of[node] = len(self.leaves)
        self.leaves.append(own)
        return node

    def locate(self, p: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        node = np.zeros(len(p), np.int64)
        open_ = np.flatnonzero(self.leaf_of[node] < 0)
        while len(open_):
            n = node[open_]
            node[open_] = self.kids[n, (p[open_, self.axis[n]] > self.at[n]).astype(int)]
            open_ = open_[self.leaf_of[node[open_]] < 0]
        return self.leaf_of[node]

    def touched(self, v: np.ndarray, r: np.ndarray) -> list[list[int]]:
        """The leaves that each site with its reach touches."""
        out = []
        for p, d in zip(v, r):
            stack, hit = [0], []
            while stack:
                n = stack.pop()
                if self.leaf_of[n] >= 0:
                    hit.append(int(self.leaf_of[n]))
                else:
                    x = p[self.axis[n]]
                    if x - d <= self.at[n]:
                        stack.append(int(self.kids[n, 0]))
                    if x + d > self.at[n]:
                        stack.append(int(self.kids[n, 1]))
            out.append(hit)
        return out


def chord(radius_m) -> np.ndarray:
    """The length of the chord that spans a great-circle distance, on the unit sphere."""
    return 2 * np.sin(np.minimum(np.asarray(radius_m, float) / 1000 / (2 * EARTH_RADIUS_KM), np.pi / 2)) * (1 + 1e-9) + 1e-12


class Sites:
    """Sites with reaches, answering which of them lie within reach of points."""

    def __init__(self, lat, lng, radius_m):
        self.lat, self.lng, self.radius = np.asarray(lat, float), np.asarray(lng, float), np.asarray(radius_m, float)
        self.vectors, self.reach = unit_vectors(self.lat, self.lng), chord(self.radius)
        self.tree = KDSplits(self.vectors, self.reach)

    def within(self, lat: np.ndarray, lng: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, site, distance in m) of every pair within reach."""
        points, sites = [], []
        if len(self.lat) and len(lat):
            p = unit_vectors(lat, lng)
            leaf = self.tree.locate(p)
            o = np.argsort(leaf, kind="stable")
            cuts = np.flatnonzero(np.r_[True, leaf[o][1:] != leaf[o][:-1]])
            for own in np.split(o, cuts[1:]):
                near = self.tree.leaves[leaf[own[0]]]
                q = p[own]
                for s in near:  # a leaf has few sites, many points
                    d = q - self.vectors[s]
                    hit = own[np.einsum("ij,ij->i", d, d) <= self.reach[s] ** 2]
                    points.append(hit)
                    sites.append(np.full(len(hit), s))
        if not points:
            return np.empty(0, int), np.empty(0, int), np.empty(0)
        i, s = np.concatenate(points), np.concatenate(sites)
        d = haversine_np(lat[i], lng[i], self.lat[s], self.lng[s]) * 1000
        ok = d <= self.radius[s]
        return i[ok], s[ok], d[ok]


class Zones:
    """Rings of zones in degrees, answering which of them contain points (even-odd, so a second ring cuts a hole).

    A sweep over x keeps the edges that cross the current slab; between two corners the set doesn't change, so a point
    needs only the edges of its slab: it is inside the zones of which an odd number of edges lie above it.
    """

    def __init__(self, rings: list[list[list[tuple[float, float]]]]):
        e = []
        for z, zone in enumerate(rings):
            for ring in zone or []:
                for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], *ring[:1]]):
                    if x0 != x1:
                        e.append((z, x0, y0, x1, y1) if x0 < x1 else (z, x1, y1, x0, y0))
        self.e = np.array(e, float).reshape(-1, 5)
        self.xs = np.unique(self.e[:, [1, 3]])
        begin, end = np.searchsorted(self.xs, self.e[:, 1]), np.searchsorted(self.xs, self.e[:, 3])
        starting, ending = np.argsort(begin, kind="stable"), np.argsort(end, kind="stable")
        self.status, active, i, j = [], set(), 0, 0
        for s in range(max(0, len(self.xs) - 1)):
            while j < len(ending) and end[ending[j]] <= s:
                active.discard(int(ending[j]))
                j += 1
            while i < len(starting) and begin[starting[i]] <= s:
                active.add(int(starting[i]))
                i += 1
            self.status.append(np.array(sorted(active), int))  # in the order of zones

    def containing(self, lat: np.ndarray, lng: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, zone) of every pair of a point and a zone that contains it."""
        slab = np.searchsorted(self.xs, lng, "right") - 1
        o = np.flatnonzero((slab >= 0) & (slab < len(self.status)))
        o = o[np.argsort(slab[o], kind="stable")]
        points, zones = [np.empty(0, int)], [np.empty(0, int)]
        if len(o):
            cuts = np.flatnonzero(slab[o][1:] != slab[o][:-1]) + 1
            for own in np.split(o, cuts):
                active = self.status[slab[own[0]]]
                if not len(active):
                    continue
                z, x0, y0, x1, y1 = self.e[active].T
                own = own[(lat[own] >= min(y0.min(), y1.min())) & (lat[own] <= max(y0.max(), y1.max()))]
                first = np.flatnonzero(np.r_[True, z[1:] != z[:-1]])
                for part in np.array_split(own, 1 + len(own) * len(active) // 4_000_000):
                    above = y0 + (lng[part, None] - x0) * ((y1 - y0) / (x1 - x0)) > lat[part, None]
                    i, k = np.nonzero(np.add.reduceat(above, first, axis=1, dtype=np.int32) % 2)
                    points.append(part[i])
                    zones.append(z[first[k]].astype(int))
        return np.concatenate(points), np.concatenate(zones)


def _rings(geometry) -> list:
    return [[(p["x"], p["y"]) for p in ring if p["x"] is not None and p["y"] is not None] for ring in geometry if ring is not None]


class Places:
    """Sites and zones together, from a frame with place_id, lat, lng, radius_m, geometry (rings)."""

    def __init__(self, frame: pd.DataFrame):
        ok = frame["lat"].between(-90, 90) & frame["lng"].between(-180, 180) & (frame["radius_m"] >= 0)
        site = frame[ok & frame["geometry"].isna()]
        zone = frame[frame["geometry"].notna()]
        self.site_id, self.zone_id = site["place_id"].to_numpy(), zone["place_id"].to_numpy()
        self.sites = Sites(site["lat"], site["lng"], site["radius_m"])
        self.zones = Zones([_rings(g) for g in zone["geometry"]])

    def match(self, lat: np.ndarray, lng: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, place_id, distance in m, NaN for zones)."""
        i, s, d = self.sites.within(lat, lng)
        j, z = self.zones.containing(lat, lng)
        ids = np.concatenate([self.site_id[s], self.zone_id[z]]).astype(np.int64)
        return np.concatenate([i, j]).astype(np.int64), ids, np.concatenate([d, np.full(len(j), np.nan)])


def near_places(points: DataFrame, places: DataFrame, point_id: str = "ping_id", lat: str = "lat", lng: str = "lng", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Every pair of a point and a place it is near to or in: ``place_id``, ``point_id``, ``distance_m`` (null for zones).

    ``places`` has place_id, lat, lng, radius_m and geometry (array of rings of {x, y} in degrees; null for sites). A
    site takes points up to ``radius_m`` away on the great circle; a zone takes points within its rings, straight in
    degrees. Points with a null or impossible position, sites without position or radius and zones without rings match
    nothing. Every row of ``points`` is matched, copies too; other columns are ignored, and empty tables give an empty
    result. Up to ``most_broadcast`` places and corners the places are collected and sent to all tasks, and points
    don't move; beyond, both sides are partitioned by k-d splits and stripes, with hot leaves salted.
    """
    y, x = F.col(lat).cast("double"), F.col(lng).cast("double")
    rows = points.select(F.col(point_id).cast("long").alias("id"), y.alias("y"), x.alias("x")).where(F.col("y").between(-90.0, 90.0) & F.col("x").between(-180.0, 180.0))
    kept = places.select("place_id", F.col("lat").cast("double"), F.col("lng").cast("double"), F.col("radius_m").cast("double"), "geometry")
    corners = F.coalesce(F.expr("aggregate(geometry, 0, (n, r) -> n + coalesce(size(r), 0))"), F.lit(1))
    size = places.select(F.coalesce(F.sum(F.greatest(F.lit(1), corners)), F.lit(0))).first()[0]
    out = "place_id long, id long, distance_m double"
    if size <= most_broadcast:
        own = Places(_collected(kept))
        held = points.sparkSession.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                i, place, d = held.value.match(b.column("y").to_numpy(), b.column("x").to_numpy())
                yield pa.record_batch([place, b.column("id").take(pa.array(i)), pa.array(d, from_pandas=True)], names=["place_id", "id", "distance_m"])

        found = rows.mapInArrow(run, out)
    else:
        found = _partitioned(rows, kept.where(F.col("geometry").isNull() & F.col("radius_m").isNotNull()), True, out)
        found = found.unionByName(_partitioned(rows, kept.where(F.col("geometry").isNotNull()), False, out))
    return found.select("place_id", F.col("id").alias(point_id), "distance_m")


def _collected(places: DataFrame) -> pd.DataFrame:
    frame = pd.DataFrame([r.asDict(recursive=True) for r in places.collect()], columns=["place_id", "lat", "lng", "radius_m", "geometry"])
    return frame.astype({"lat": float, "lng": float, "radius_m": float})


def _partitioned(rows: DataFrame, places: DataFrame, sites: bool, out: str) -> DataFrame:
    """Both sides by leaf (sites) or stripe of x (zones). A leaf with many points is cut into salted parts, each with all its places."""
    spark = rows.sparkSession
    if sites:
        sample = places.select("lat", "lng", "radius_m").where("lat is not null and lng is not null").orderBy(F.xxhash64("place_id")).limit(SPLIT_SAMPLE).toPandas()
        count = max(1, places.count())
        tree = KDSplits(unit_vectors(sample["lat"], sample["lng"]), chord(sample["radius_m"]), max(16, min(len(sample) // 256, len(sample) * LEAF_PLACES // count)))

        def leaf_of(y, x):
            return tree.locate(unit_vectors(y, x))

        def leaves_of(f):
            ok = f["lat"].between(-90, 90) & f["lng"].between(-180, 180)
            hit = tree.touched(unit_vectors(f["lat"].where(ok, 0), f["lng"].where(ok, 0)), chord(f["radius_m"]))
            return [h if k else [] for h, k in zip(hit, ok)]
    else:
        low = F.expr("array_min(flatten(transform(geometry, r -> transform(r, p -> p.x))))")
        high = F.expr("array_max(flatten(transform(geometry, r -> transform(r, p -> p.x))))")
        places = places.withColumns({"_lo": low, "_hi": high})
        stripes = int(np.clip(places.count() // LEAF_PLACES, 256, 4_000))
        cut = places.select(F.percentile_approx("_lo", F.array(*[F.lit(i / stripes) for i in range(1, stripes)]), F.lit(40_000))).first()[0] or []
        cut = np.unique(np.array(cut, float))

        def leaf_of(y, x):
            return np.searchsorted(cut, x, "right")

        def leaves_of(f):
            a, b = np.searchsorted(cut, f["_lo"], "right"), np.searchsorted(cut, f["_hi"], "right")
            return [list(range(i, j + 1)) for i, j in zip(a, b)]

    @F.pandas_udf("int")
    def leaf(y: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series(leaf_of(y.to_numpy(), x.to_numpy())).astype("int32")

    @F.pandas_udf("array<int>")
    def leaves(f: pd.DataFrame) -> pd.Series:
        return pd.Series(leaves_of(f))

    left = rows.withColumn("leaf", leaf("y", "x"))
    counts = {r[0]: r[1] for r in left.groupBy("leaf").agg(F.count("*")).collect()}  # a number of leaves that follows the places, of which there are no more than the driver can list
    parts = {k: -(-n // LEAF_POINTS) for k, n in counts.items()}
    table = spark.createDataFrame([(int(k), int(v)) for k, v in parts.items()] or [(-1, 1)], "leaf int, parts int")
    left = left.join(F.broadcast(table), "leaf").withColumn("salt", (F.pmod(F.monotonically_increasing_id(), F.col("parts"))).cast("int"))
    names = ["lat", "lng", "radius_m", *([] if sites else ["_lo", "_hi"])]
    right = places.withColumn("leaf", F.explode(leaves(F.struct(*names)))).join(F.broadcast(table), "leaf")
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("leaf", "salt", "place_id", "lat", "lng", "radius_m", "geometry")

    def match(pings: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        near["geometry"] = [None if g is None else [list(r) for r in g if r is not None] for g in near["geometry"]]
        i, place, d = Places(near).match(pings["y"].to_numpy(float), pings["x"].to_numpy(float))
        return pd.DataFrame({"place_id": place, "id": pings["id"].to_numpy()[i], "distance_m": d})

    return left.groupBy("leaf", "salt").cogroup(right.groupBy("leaf", "salt")).applyInPandas(match, out)

