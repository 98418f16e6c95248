"""Measures of individuals. Each takes a trajectory frame (lat, lng, datetime, and uid unless it is one individual's) and
returns one row per individual, or several where the measure has several.

What depends only on where someone was works on visits, the map-side combined counts by individual and location, so a
hot individual is as small as its distinct locations. What depends on order uses the row before (see ordered).
Rows with a null uid form no individual in ordered measures; null positions are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.geo import haversine_km
from pathloom.operators.ordered import with_previous
from pathloom.schema import user_keys


def _placed(traj: DataFrame) -> DataFrame:
    return traj.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())


def visits(traj: DataFrame) -> DataFrame:
    """Count of rows by individual and location: ``uid``, ``lat``, ``lng``, ``n``, ``first`` (earliest datetime)."""
    return _placed(traj).groupBy(*user_keys(traj), "lat", "lng").agg(F.count("*").alias("n"), F.min("datetime").alias("first"))


def _radius(v: DataFrame, keys: list[str], name: str) -> DataFrame:
    centre = v.groupBy(*keys).agg((F.sum(F.col("lat") * F.col("n")) / F.sum("n")).alias("_y"), (F.sum(F.col("lng") * F.col("n")) / F.sum("n")).alias("_x"))
    joined = v.join(centre, keys) if keys else v.crossJoin(F.broadcast(centre))  # one row
    d = haversine_km(F.col("lat"), F.col("lng"), F.col("_y"), F.col("_x"))
    return joined.groupBy(*keys).agg(F.sqrt(F.sum(d * d * F.col("n")) / F.sum("n")).alias(name))


def radius_of_gyration(traj: DataFrame) -> DataFrame:
    """Root mean square distance of the rows from their mean position, in km."""
    return _radius(visits(traj), user_keys(traj), "radius_of_gyration")


def _by(keys: list[str]) -> Window:
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def k_radius_of_gyration(traj: DataFrame, k: int = 2) -> DataFrame:
    """:func:`radius_of_gyration` over the ``k`` most visited locations (ties: the one visited first, then lat, lng)."""
    keys = user_keys(traj)
    order = [F.desc("n"), F.col("first"), F.col("lat"), F.col("lng")]
    if not keys:
        return _radius(visits(traj).orderBy(*order).limit(k), keys, f"{k}k_radius_of_gyration")
    return _radius(visits(traj).withColumn("_r", F.row_number().over(_by(keys).orderBy(*order))).where(F.col("_r") <= k), keys, f"{k}k_radius_of_gyration")


def number_of_locations(traj: DataFrame) -> DataFrame:
    return visits(traj).groupBy(*user_keys(traj)).agg(F.count("*").alias("number_of_locations"))


def random_entropy(traj: DataFrame) -> DataFrame:
    """Binary logarithm of the number of distinct locations."""
    return visits(traj).groupBy(*user_keys(traj)).agg(F.log2(F.count("*")).alias("random_entropy"))


def uncorrelated_entropy(traj: DataFrame, normalize: bool = False) -> DataFrame:
    """Shannon entropy (base 2) of the shares of visits; normalized by its greatest value, 0 for a single location."""
    keys = user_keys(traj)
    p = F.col("n") / F.sum("n").over(_by(keys))
    out = visits(traj).withColumn("_p", p).groupBy(*keys).agg((-F.sum(F.col("_p") * F.log2("_p"))).alias("e"), F.count("*").alias("m"))
    e = F.when(F.col("m") > 1, F.col("e")).otherwise(F.lit(0.0))
    if normalize:
        return out.select(*keys, F.when(F.col("m") > 1, F.col("e") / F.log2("m")).otherwise(F.lit(0.0)).alias("norm_uncorrelated_entropy"))
    return out.select(*keys, e.alias("uncorrelated_entropy"))


def real_entropy(traj: DataFrame) -> DataFrame:
    """Lempel-Ziv estimate of the entropy rate: n log2 n over the sum of the lengths of the shortest new substrings.

    Sequential by nature: one individual's locations (as numbers) are one group. A suffix automaton of the part already
    seen answers each question in the length of the match, so a sequence takes time linear in its length and matches.
    """
    keys = user_keys(traj)
    kind = ", ".join(f"`{k}` {traj.schema[k].dataType.simpleString()}" for k in keys)

    def estimate(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["datetime", "lat", "lng"], kind="stable")
        codes, _ = pd.factorize(pd.Series(list(zip(pdf["lat"], pdf["lng"]))))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "real_entropy": [lempel_ziv_entropy(codes.tolist())]})

    rows = _placed(traj).select(*keys, "lat", "lng", "datetime")
    return rows.groupBy(*keys).applyInPandas(estimate, f"{kind}{', ' if kind else ''}real_entropy double")


def lempel_ziv_entropy(seq: list) -> float:
    """Of a sequence of n symbols: n log2 n over the sum of match lengths (the first two together count 3); 0 for n < 2."""
    import math

    n = len(seq)
    if n < 2:
        return 0.0
    total = 3
    # Online suffix automaton of seq[:i]; the match of seq[i:] is walked from the root.
    link, length, to = [-1], [0], [{}]
    last = 0

    def extend(c):
        nonlocal last
        cur = len(link)
        link.append(0), length.append(length[last] + 1), to.append({})
        p = last
        while p != -1 and c not in to[p]:
            to[p][c] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = to[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(link)
                link.append(link[q]), length.append(length[p] + 1), to.append(dict(to[q]))
                while p != -1 and to[p].get(c) == q:
                    to[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur

    extend(seq[0])
    for i in range(1, n - 1):
        state, j = 0, i
        while j < n and seq[j] in to[state]:
            state = to[state][seq[j]]
            j += 1
        # what is known ends before j, so the shortest new substring has one more; one that reaches the end counts one longer
        total += (j - i + 1) if j + 1 < n else (n - i + 1)
        extend(seq[i])
    return n * math.log2(n) / total


def _steps(traj: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows with the position and time before them."""
    keys = user_keys(traj)
    rows = _placed(traj) if keys else _placed(traj).withColumn("uid", F.lit(0))
    return with_previous(rows, "uid", ["datetime", "lat", "lng"], {"_lat": "lat", "_lng": "lng", "_t": "datetime"}), keys


def _jump() -> Column:
    return haversine_km(F.col("_lat"), F.col("_lng"), F.col("lat"), F.col("lng"))


def jumps(traj: DataFrame) -> DataFrame:
    """One row per step: ``uid``, ``datetime`` of its end, ``jump_length`` in km. (The merged form of :func:`jump_lengths`.)"""
    steps, keys = _steps(traj)
    return steps.where(F.col("_t").isNotNull()).select(*keys, "datetime", _jump().alias("jump_length"))


def jump_lengths(traj: DataFrame) -> DataFrame:
    """An array of the lengths of steps in the order of time; empty for a single row. For hot individuals use :func:`jumps`."""
    steps, keys = _steps(traj)
    own = F.sort_array(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("datetime", "lat", "lng", _jump().alias("d")))))
    return steps.groupBy(*keys).agg(F.transform(own, lambda s: s["d"]).alias("jump_lengths"))


def maximum_distance(traj: DataFrame) -> DataFrame:
    """The longest step; NaN for a single row."""
    steps, keys = _steps(traj)
    return steps.groupBy(*keys).agg(F.coalesce(F.max(_jump()), F.lit(float("nan"))).alias("maximum_distance"))


def distance_straight_line(traj: DataFrame) -> DataFrame:
    """The sum of the steps; 0 for a single row."""
    steps, keys = _steps(traj)
    return steps.groupBy(*keys).agg(F.coalesce(F.sum(_jump()), F.lit(0.0)).alias("distance_straight_line"))


def _wait() -> Column:
    return F.floor((F.unix_micros(F.col("datetime").cast("timestamp")) - F.unix_micros(F.col("_t").cast("timestamp"))) / F.lit(1e6)).cast("double")


def waits(traj: DataFrame) -> DataFrame:
    """One row per step: ``uid``, ``datetime`` of its end, ``waiting_time`` in whole seconds. (The merged form of :func:`waiting_times`.)"""
    steps, keys = _steps(traj)
    return steps.where(F.col("_t").isNotNull()).select(*keys, "datetime", _wait().alias("waiting_time"))


def waiting_times(traj: DataFrame) -> DataFrame:
    """An array of the times between rows, in whole seconds. For hot individuals use :func:`waits`."""
    steps, keys = _steps(traj)
    own = F.sort_array(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("datetime", "lat", "lng", _wait().alias("s")))))
    return steps.groupBy(*keys).agg(F.transform(own, lambda s: s["s"]).alias("waiting_times"))


def number_of_visits(traj: DataFrame) -> DataFrame:
    return traj.groupBy(*user_keys(traj)).agg(F.count("*").alias("number_of_visits"))


def at_night(start_night: str = "22:00", end_night: str = "07:00") -> Column:
    """Whether the time of day lies between the two, both included, across midnight if the first is the later."""
    t = F.hour("datetime") * 3600 + F.minute("datetime") * 60 + F.second("datetime")
    a, b = (sum(int(x) * s for x, s in zip(v.split(":"), (3600, 60, 1))) for v in (start_night, end_night))
    whole = F.unix_micros(F.col("datetime").cast("timestamp")) % 1_000_000 == 0
    late = (t < b) | ((t == b) & whole)  # the end is included, not the fractions after it
    return (t >= a) & late if a <= b else (t >= a) | late


def home_location(traj: DataFrame, start_night: str = "22:00", end_night: str = "07:00") -> DataFrame:
    """The location visited most at night, or at all by those never seen at night; ties go to the least lat, lng."""
    keys = user_keys(traj)
    v = _placed(traj).groupBy(*keys, "lat", "lng").agg(F.count("*").alias("n"), F.sum(at_night(start_night, end_night).cast("long")).alias("night"))
    rank = F.row_number().over(_by(keys).orderBy(F.desc("night"), F.desc(F.when(F.col("night") > 0, 0).otherwise(F.col("n"))), "lat", "lng"))
    return v.withColumn("_r", rank).where("_r = 1").select(*keys, "lat", "lng")


def max_distance_from_home(traj: DataFrame, start_night: str = "22:00", end_night: str = "07:00") -> DataFrame:
    keys = user_keys(traj)
    home = home_location(traj, start_night, end_night).select(*keys, F.col("lat").alias("_y"), F.col("lng").alias("_x"))
    v = visits(traj)
    joined = v.join(home, keys) if keys else v.crossJoin(F.broadcast(home))  # one row
    return joined.groupBy(*keys).agg(F.max(haversine_km(F.col("lat"), F.col("lng"), F.col("_y"), F.col("_x"))).alias("max_distance_from_home"))


def location_frequency(traj: DataFrame, normalize: bool = True, as_ranks: bool = False, location_columns: tuple[str, ...] = ("lat", "lng")) -> DataFrame:
    """Visits to each location, as shares if ``normalize``; with ``as_ranks`` the mean share of the j-th most visited
    location over those who have that many (``rank``, ``location_frequency``)."""
    keys, at = user_keys(traj), list(location_columns)
    v = traj.groupBy(*keys, *at).agg(F.count("*").alias("n"))
    value = F.col("n") / F.sum("n").over(_by(keys)) if normalize or as_ranks else F.col("n")
    if not as_ranks:
        return v.select(*keys, *at, value.alias("location_frequency"))
    rank = F.row_number().over(_by(keys).orderBy(F.desc("n"), *at)).cast("long")
    return v.select(value.alias("f"), rank.alias("rank")).groupBy("rank").agg(F.avg("f").alias("location_frequency"))


def individual_mobility_network(traj: DataFrame, self_loops: bool = False) -> DataFrame:
    """Trips between consecutive locations: ``uid``, ``lat_origin``, ``lng_origin``, ``lat_dest``, ``lng_dest``, ``n_trips``."""
    steps, keys = _steps(traj)
    moved = steps.where(F.col("_t").isNotNull())
    if not self_loops:
        moved = moved.where((F.col("_lat") != F.col("lat")) | (F.col("_lng") != F.col("lng")))
    out = moved.select(*keys, F.col("_lat").alias("lat_origin"), F.col("_lng").alias("lng_origin"), F.col("lat").alias("lat_dest"), F.col("lng").alias("lng_dest"))
    return out.groupBy(*out.columns).agg(F.count("*").alias("n_trips"))


def recency_rank(traj: DataFrame) -> DataFrame:
    """Locations by their last visit, the latest first (ties: lat, lng)."""
    keys = user_keys(traj)
    v = _placed(traj).groupBy(*keys, "lat", "lng").agg(F.max("datetime").alias("_t"))
    return v.select(*keys, "lat", "lng", F.row_number().over(_by(keys).orderBy(F.desc("_t"), "lat", "lng")).cast("long").alias("recency_rank"))


def frequency_rank(traj: DataFrame) -> DataFrame:
    """Locations by their visits, the most first (ties: lat, lng)."""
    keys = user_keys(traj)
    return visits(traj).select(*keys, "lat", "lng", F.row_number().over(_by(keys).orderBy(F.desc("n"), "lat", "lng")).cast("long").alias("frequency_rank"))


def frequency_vector(traj: DataFrame) -> DataFrame:
    """``uid``, ``lat``, ``lng``, ``freq``."""
    return visits(traj).select(*user_keys(traj), "lat", "lng", F.col("n").alias("freq"))


def probability_vector(traj: DataFrame) -> DataFrame:
    """``uid``, ``lat``, ``lng``, ``prob``: visits over all visits of the individual."""
    keys = user_keys(traj)
    return visits(traj).select(*keys, "lat", "lng", (F.col("n") / F.sum("n").over(_by(keys))).alias("prob"))
