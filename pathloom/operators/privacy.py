"""Risk of re-identification under attacks with some knowledge of an individual's trajectory.

An instance is what an attacker knows: ``k`` elements of the individual's (all, if there are fewer). Its probability of
re-identification is one over the number of individuals it fits, and the risk is the greatest over all instances. An
individual fits an instance exactly if the instance is also one of its own, so no pair of individuals is ever compared:
everyone's distinct instances are counted by instance. With a tolerance fitting is no equality, and the elements of the
distinct instances are joined with the individuals that have them.

The number of instances grows with the k-th power of an individual's elements: that is the attack, not the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators.individual import frequency_vector, probability_vector
from pathloom.session import written

PRECISIONS = {"year": "yyyy", "month": "yyyyMM", "day": "yyyyMMdd", "hour": "yyyyMMddHH", "minute": "yyyyMMddHHmm", "second": "yyyyMMddHHmmss"}


def time_bucket(datetime: Column, precision: str = "Hour") -> Column:
    """The datetime cut to a precision, as digits; ValueError for an unknown one."""
    if precision.lower() not in PRECISIONS:
        raise ValueError(f"unknown precision {precision!r}")
    return F.date_format(datetime, PRECISIONS[precision.lower()])


def _combinations(elements: DataFrame, sizes: list[int]) -> DataFrame:
    """All combinations, in order, of ``sizes`` elements of each individual: ``uid``, ``size``, ``inst``. ``elements`` has uid and own (array)."""
    rows = elements.withColumns({"inst": F.slice("own", 1, 0), "_at": F.lit(0)})
    out = None
    for size in range(1, max(sizes) + 1):
        rows = rows.where(F.col("_at") < F.size("own"))
        if size in sizes:  # the array isn't carried along to the instances
            rest = F.slice("own", F.col("_at") + 1, F.size("own"))
            part = rows.select("uid", F.lit(size).alias("size"), F.explode(F.transform(rest, lambda e: F.concat("inst", F.array(e)))).alias("inst"))
            out = part if out is None else out.unionByName(part)
        if size < max(sizes):
            rows = rows.withColumn("_i", F.explode(F.sequence(F.col("_at") + 1, F.size("own"))))
            rows = rows.select("uid", "own", F.concat("inst", F.slice("own", F.col("_i"), 1)).alias("inst"), F.col("_i").alias("_at"))
    return out


class Attack:
    """An attack with ``knowledge_length`` elements. Subclasses say what an element is, and what makes two instances the same."""

    ordered = False

    def __init__(self, knowledge_length: int):
        if knowledge_length < 1:
            raise ValueError("knowledge_length must be at least 1")
        self.knowledge_length = knowledge_length

    def elements(self, traj: DataFrame) -> DataFrame:
        """``uid``, ``e`` (struct of the element's fields), and ``at`` (their order) where order matters."""
        return traj.select("uid", F.struct("lat", "lng").alias("e"))

    def by_elements(self) -> bool:
        """Whether instances are the same just where their elements are."""
        return type(self).key is Attack.key and type(self)._counts is Attack._counts

    def key(self, inst: Column) -> Column:
        """What instances are compared by. Where order doesn't matter, elements are sorted before they are combined, so instances are too."""
        return inst

    def _own(self, traj: DataFrame) -> DataFrame:
        rows = self.elements(traj.where("uid is not null and lat is not null and lng is not null"))
        if not self.ordered:
            return rows.groupBy("uid").agg(F.sort_array(F.collect_list("e")).alias("own"))
        own = F.sort_array(F.collect_list(F.struct("at", "e")))
        return rows.groupBy("uid").agg(F.transform(own, lambda s: s["e"]).alias("own"))

    def _few(self, traj: DataFrame) -> DataFrame:
        """As :meth:`_own`, with no more copies of an element than distinct instances need: k where order doesn't matter, and in
        sequences of up to two the first and the last. Whoever has k elements or more still has k, the others have all."""
        k = self.knowledge_length
        rows = self.elements(traj.where("uid is not null and lat is not null and lng is not null"))
        if not self.ordered:
            few = rows.groupBy("uid", "e").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
            return few.groupBy("uid").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("e", "n"))), lambda s: F.array_repeat(s["e"], s["n"]))).alias("own"))
        if k > 2:
            return self._own(traj)
        ends = rows.groupBy("uid", "e").agg(F.count("*").alias("n"), F.min("at").alias("a"), F.max("at").alias("b"))
        two = ends.select("uid", "e", F.explode(F.when(F.col("n") > 1, F.array("a", "b")).otherwise(F.array("a"))).alias("at"))
        return two.groupBy("uid").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "e"))), lambda s: s["e"]).alias("own"))

    def _instances(self, traj: DataFrame, copies: bool = True) -> DataFrame:
        """Instances of the lengths that targets can have: k, and all their elements for those with fewer. Without ``copies``
        each distinct one is there, but not as often as it occurs."""
        own = self._own(traj) if copies else self._few(traj)
        short = sorted(r[0] for r in own.where(F.size("own") < self.knowledge_length).select(F.size("own").alias("n")).distinct().collect())  # fewer than k numbers
        return _combinations(own, [*short, self.knowledge_length])

    def _counts(self, traj: DataFrame) -> DataFrame:
        """``uid``, ``size``, ``key``, ``n``: everyone's distinct instances and how many individuals each fits."""
        own = self._instances(traj, copies=False).select("uid", "size", self.key(F.col("inst")).alias("key")).distinct()
        fits = own.groupBy("size", "key").agg(F.count("*").alias("n"))
        return own.join(fits, ["size", "key"])

    def _pair_risks(self, traj: DataFrame, chosen: DataFrame | None) -> DataFrame:
        """``uid``, ``risk`` for two elements: they are numbered once, each individual's distinct pairs follow from its distinct
        elements, and one shuffle of three numbers a pair counts whom it fits."""
        rows = self.elements(traj.where("uid is not null and lat is not null and lng is not null"))
        if self.ordered:
            rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("uid").orderBy("at")))
        else:
            rows = rows.withColumn("i", F.lit(1))
        held = rows.groupBy("uid", "e").agg(F.count("*").alias("n"), F.min("i").alias("a"), F.max("i").alias("b"))
        numbers = written(held.select("e").distinct().withColumn("x", F.monotonically_increasing_id()), "elements")
        own = held.join(numbers, "e").groupBy("uid").agg(F.collect_list(F.struct("x", "n", "a", "b")).alias("own"), F.sum("n").alias("m"))
        one = F.transform("own", lambda p: p["x"])
        if self.ordered:
            pairs = lambda p: F.transform(F.filter("own", lambda q: p["a"] < q["b"]), lambda q: q["x"])
        else:
            pairs = lambda p: F.transform(F.filter("own", lambda q: (p["x"] < q["x"]) | ((p["x"] == q["x"]) & (p["n"] > 1))), lambda q: q["x"])
        two = own.where("m > 1").select("uid", "own", F.explode("own").alias("p")).select("uid", F.col("p.x").alias("x"), F.explode(pairs(F.col("p"))).alias("y"))
        fits = two.withColumn("n", F.count("*").over(Window.partitionBy("x", "y")))
        risks = fits.groupBy("uid").agg(F.min("n").alias("n"))
        # whoever has a single element is known by it alone
        alone = own.where("m = 1").select("uid", F.explode(one).alias("x"))
        everyone = held.join(numbers, "e").groupBy("x").agg(F.count("*").alias("n"))
        risks = risks.unionByName(alone.join(everyone, "x").select("uid", "n"))
        if chosen is not None:
            risks = risks.join(chosen, "uid", "left_semi")
        return risks.select("uid", (F.lit(1.0) / F.col("n")).alias("risk"))

    def assess_risk(self, traj: DataFrame, targets: DataFrame | list | None = None, force_instances: bool = False) -> DataFrame:
        """``uid``, ``risk``; or with ``force_instances`` each element of each instance with its probability (``prob``)."""
        chosen = None
        if targets is not None:
            chosen = targets.select("uid").distinct() if isinstance(targets, DataFrame) else traj.sparkSession.createDataFrame([(t,) for t in targets], f"uid {traj.schema['uid'].dataType.simpleString()}")
        if self.knowledge_length == 2 and not force_instances and self.by_elements():
            return self._pair_risks(traj, chosen)
        counts = self._counts(traj)
        # An instance is a target's only in the length that its elements allow.
        most = self._few(traj).select("uid", F.least(F.size("own"), F.lit(self.knowledge_length)).alias("size"))
        if chosen is not None:
            most = most.join(chosen, "uid", "left_semi")
        own = counts.join(most, ["uid", "size"])
        if not force_instances:
            return own.groupBy("uid").agg((F.lit(1.0) / F.min("n")).alias("risk"))
        every = self._instances(traj).join(most, ["uid", "size"]).withColumn("key", self.key(F.col("inst")))
        number = F.row_number().over(Window.partitionBy("uid").orderBy("inst")) - 1
        told = every.withColumn("instance", number).join(own.select("uid", "size", "key", "n"), ["uid", "size", "key"])
        spread = told.select("uid", "instance", (F.lit(1.0) / F.col("n")).alias("prob"), F.posexplode("inst").alias("_i", "e"))
        return spread.select("e.*", "uid", "instance", (F.col("_i") + 1).alias("instance_elem"), "prob")


class LocationAttack(Attack):
    """Locations, as often as they are known; order doesn't matter."""


class LocationSequenceAttack(Attack):
    """Locations in their order, not necessarily one after the other."""

    ordered = True

    def elements(self, traj: DataFrame) -> DataFrame:
        return traj.select("uid", F.struct("datetime", "lat", "lng").alias("at"), F.struct("lat", "lng").alias("e"))


class LocationTimeAttack(Attack):
    """Locations with their time, cut to a precision."""

    def __init__(self, knowledge_length: int, time_precision: str = "Hour"):
        super().__init__(knowledge_length)
        if time_precision.lower() not in PRECISIONS:
            raise ValueError(f"unknown precision {time_precision!r}")
        self.time_precision = time_precision

    def elements(self, traj: DataFrame) -> DataFrame:
        t = F.unix_seconds(F.date_trunc(self.time_precision, F.col("datetime").cast("timestamp")))
        return traj.select("uid", F.struct("lat", "lng", t.alias("time")).alias("e"))


class UniqueLocationAttack(Attack):
    """Distinct locations."""

    def elements(self, traj: DataFrame) -> DataFrame:
        return frequency_vector(traj).select("uid", F.struct("lat", "lng").alias("e"))


class _Valued(Attack):
    """Distinct locations with a number each, which may deviate by ``tolerance`` of the other's."""

    def __init__(self, knowledge_length: int, tolerance: float = 0.0):
        super().__init__(knowledge_length)
        if not 0 <= tolerance <= 1:
            raise ValueError("tolerance must lie between 0 and 1")
        self.tolerance = tolerance

    def vector(self, traj: DataFrame) -> DataFrame:
        return frequency_vector(traj).select("uid", "lat", "lng", F.col("freq").cast("double").alias("value"))

    def elements(self, traj: DataFrame) -> DataFrame:
        return self.vector(traj).select("uid", F.struct("lat", "lng", "value").alias("e"))

    relative = False  # to the greatest number of the instance

    def by_elements(self) -> bool:
        return not self.relative and self.tolerance == 0

    def key(self, inst: Column) -> Column:
        if not self.relative:
            return inst
        top = F.array_max(F.transform(inst, lambda e: e["value"]))
        return F.transform(inst, lambda e: F.struct(e["lat"].alias("lat"), e["lng"].alias("lng"), (e["value"] / top).alias("value")))

    def _counts(self, traj: DataFrame) -> DataFrame:
        if self.tolerance == 0:
            return super()._counts(traj)
        own = self._instances(traj, copies=False).select("uid", "size", self.key(F.col("inst")).alias("key")).distinct()
        kinds = own.select("size", "key").distinct()
        parts = kinds.select("size", "key", F.explode("key").alias("e")).select("size", "key", F.col("e.lat").alias("lat"), F.col("e.lng").alias("lng"), F.col("e.value").alias("known"))
        other = self.vector(traj.where("uid is not null and lat is not null and lng is not null"))
        met = parts.join(other, ["lat", "lng"])
        value = F.col("value")
        if self.relative:
            value = value / F.max("value").over(Window.partitionBy("size", "key", "uid"))
        met = met.withColumn("value", value)
        ok = (F.col("known") >= F.col("value") - F.col("value") * self.tolerance) & (F.col("known") <= F.col("value") + F.col("value") * self.tolerance)
        fits = met.groupBy("size", "key", "uid").agg(F.sum(ok.cast("int")).alias("m")).where(F.col("m") == F.col("size"))
        return own.join(fits.groupBy("size", "key").agg(F.count("*").alias("n")), ["size", "key"])


class LocationFrequencyAttack(_Valued):
    """Distinct locations with their numbers of visits."""


class LocationProbabilityAttack(_Valued):
    """Distinct locations with their shares of visits."""

    def vector(self, traj: DataFrame) -> DataFrame:
        return probability_vector(traj).select("uid", "lat", "lng", F.col("prob").alias("value"))


class LocationProportionAttack(_Valued):
    """Distinct locations with their visits relative to the most visited of them."""

    relative = True


class HomeWorkAttack(Attack):
    """The two locations at the head of the frequency vector in rising order (ties: lat, lng)."""

    def __init__(self, knowledge_length: int = 1):
        super().__init__(knowledge_length)

    def _own(self, traj: DataFrame) -> DataFrame:
        v = frequency_vector(traj.where("uid is not null and lat is not null and lng is not null"))
        rank = F.row_number().over(Window.partitionBy("uid").orderBy("freq", "lat", "lng"))
        two = v.withColumn("_r", rank).where("_r <= 2")
        return two.groupBy("uid").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "lat", "lng"))), lambda s: F.struct(s["lat"].alias("lat"), s["lng"].alias("lng"))).alias("own"))

    def _counts(self, traj: DataFrame) -> DataFrame:
        own = self._own(traj).select("uid", F.size("own").alias("size"), F.array_sort("own").alias("key"))
        # one known location fits whoever has it among the two
        subsets = own.select("size", "key").unionByName(own.where("size = 2").select(F.lit(1).alias("size"), F.explode(F.transform("key", lambda e: F.array(e))).alias("key")))
        return own.join(subsets.groupBy("size", "key").agg(F.count("*").alias("n")), ["size", "key"])

    def _instances(self, traj: DataFrame) -> DataFrame:
        return self._own(traj).select("uid", F.size("own").alias("size"), F.col("own").alias("inst"))

    def assess_risk(self, traj: DataFrame, targets: DataFrame | list | None = None, force_instances: bool = False) -> DataFrame:
        self.knowledge_length, kept = 2, self.knowledge_length
        try:
            return super().assess_risk(traj, targets, force_instances)
        finally:
            self.knowledge_length = kept
