"""Comparisons of two numeric columns (truth and prediction), each a single-row aggregate, or one row per group with ``by``.

Rows with a null in either column are left out. A denominator of zero gives null, a constant column NaN for correlations.
"""

from __future__ import annotations

import math

import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.operators.ordered import running


def _rows(df: DataFrame, true: str, pred: str, by: list[str] | None) -> DataFrame:
    return df.where(F.col(true).isNotNull() & F.col(pred).isNotNull()).select(*(by or []), F.col(true).cast("double").alias("t"), F.col(pred).cast("double").alias("p"))


def _agg(df: DataFrame, true: str, pred: str, by: list[str] | None, name: str, value: Column) -> DataFrame:
    return _rows(df, true, pred, by).groupBy(*(by or [])).agg(value.alias(name))


def common_part_of_commuters(df: DataFrame, true: str, pred: str, by: list[str] | None = None) -> DataFrame:
    return _agg(df, true, pred, by, "common_part_of_commuters", F.try_divide(2 * F.sum(F.least("t", "p")), F.sum(F.col("t") + F.col("p"))))


def common_part_of_links(df: DataFrame, true: str, pred: str, by: list[str] | None = None) -> DataFrame:
    a, b = (F.col("t") > 0).cast("double"), (F.col("p") > 0).cast("double")
    return _agg(df, true, pred, by, "common_part_of_links", F.try_divide(2 * F.sum(a * b), F.sum(a + b)))


def common_part_of_commuters_distance(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Both columns counted in bins of width 2 from 0 to their common greatest value; the last bin is closed, and a partial one is left out."""
    rows = _rows(df, true, pred, None)
    top = rows.agg(F.max(F.greatest("t", "p")).alias("top"), F.sum("t").alias("total"))
    long_ = rows.select(F.explode(F.array(F.struct(F.col("t").alias("v"), F.lit(1).alias("one")), F.struct(F.col("p").alias("v"), F.lit(0).alias("one")))).alias("s")).select("s.*")
    joined = long_.crossJoin(F.broadcast(top))  # one row
    edges = F.ceil(F.col("top") / 2)  # edges 0, 2, ... below the greatest value
    last = F.greatest(edges - 1, F.lit(0))
    bin_ = F.when((F.col("v") == 2 * last) & (last > 0), last - 1).otherwise(F.floor(F.col("v") / 2))
    counts = joined.where((F.col("v") >= 0) & (F.col("v") <= 2 * last) & (last > 0)).groupBy(bin_.alias("bin")).agg(F.sum("one").alias("a"), F.sum(1 - F.col("one")).alias("b"))
    shared = counts.agg(F.coalesce(F.sum(F.least("a", "b")), F.lit(0)).cast("double").alias("shared"))
    return shared.crossJoin(F.broadcast(top)).select(F.try_divide("shared", "total").alias("common_part_of_commuters_distance"))


def r_squared(df: DataFrame, true: str, pred: str, by: list[str] | None = None) -> DataFrame:
    rest = F.sum((F.col("t") - F.col("p")) * (F.col("t") - F.col("p")))
    return _agg(df, true, pred, by, "r_squared", 1 - F.try_divide(rest, F.var_pop("t") * F.count("t")))


def _mse() -> Column:
    return F.avg((F.col("t") - F.col("p")) * (F.col("t") - F.col("p")))


def mse(df: DataFrame, true: str, pred: str, by: list[str] | None = None) -> DataFrame:
    return _agg(df, true, pred, by, "mse", _mse())


def rmse(df: DataFrame, true: str, pred: str, by: list[str] | None = None) -> DataFrame:
    return _agg(df, true, pred, by, "rmse", F.sqrt(_mse()))


def nrmse(df: DataFrame, true: str, pred: str, by: list[str] | None = None) -> DataFrame:
    return _agg(df, true, pred, by, "nrmse", F.try_divide(F.sqrt(_mse()), F.sum("t")))


def information_gain(df: DataFrame, true: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Sum of t / N ln(t / p) over rows with both above zero, N the sum of the truth."""
    both = (F.col("t") > 0) & (F.col("p") > 0)
    return _agg(df, true, pred, by, "information_gain", F.try_divide(F.sum(F.when(both, F.col("t") * F.log(F.col("t") / F.col("p")))), F.sum("t")))


def _pearson(x: str, y: str) -> Column:
    top = F.covar_pop(x, y)
    below = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(below > 0, top / below).otherwise(F.lit(float("nan")))


def _incomplete_beta(x: float, a: float, b: float) -> float:
    """The regularized incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for i in range(1000):
        m = i // 2
        top = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d or tiny)
        c = 1 + top / c or tiny
        f *= c * d
        if i and abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def p_value(r: Column, n: Column) -> Column:
    """The two-sided p-value of a correlation ``r`` of ``n`` pairs, by Student's t; null for fewer than three pairs or without spread."""

    @F.pandas_udf("double")
    def value(r: pd.Series, n: pd.Series) -> pd.Series:  # a row per group
        return pd.Series([_incomplete_beta(1 - min(1.0, x * x), (m - 2) / 2, 0.5) if m > 2 and x == x else float("nan") for x, m in zip(r, n)], dtype="float64")

    return value(r.cast("double"), n.cast("long"))


def with_p_value(correlation: DataFrame) -> DataFrame:
    """The result of :func:`pearson_correlation` or :func:`spearman_correlation` with its ``p_value``."""
    name = next(c for c in correlation.columns if c.endswith("_correlation"))
    return correlation.withColumn("p_value", p_value(F.col(name), F.col("n")))


def pearson_correlation(df: DataFrame, true: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """``pearson_correlation`` and ``n``, from which :func:`with_p_value` tells the p-value."""
    return _rows(df, true, pred, by).groupBy(*(by or [])).agg(_pearson("t", "p").alias("pearson_correlation"), F.count("*").alias("n"))


def spearman_correlation(df: DataFrame, true: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Pearson correlation of mean ranks. Ranks come from counts by value, so that equal values are combined first."""
    keys = by or []
    rows = _rows(df, true, pred, by)

    def ranks(c: str) -> DataFrame:
        counts = running(rows.groupBy(*keys, c).agg(F.count("*").alias("m")), [*keys, c], "_before", F.col("m"))
        if keys:
            least = counts.groupBy(*keys).agg(F.min("_before").alias("_least"))
            counts = counts.join(least, keys).withColumn("_before", F.col("_before") - F.col("_least"))
        return counts.select(*keys, c, (F.col("_before") + (F.col("m") + 1) / 2).alias(f"r{c}"))

    ranked = rows.join(ranks("t"), [*keys, "t"]).join(ranks("p"), [*keys, "p"])
    return ranked.groupBy(*keys).agg(_pearson("rt", "rp").alias("spearman_correlation"), F.count("*").alias("n"))


def kullback_leibler_divergence(df: DataFrame, true: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Of the shares of the truth from those of the prediction: sum P ln(P / Q); infinite where Q lacks what P has."""
    both = (F.col("t") > 0) & (F.col("p") > 0)
    lacks = F.max(((F.col("t") > 0) & (F.col("p") == 0)).cast("int")) == 1
    part = F.sum(F.when(both, F.col("t") * F.log(F.col("t") / F.col("p"))))
    value = F.try_divide(part, F.sum("t")) + F.log(F.try_divide(F.sum("p"), F.sum("t")))
    return _agg(df, true, pred, by, "kullback_leibler_divergence", F.when(lacks, F.lit(float("inf"))).otherwise(value))


def max_error(df: DataFrame, true: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """The greatest of truth minus prediction, signed."""
    return _agg(df, true, pred, by, "max_error", F.max(F.col("t") - F.col("p")))
