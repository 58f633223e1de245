"""Agreement between coders, from grouped label pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) of rows where both have a label."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))


def _distance(a: Column, b: Column, scale: list[str] | None) -> Column:
    """0 for the same label, 1 for another; on a scale the squared difference of places, codes outside it at 1."""
    if scale is None:
        return (a != b).cast("double")
    place = F.array(*map(F.lit, scale))
    i, j = F.array_position(place, a), F.array_position(place, b)
    steps = (i - j).cast("double") / max(1, len(scale) - 1)
    return F.when(a == b, 0.0).when((i > 0) & (j > 0), steps * steps).otherwise(1.0)


def agreement(pairs: DataFrame, scale: list[str] | None = None) -> DataFrame:
    """One row: n, percent, kappa and alpha of a confusion table; weighted by a scale's squared steps if given.

    Undefined values are null. Only label marginals meet each other, which are
    as many as there are codes.
    """
    a = pairs.groupBy(F.col("a").alias("x")).agg(F.sum("n").alias("na"))
    b = pairs.groupBy(F.col("b").alias("y")).agg(F.sum("n").alias("nb"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("x"), "n"), F.struct(F.col("b").alias("x"), "n"))).alias("v")).groupBy("v.x").agg(F.sum("v.n").alias("m"))
    observed = pairs.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"), F.sum(F.col("n") * _distance(F.col("a"), F.col("b"), scale)).alias("d"))
    expected = a.crossJoin(b).agg(F.sum(F.col("na") * F.col("nb") * _distance(F.col("x"), F.col("y"), scale)).alias("e"))
    other = both.select(F.col("x").alias("y"), F.col("m").alias("k"))
    pooled = both.crossJoin(other).agg(F.sum(F.col("m") * F.col("k") * _distance(F.col("x"), F.col("y"), scale)).alias("p"))
    n = F.col("n")
    kappa = F.when(F.col("e") > 0, 1 - (F.col("d") / n) / (F.col("e") / (n * n)))
    alpha = F.when(F.col("p") > 0, 1 - (F.col("d") / n) / (F.col("p") / (2 * n * (2 * n - 1))))
    return observed.crossJoin(expected).crossJoin(pooled).select(n, F.round(F.try_divide(F.col("same") * 100.0, n), 6).alias("percent"), F.round(kappa, 6).alias("kappa"), F.round(alpha, 6).alias("alpha"))


def multi_alpha(df: DataFrame, coders: list[str], scale: list[str] | None = None) -> DataFrame:
    """Krippendorff's alpha over any number of coders; rows with fewer than two labels are left out.

    Rows are first grouped by their combination of labels.
    """
    values = F.array_sort(F.array_compact(F.array(*(F.col(c).cast("string") for c in coders))))
    units = df.select(values.alias("v")).where(F.size("v") > 1).groupBy("v").agg(F.count("*").alias("n"))
    placed = units.select("v", "n", F.posexplode("v").alias("i", "a"))
    pairs = placed.select("a", "i", (F.col("n") / (F.size("v") - 1)).alias("w"), F.posexplode("v").alias("j", "b")).where("i <> j").groupBy("a", "b").agg(F.sum("w").alias("w"))
    margin = units.select(F.explode("v").alias("x"), "n").groupBy("x").agg(F.sum("n").alias("m"))
    other = margin.select(F.col("x").alias("y"), F.col("m").alias("k"))
    observed = pairs.agg(F.sum(F.col("w") * _distance(F.col("a"), F.col("b"), scale)).alias("d"))
    expected = margin.crossJoin(other).agg(F.sum(F.col("m") * F.col("k") * _distance(F.col("x"), F.col("y"), scale)).alias("p"))
    total = margin.agg(F.sum("m").alias("n"))
    alpha = F.when(F.col("p") > 0, 1 - (F.col("n") - 1) * F.col("d") / F.col("p"))
    return observed.crossJoin(expected).crossJoin(total).select(F.col("n").cast("bigint").alias("n_values"), F.round(alpha, 6).alias("alpha"))
