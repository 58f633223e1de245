"""Labels of a codebook: validity, fit, examples, and row filters over compared columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label(column: Column, codebook: list[str]) -> Column:
    """The trimmed text if it is one of the codebook's labels, else null."""
    text = F.trim(column.cast("string"))
    return F.when(text.isin(codebook), text)


def row_filter(df: DataFrame, column: str, others: list[str], show: str) -> DataFrame:
    """show: differs (a present label differs from another present one), present or empty."""
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    if show == "present":
        return df.where(text(column).isNotNull())
    if show == "empty":
        return df.where(text(column).isNull())
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(text(column) != text(o), F.lit(False)) for o in others]))


def codebook_fit(df: DataFrame, column: str, codebook: list[str]) -> DataFrame:
    """Filled rows, those that are no code, and the three most frequent of these (ties by text)."""
    text = F.nullif(F.trim(F.col(column).cast("string")), F.lit(""))
    strange = df.where(text.isNotNull() & ~text.isin(codebook)).groupBy(text.alias("v")).agg(F.count("*").alias("n"))
    top = strange.orderBy(F.desc("n"), "v").limit(3).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "v"))), lambda x: x["v"]), ", ").alias("top_non_codes"))
    filled = df.agg(F.count(text).alias("filled"), F.count_if(text.isNotNull() & ~text.isin(codebook)).alias("non_codes"))
    return filled.crossJoin(top)


def examples(df: DataFrame, column: str, ordinal: str, n: int, pick: str = "first", seed: int = 0) -> DataFrame:
    """n rows of each label: the first, the last, or a seeded sample."""
    order = {"first": [F.asc(ordinal)], "last": [F.desc(ordinal)], "sample": [F.xxhash64(F.lit(seed), ordinal), F.asc(ordinal)]}[pick]
    place = F.row_number().over(Window.partitionBy(column).orderBy(*order))
    return df.where(F.col(column).isNotNull()).withColumn("place", place.cast("bigint")).where(F.col("place") <= n)


def replace_classes(df: DataFrame, classes: DataFrame, ordinal: str, columns: list[str]) -> DataFrame:
    """Codebook rows replaced by position; the other columns stay where they were."""
    rest = df.select(ordinal, *(c for c in df.columns if c != ordinal and c not in columns))
    return classes.select(ordinal, *columns).join(rest, ordinal, "left").select(*(f"`{c}`" for c in df.columns))


def fill_missing(df: DataFrame, column: str, text: str, labels: DataFrame, replace: bool = False) -> DataFrame:
    """Labels of distinct texts (text, label) joined back; where a label exists it stays unless ``replace``."""
    found = labels.select(F.col("text").alias("__t"), F.col("label").alias("__l"))
    joined = df.join(found, df[text] == found["__t"], "left")
    value = F.coalesce("__l", column) if replace else F.coalesce(column, "__l")
    return joined.withColumn(column, value).drop("__t", "__l")
