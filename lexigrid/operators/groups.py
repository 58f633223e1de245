"""Group summaries, value counts and overviews."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.functions.shared import durable
from lexigrid.functions.text import is_empty, natural_key, trim

SUMMARIES = ("join_text", "count_distinct", "distinct_values", "earliest_latest", "first", "last", "sum", "mean", "min", "max", "earliest", "latest")


@dataclass(frozen=True)
class Summary:
    column: str
    kind: str
    separator: str = "\n\n"

    def __post_init__(self) -> None:
        if self.kind not in SUMMARIES:
            raise ValueError(f"unknown summary {self.kind!r}")


def _ordered(values: Column, ordinal: Column) -> Column:
    """Values in row order; the ordinal makes the order, whatever the partitions."""
    pairs = F.array_sort(F.collect_list(F.when(values.isNotNull(), F.struct(ordinal.alias("o"), values.alias("v")))))
    return F.transform(pairs, lambda p: p["v"])


def _summary(s: Summary, ordinal: Column) -> list[Column]:
    c, name = F.col(f"`{s.column}`"), s.column
    match s.kind:
        case "join_text":
            return [F.array_join(_ordered(c.cast("string"), ordinal), s.separator).alias(name)]
        case "count_distinct":
            return [(F.count_distinct(c) + F.max(c.isNull().cast("bigint"))).alias(f"{name}_count_distinct")]
        case "distinct_values":
            return [F.array_join(F.array_distinct(_ordered(c.cast("string"), ordinal)), s.separator).alias(name)]
        case "earliest_latest":
            return [F.min(c).alias(f"{name}_earliest"), F.max(c).alias(f"{name}_latest")]
        case "first":
            return [F.min_by(F.struct(c.alias("v")), ordinal)["v"].alias(f"{name}_first")]
        case "last":
            return [F.max_by(F.struct(c.alias("v")), ordinal)["v"].alias(f"{name}_last")]
        case "sum":
            return [F.coalesce(F.sum(c), F.lit(0)).alias(f"{name}_sum")]
        case "mean":
            return [F.avg(c).alias(f"{name}_mean")]
        case "min" | "earliest":
            return [F.min(c).alias(f"{name}_{s.kind}")]
    return [F.max(c).alias(f"{name}_{s.kind}")]


def group_summary(df: DataFrame, keys: list[str], summaries: list[Summary], ordinal: str) -> DataFrame:
    """One row for each group, null being a group, in order of first appearance.

    rows holds the group's size (row_count if a key is named rows). Sums and
    means take numbers only.
    """
    if not 1 <= len(keys) <= 10:
        raise ValueError("1 to 10 keys")
    for s in summaries:
        if s.kind in ("sum", "mean") and not isinstance(df.schema[s.column].dataType, T.NumericType):
            raise ValueError(f"{s.column!r} is not a number")
    order = F.col(f"`{ordinal}`")
    size = F.count(F.lit(1)).alias("row_count" if "rows" in keys else "rows")
    made = [c for s in summaries for c in _summary(s, order)]
    return df.groupBy(*(f"`{k}`" for k in keys)).agg(size, *made, F.min(order).alias("__first")).orderBy("__first").drop("__first")


def value_counts(df: DataFrame, column: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """The most frequent labels (ties in natural order), and one row of totals.

    totals: empty rows, distinct labels, and rows whose label is not listed.
    """
    c = df[f"`{column}`"]
    labelled = df.where(~is_empty(c, df.schema[column].dataType)).groupBy(c.cast("string").alias("value")).count()
    top = labelled.orderBy(F.desc("count"), natural_key(F.col("value")), "value").limit(limit)
    totals = df.agg(F.count_if(is_empty(c, df.schema[column].dataType)).alias("empty"), F.count("*").alias("n"))
    distinct = labelled.agg(F.count("*").alias("distinct_values"))
    listed = top.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("listed"))
    return top, totals.crossJoin(distinct).crossJoin(listed).select("empty", "distinct_values", (F.col("n") - F.col("empty") - F.col("listed")).alias("unlisted"))


def category_values(df: DataFrame, column: str, most: int = 10_000) -> DataFrame:
    """Labels in natural order with their counts; more than ``most`` of them are refused."""
    found = df.where(df[f"`{column}`"].isNotNull()).groupBy(df[f"`{column}`"].cast("string").alias("value")).count()
    if found.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} values")
    return found.orderBy(natural_key(F.col("value")), "value")


def merge_orders(orders: list[list[str]]) -> list[str]:
    """One order that agrees with all of them; A to Z if they contradict each other."""
    labels = sorted({x for order in orders for x in order})
    before = {x: set() for x in labels}
    for order in orders:
        for a, b in zip(order, order[1:], strict=False):
            before[b].add(a)
    rank = {x: min((o.index(x) for o in orders if x in o), default=0) for x in labels}
    out: list[str] = []
    while len(out) < len(labels):
        ready = [x for x in labels if x not in out and before[x] <= set(out)]
        if not ready:
            return labels
        out.append(min(ready, key=lambda x: (rank[x], x)))
    return out


def distinct_value_columns(df: DataFrame, low: int, high: int) -> DataFrame:
    """Columns with low to high distinct values, nulls aside; one pass over all of them."""
    counts = df.agg(*(F.count_distinct(df[f"`{c}`"]).alias(c) for c in df.columns))
    stacked = counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("distinct_values")) for c in df.columns))).alias("x"))
    return stacked.select("x.*").where(F.col("distinct_values").between(low, high))


def column_examples(df: DataFrame, ordinal: str, most: int = 200) -> DataFrame:
    """Of each column the first value that is not empty, white space collapsed."""
    shown = lambda c: F.substring(trim(F.regexp_replace(df[f"`{c}`"].cast("string"), r"(?U)\s+", " ")), 1, most)
    first = lambda c: F.min_by(shown(c), F.when(~is_empty(df[f"`{c}`"], df.schema[c].dataType), df[f"`{ordinal}`"]))
    row = df.agg(*(first(c).alias(c) for c in df.columns))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("example")) for c in df.columns))).alias("x")).select("x.*")


def corpus_overview(df: DataFrame, text: str) -> DataFrame:
    """Documents, empty and duplicate ones, and lengths in words, or in characters where spaces are rare.

    One pass over the texts works out both lengths and an MD5, by which equal texts
    are told; what is summed up after that are numbers.
    """
    t = df[f"`{text}`"]
    full = ~is_empty(t, T.StringType())
    base = durable(
        df.select(
            full.alias("full"),
            F.when(full, F.regexp_count(t, F.lit(r"(?U)\S+")).cast("bigint")).alias("words"),
            F.when(full, F.length(t).cast("bigint")).alias("characters"),
            F.regexp_count(t, F.lit(r"(?U)\s")).alias("gaps"),
            F.length(t).alias("size"),
            F.when(full, F.md5(t.cast("binary"))).alias("digest"),
        )
    )
    stats = {"total": lambda c: F.coalesce(F.sum(c), F.lit(0)), "shortest": F.min, "median": F.median, "mean": lambda c: F.round(F.avg(c), 6), "longest": F.max}
    sums = base.agg(
        F.count("*").alias("documents"),
        F.count_if(~F.col("full")).alias("empty"),
        F.coalesce(F.try_divide(F.sum("gaps"), F.sum("size")), F.lit(0.0)).alias("spaces"),
        *(stat(F.col(unit)).alias(f"{name}_{unit}") for unit in ("words", "characters") for name, stat in stats.items()),
    )
    different = base.where("full").groupBy("digest").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))
    found = sums.crossJoin(different)  # a row each
    unit = F.when(F.col("spaces") < 0.05, "characters").otherwise("words")
    chosen = (F.when(F.col("spaces") < 0.05, F.col(f"{n}_characters")).otherwise(F.col(f"{n}_words")).alias(n) for n in stats)
    return found.select("documents", "empty", "duplicates", unit.alias("unit"), *chosen)


def emptied_report(before: DataFrame, after: DataFrame, ordinal: str, column: str) -> DataFrame:
    """Rows whose value an edit made empty: how many, the first and its value before."""
    kinds = before.schema[column].dataType, after.schema[column].dataType
    a = before.select(F.col(ordinal).alias("row"), F.col(f"`{column}`").alias("old"))
    b = after.select(F.col(ordinal).alias("row"), F.col(f"`{column}`").alias("new"))
    lost = a.join(b, "row").where(~is_empty(F.col("old"), kinds[0]) & is_empty(F.col("new"), kinds[1]))
    return lost.agg(F.count("*").alias("emptied"), F.min("row").alias("first_row"), F.min_by("old", "row").cast("string").alias("first_value"))


def changed_rows(before: DataFrame, after: DataFrame, ordinal: str, column: str) -> DataFrame:
    """(row, old, new) where an edit changes the value, compared as text, nulls alike."""
    a = before.select(F.col(ordinal).alias("row"), F.col(f"`{column}`").cast("string").alias("old"))
    b = after.select(F.col(ordinal).alias("row"), F.col(f"`{column}`").cast("string").alias("new"))
    return a.join(b, "row").where(~F.col("old").eqNullSafe(F.col("new")))


def split_groups(df: DataFrame, label: Column, most: int = 50) -> DataFrame:
    """Group sizes by label, largest first; more than ``most`` groups are refused."""
    sizes = df.groupBy(label.alias("group")).agg(F.count("*").alias("n"))
    if sizes.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} groups")
    return sizes.orderBy(F.desc("n"), F.asc_nulls_last("group"))


def number_interval(column: Column, origin: float, width: float) -> Column:
    return F.floor((column - origin) / width)


def equal_bins(column: Column, low: float, high: float, bins: int) -> Column:
    """0 to bins - 1; the last bin holds its upper end too."""
    return F.least(F.floor((column - low) / ((high - low) / bins)), F.lit(bins - 1))
