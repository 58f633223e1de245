"""Slices, samples, stacks, joins and duplicates, with row order as part of the result.

A block's order is a column (its ordinal), never the order of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.operators.groups import merge_orders
from lexigrid.operators.order import numbered

JOINS = ("inner", "left", "right", "full", "semi", "anti", "cross")


def slice_rows(df: DataFrame, ordinal: str, offset: int = 0, length: int | None = None) -> DataFrame:
    """Rows by their place in the order, from ``offset`` on; at most ``length`` of them."""
    last = F.lit(True) if length is None else F.col("__place") < offset + length
    chosen = numbered(df.select(ordinal), [F.col(ordinal)], "__place").where((F.col("__place") >= offset) & last)
    return df.join(chosen.select(ordinal), ordinal, "left_semi").orderBy(ordinal)


def _dealt(ordinal: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(ordinal))


def sample(df: DataFrame, ordinal: str, size: float, seed: int) -> DataFrame:
    """Exactly floor(size * rows) rows if size < 1, else that whole number of rows."""
    if size <= 0 or size >= 1 and size != int(size):
        raise ValueError("a fraction below 1, or a whole number")
    n = int(size) if size >= 1 else int(df.count() * size)
    dealt = [_dealt(ordinal, seed), F.col(ordinal)]
    chosen = numbered(df.select(ordinal), dealt, "__place").where(F.col("__place") < n)
    return df.join(chosen.select(ordinal), ordinal, "left_semi").orderBy(*dealt)


def shuffle(df: DataFrame, ordinal: str, seed: int) -> DataFrame:
    """All rows in an order fixed by the seed."""
    return df.orderBy(_dealt(ordinal, seed), ordinal)


def stack(blocks: list[DataFrame]) -> DataFrame:
    """Rows of all blocks in the first one's column order; names and types must be the same.

    The orders of a category's labels are merged into one.
    """
    first = blocks[0]
    for other in blocks[1:]:
        if dict(first.dtypes) != dict(other.dtypes):
            raise ValueError("blocks differ in columns or types")
    out = first
    for other in blocks[1:]:
        out = out.unionByName(other)
    for name in first.columns:
        orders = [o for b in blocks if (o := b.schema[name].metadata.get("category_order"))]
        if orders:
            out = out.withMetadata(name, {"category_order": merge_orders(orders)})
    return out


def drop_exact_duplicates(df: DataFrame, ordinal: str | None = None) -> DataFrame:
    """One row of each; of rows that differ in the ordinal only, the first."""
    if ordinal is None:
        return df.distinct()
    keys = [c for c in df.columns if c != ordinal]
    return df.groupBy(*(df[f"`{c}`"] for c in keys)).agg(F.min(ordinal).alias(ordinal)).select(*(f"`{c}`" for c in df.columns))


def join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, how: str, right_name: str = "right") -> DataFrame:
    """An equi-join on one pair of keys of the same type; null keys meet nothing.

    Right columns whose names are taken get the suffix ``_<right name>``. inner
    and left drop the right key, right drops the left key, full keeps both; semi
    and anti have the left columns. The planner chooses how to run it.
    """
    if how not in JOINS:
        raise ValueError(f"unknown join {how!r}")
    a, b = left.alias("a"), right.alias("b")
    if how != "cross" and left.schema[left_on].dataType != right.schema[right_on].dataType:
        raise ValueError("keys differ in type")
    on = F.col(f"a.`{left_on}`") == F.col(f"b.`{right_on}`")
    if how in ("semi", "anti"):
        return a.join(b, on, f"left_{how}").select(*(f"a.`{c}`" for c in left.columns))
    left_columns = [c for c in left.columns if how != "right" or c != left_on]
    right_columns = [c for c in right.columns if how not in ("inner", "left") or c != right_on]
    chosen = [F.col(f"a.`{c}`") for c in left_columns]
    chosen += [F.col(f"b.`{c}`").alias(f"{c}_{right_name}" if c in left_columns else c) for c in right_columns]
    joined = a.crossJoin(b) if how == "cross" else a.join(b, on, how)
    return joined.select(*chosen)


def order_join(joined: DataFrame, left_ordinal: str, right_ordinal: str | None, how: str) -> DataFrame:
    """Left order then right order, empty last; the other way round for a right join."""
    first, second = (right_ordinal, left_ordinal) if how == "right" else (left_ordinal, right_ordinal)
    return joined.orderBy(*(F.col(c).asc_nulls_last() for c in (first, second) if c))


def near_key(text: Column, ignore_links_mentions: bool = False) -> Column:
    """Lower case, without punctuation and symbols, white space collapsed; optionally without links, mentions and a leading ``rt``."""
    out = F.lower(text)
    if ignore_links_mentions:
        out = F.regexp_replace(out, r"https?://\S+|www\.\S+|@[\p{L}\p{N}_]+", " ")
        out = F.regexp_replace(out, r"^\s*rt\b", " ")
    out = F.regexp_replace(out, r"[\p{P}\p{S}]", "")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def _digest(keys: list[Column]) -> Column:
    """Stands for the keys, nulls told apart from texts, in 16 bytes."""
    return F.unhex(F.md5(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).cast("binary")))


def dedup_keep_first(df: DataFrame, ordinal: str, keys: list[Column]) -> DataFrame:
    """The first row of each key, nulls being alike.

    The least ordinal of each key is a partial aggregate, which meets the rows
    by ordinal, so a key with very many rows is no group in one task.
    """
    named = df.select(ordinal, _digest(keys).alias("__key"))
    firsts = named.groupBy("__key").agg(F.min(ordinal).alias(ordinal)).select(ordinal)
    return df.join(firsts, ordinal, "left_semi")


def duplicate_groups(df: DataFrame, ordinal: str, keys: list[Column]) -> DataFrame:
    """Rows of groups larger than one, with duplicate_group (by first appearance) and kept."""
    named = df.select("*", _digest(keys).alias("__key"))
    groups = named.groupBy("__key").agg(F.count("*").alias("n"), F.min(ordinal).alias("__first")).where("n > 1").drop("n")
    # a group's first ordinal is its own, so it names the group
    places = numbered(groups.select("__first"), [F.col("__first")], "__place").select("__first", (F.col("__place") + 1).alias("duplicate_group"))
    placed = groups.join(places, "__first")
    joined = named.join(placed, "__key").drop("__key")
    return joined.withColumn("kept", F.col(ordinal) == F.col("__first")).drop("__first").orderBy("duplicate_group", ordinal)
