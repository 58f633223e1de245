"""A closed expression tree, compiled to columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.functions.text import unicode_pattern

AGGREGATES = ("sum", "mean", "min", "max", "count", "n_unique")
CASTS = {"string": "string", "integer": "bigint", "float": "double", "boolean": "boolean", "datetime": "timestamp", "date": "date"}


@dataclass(frozen=True)
class Expr:
    """op: column, literal, an operator or function; args: its operands; options: the rest."""

    op: str
    args: tuple[Any, ...] = ()
    options: dict[str, Any] = field(default_factory=dict)


def col(name: str) -> Expr:
    return Expr("column", (name,))


def lit(value: Any) -> Expr:
    return Expr("literal", (value,))


def call(op: str, *args: Any, **options: Any) -> Expr:
    return Expr(op, tuple(a if isinstance(a, Expr) else lit(a) for a in args), options)


def _divide(a: Column, b: Column) -> Column:
    """True division; a zero divisor gives an infinity or NaN."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).when(a.isNotNull(), F.lit(float("nan")))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def _modulo(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign; null for a zero divisor."""
    rest = F.try_mod(a, b)
    return F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)


def _aggregate(op: str, x: Column) -> Column:
    return {
        "sum": lambda: F.coalesce(F.sum(x), F.lit(0)),
        "mean": lambda: F.avg(x),
        "min": lambda: F.min(x),
        "max": lambda: F.max(x),
        "count": lambda: F.count(x),
        "n_unique": lambda: F.count_distinct(x) + F.coalesce(F.max(x.isNull().cast("bigint")), F.lit(0)),
    }[op]()


def compile_expr(df: DataFrame, e: Expr, whole: dict[str, Column] | None = None) -> Column:
    """The column of an expression over df.

    whole: where given, aggregates are those of the whole frame; they are put
    there, and the column refers to them by name. Operations, columns and look-around patterns that are not known are refused.
    """
    if e.op == "column":
        if e.args[0] not in df.columns:
            raise ValueError(f"unknown column {e.args[0]!r}")
        return df[f"`{e.args[0]}`"]
    if e.op == "literal":
        return F.lit(e.args[0])
    if e.op == "is_in":
        values = e.args[1].args[0] if e.args[1].op == "literal" else None
        if not isinstance(values, (list, tuple)):
            raise ValueError("is_in needs a literal list")
        return compile_expr(df, e.args[0], whole).isin(list(values))
    args = [compile_expr(df, a, whole) for a in e.args]
    if e.op in AGGREGATES:
        out = _aggregate(e.op, args[0])
        if whole is None:
            return out
        name = f"__whole_{len(whole)}"
        whole[name] = out.alias(name)
        return F.col(name)
    text = lambda i: args[i].cast("string")
    textual = lambda a: a.op == "column" and isinstance(df.schema[a.args[0]].dataType, T.StringType) or a.op == "literal" and isinstance(a.args[0], str)
    table = {
        "add": lambda: F.concat(*args) if any(map(textual, e.args)) else args[0] + args[1],
        "subtract": lambda: args[0] - args[1],
        "multiply": lambda: args[0] * args[1],
        "divide": lambda: _divide(*args),
        "modulo": lambda: _modulo(*args),
        "eq": lambda: args[0] == args[1],
        "ne": lambda: args[0] != args[1],
        "gt": lambda: args[0] > args[1],
        "gte": lambda: args[0] >= args[1],
        "lt": lambda: args[0] < args[1],
        "lte": lambda: args[0] <= args[1],
        "and": lambda: args[0] & args[1],
        "or": lambda: args[0] | args[1],
        "not": lambda: ~args[0],
        "fill_null": lambda: F.coalesce(*args),
        "is_null": lambda: args[0].isNull(),
        "is_not_null": lambda: args[0].isNotNull(),
        "abs": lambda: F.abs(args[0]),
        "lowercase": lambda: F.lower(args[0]),
        "uppercase": lambda: F.upper(args[0]),
        "year": lambda: F.year(args[0]),
        "month": lambda: F.month(args[0]),
        "day": lambda: F.dayofmonth(args[0]),
        "contains": lambda: F.rlike(text(0), F.lit(unicode_pattern(e.args[1].args[0]))) if e.options.get("regex") else text(0).contains(args[1]),
        "starts_with": lambda: text(0).startswith(args[1]),
        "ends_with": lambda: text(0).endswith(args[1]),
        "cast": lambda: (args[0].cast if e.options.get("strict", True) else args[0].try_cast)(CASTS[e.options["to"]]),
        "round": lambda: F.round(args[0], _decimals(e.options.get("decimals", 0))),
        "concat_string": lambda: F.concat(*[part for i in range(len(args)) for part in ([F.lit(e.options.get("separator", ""))] if i else []) + [text(i)]]),
    }
    if e.op not in table:
        raise ValueError(f"unknown operation {e.op!r}")
    return table[e.op]()


def _decimals(n: int) -> int:
    if not 0 <= n <= 15:
        raise ValueError("decimals from 0 to 15")
    return n


def with_columns(df: DataFrame, new: dict[str, Expr]) -> DataFrame:
    """Whole-frame aggregates are one row, computed once and broadcast to all."""
    whole: dict[str, Column] = {}
    made = {name: compile_expr(df, e, whole) for name, e in new.items()}
    if not whole:
        return df.withColumns(made)
    return df.crossJoin(F.broadcast(df.agg(*whole.values()))).withColumns(made).drop(*whole)


def select(df: DataFrame, chosen: dict[str, Expr]) -> DataFrame:
    return df.select(*(compile_expr(df, e).alias(name) for name, e in chosen.items()))


def sort(df: DataFrame, keys: list[tuple[Expr, bool]]) -> DataFrame:
    """keys: expressions, and whether descending; nulls are last either way."""
    return df.orderBy(*((compile_expr(df, e).desc_nulls_last() if down else compile_expr(df, e).asc_nulls_last()) for e, down in keys))


def group_by_agg(df: DataFrame, keys: dict[str, Expr], aggregates: dict[str, Expr]) -> DataFrame:
    return df.groupBy(*(compile_expr(df, e).alias(n) for n, e in keys.items())).agg(*(compile_expr(df, e).alias(n) for n, e in aggregates.items()))
