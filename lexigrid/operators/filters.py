"""Row filters: conditions folded left to right, with the empty rule and whole-day bounds."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.functions import elapsed
from lexigrid.functions.text import is_empty, literal, unicode_pattern

OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "contains", "starts_with", "ends_with", "is_null", "is_not_null", "between")


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str
    value: Any = None
    negate: bool = False
    regex: bool = False
    case_sensitive: bool = False
    elapsed: bool = False
    topic_id: int | None = None

    def __post_init__(self) -> None:
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown operator {self.operator!r}")


def _typed(value: Any, kind: T.DataType) -> Any:
    """The literal in the column's type; text columns compare as text."""
    if value is None or isinstance(kind, (T.ArrayType,)):
        return value
    if isinstance(kind, T.StringType):
        return str(value)
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else str(value).strip().lower() in ("true", "1", "yes")
    if isinstance(kind, T.IntegralType):
        number = float(value)
        return int(number) if number.is_integer() else number
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return float(value)
    return value


def _day(value: Any) -> dt.date | None:
    """The calendar day, if the literal names a whole day."""
    if isinstance(value, dt.datetime):
        return None
    if isinstance(value, dt.date):
        return value
    try:
        return dt.date.fromisoformat(str(value)) if len(str(value)) == 10 else None
    except ValueError:
        return None


def _temporal(value: Any, kind: T.DataType) -> Column:
    text = value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else str(value)
    return F.lit(text).cast(kind)


def _at_most(column: Column, kind: T.DataType, value: Any) -> Column:
    """``<=``; a calendar day bounds a timestamp by its last instant."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) and (day := _day(value)):
        return column < _temporal(day + dt.timedelta(days=1), kind)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return column <= _temporal(value, kind)
    return column <= F.lit(_typed(value, kind))


def _literal(value: Any, kind: T.DataType, as_elapsed: bool) -> Column:
    if as_elapsed:
        return F.lit(elapsed.parse(value))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return _temporal(value, kind)
    return F.lit(_typed(value, kind))


def condition(df: DataFrame, c: Condition) -> Column:
    """One condition with SQL's three-valued logic; unknown columns are refused."""
    if c.column not in df.columns:
        raise ValueError(f"unknown column {c.column!r}")
    column, kind = df[f"`{c.column}`"], df.schema[c.column].dataType
    if c.topic_id is not None:
        topic = c.topic_id
        column = F.aggregate(F.filter(column, lambda t: t["topic_id"] == topic), F.lit(0.0), lambda a, t: a + t["coverage"])
        kind = T.DoubleType()
    lit = lambda v: _literal(v, kind, c.elapsed)
    match c.operator:
        case "eq" | "ne" | "gt" | "gte" | "lt":
            out = {"eq": Column.__eq__, "ne": Column.__ne__, "gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__}[c.operator](column, lit(c.value))
        case "lte":
            out = column <= lit(c.value) if c.elapsed else _at_most(column, kind, c.value)
        case "in":
            values = [v for v in c.value if v is not None]
            if isinstance(kind, T.ArrayType):
                out = F.coalesce(F.arrays_overlap(column, F.array(*map(F.lit, values))), F.lit(False)) if values else F.lit(False)
            else:
                out = F.coalesce(column.isin([_typed(v, kind) for v in values]), F.lit(False)) if values else F.lit(False)
            if None in c.value:
                out = out | column.isNull()
        case "contains":
            if c.regex:
                out = F.rlike(column, F.lit(unicode_pattern(c.value, not c.case_sensitive)))
            elif c.case_sensitive:
                out = column.contains(c.value)
            else:
                out = F.rlike(column, F.lit("(?iu)" + literal(c.value)))
        case "starts_with":
            out = column.startswith(c.value)
        case "ends_with":
            out = column.endswith(c.value)
        case "is_null":
            out = is_empty(column, kind)
        case "is_not_null":
            out = ~is_empty(column, kind)
        case "between":
            low, high = c.value
            if low is None and high is None:
                raise ValueError("between needs a bound")
            sides = [column >= lit(low)] if low is not None else []
            sides += [column <= lit(high) if c.elapsed else _at_most(column, kind, high)] if high is not None else []
            out = reduce(lambda a, b: a & b, sides)
    return ~out if c.negate else out


def filter_rows(df: DataFrame, conditions: list[Condition], logic: str = "and") -> DataFrame:
    """Rows for which the conditions, joined left to right by one logic, are true."""
    if logic not in ("and", "or") or not conditions:
        raise ValueError("one or more conditions, joined by 'and' or 'or'")
    join = (lambda a, b: a & b) if logic == "and" else (lambda a, b: a | b)
    return df.where(reduce(join, [condition(df, c) for c in conditions]))
