"""Counts over an axis: time, elapsed time, numbers, or a category."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.functions.shared import durable
from lexigrid.operators.order import numbered

UNITS = {"second": "second", "minute": "minute", "hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter", "yearly": "year"}
SECONDS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86_400, "weeks": 604_800}


def period(axis: Column, unit: str) -> Column:
    """The start of the axis value's period; weeks start on Monday."""
    return F.date_trunc(UNITS[unit], axis)


def custom_period(axis: Column, every: int, unit: str) -> Column:
    """Every N seconds to weeks, counted from 1970, weeks from its first Monday."""
    size = every * SECONDS[unit]
    shift = 4 * 86_400 if unit == "weeks" else 0
    seconds = F.unix_seconds(axis.cast("timestamp"))
    return F.timestamp_seconds(F.floor((seconds - shift) / size) * size + shift)


def label(start: Column, unit: str) -> Column:
    monday_week = F.floor((F.dayofyear(start) + 6 - F.weekday(start)) / 7)
    pattern = {"second": "yyyy-MM-dd HH:mm:ss", "minute": "yyyy-MM-dd HH:mm", "hourly": "yyyy-MM-dd HH:mm", "daily": "yyyy-MM-dd", "monthly": "yyyy-MM", "yearly": "yyyy"}
    if unit == "weekly":
        return F.concat(F.date_format(start, "yyyy"), F.lit("-W"), F.lpad(monday_week.cast("string"), 2, "0"))
    if unit == "quarterly":
        return F.concat(F.date_format(start, "yyyy"), F.lit("-Q"), F.quarter(start).cast("string"))
    return F.date_format(start, pattern[unit])


def elapsed_period(micros: Column, step_seconds: float) -> Column:
    step = int(step_seconds * 1_000_000)
    return F.floor(micros / step) * step / F.lit(1_000_000.0)


def numeric_bin(value: Column, width: str, origin: str = "0") -> Column:
    """Number of the half-open bin; edges are decided on the decimals as written. NaN and infinities are null."""
    decimal = value.cast("string").try_cast("decimal(38,18)")
    return F.floor((decimal - F.lit(origin).cast("decimal(38,18)")) / F.lit(width).cast("decimal(18,9)")).cast("bigint")


def numeric_label(number: Column, width: str, origin: str = "0") -> Column:
    edge = lambda n: F.lit(origin).cast("decimal(28,9)") + n.cast("decimal(18,0)") * F.lit(width).cast("decimal(18,9)")
    short = lambda d: F.regexp_replace(F.regexp_replace(d.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.concat(F.lit("["), short(edge(number)), F.lit(", "), short(edge(number + 1)), F.lit(")"))


def category(column: Column) -> Column:
    """Values, empties as one last position."""
    return F.coalesce(F.nullif(F.trim(column.cast("string")), F.lit("")), F.lit("(empty)"))


def counts(df: DataFrame, axis: Column, at: Column, groups: list[str]) -> DataFrame:
    """(period, groups..., sequential_count, period_start, period_end, period_index, group_index).

    Rows without a period are dropped; null groups count, last. Indices are
    dense, from 0; they are found over distinct periods and groups only.
    """
    if len(groups) > 3:
        raise ValueError("3 groups at most")
    rows = df.select(at.alias("period"), axis.alias("__axis"), *(f"`{g}`" for g in groups)).where("period is not null")
    # the counts are used three times, the rows once
    grouped = durable(rows.groupBy("period", *groups).agg(F.count("*").alias("sequential_count"), F.min("__axis").alias("period_start"), F.max("__axis").alias("period_end")))
    out = grouped
    for keys, name in ((["period"], "period_index"), (groups, "group_index")):
        if not keys:
            out = out.withColumn(name, F.lit(0).cast("bigint"))
            continue
        places = numbered(grouped.select(*keys).distinct(), [F.asc_nulls_last(k) for k in keys], name).withColumnsRenamed({k: f"__{k}" for k in keys})
        out = out.join(places, reduce(lambda a, b: a & b, (out[k].eqNullSafe(places[f"__{k}"]) for k in keys))).drop(*(f"__{k}" for k in keys))
    return out


def publication(df: DataFrame, at: Column, groups: list[str], counted: DataFrame) -> DataFrame:
    """Source rows with the indices of their period and group."""
    keys = counted.select(F.col("period").alias("__p"), *(F.col(g).alias(f"__{g}") for g in groups), "period_index", "group_index")
    rows = df.withColumn("__period", at)
    on = rows["__period"] == keys["__p"]
    for g in groups:
        on = on & rows[g].eqNullSafe(keys[f"__{g}"])
    return rows.join(keys, on).select(*(f"`{c}`" for c in df.columns), "period_index", "group_index")


def with_reference(counted: DataFrame, reference: DataFrame, shared: list[str], most_cells: int = 2_000_000) -> DataFrame:
    """Every cell of period and group, with the reference's rows and words; what is missing is 0.

    reference: period, the shared group columns, reference_rows, reference_words.
    """
    groups = [c for c in counted.columns if c not in ("period", "sequential_count", "period_start", "period_end", "period_index", "group_index")]
    periods = counted.select("period").union(reference.select("period")).distinct()
    kinds = counted.select(*groups).distinct()
    if periods.count() * kinds.count() > most_cells:
        raise ValueError(f"more than {most_cells} cells")
    cells = periods.crossJoin(kinds)  # both sides are distinct keys, and their product was just checked
    meet = lambda a, b, keys: [a[k].eqNullSafe(b[k]) for k in keys]
    own = counted.select("period", *groups, "sequential_count")
    joined = cells.join(own, meet(cells, own, ["period", *groups]), "left").select(cells["period"], *(cells[g] for g in groups), F.coalesce("sequential_count", F.lit(0)).alias("sequential_count"))
    out = joined.join(reference, meet(joined, reference, ["period", *shared]), "left")
    return out.select(joined["period"], *(joined[g] for g in groups), "sequential_count", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("reference_rows", "reference_words")))


def scales(cells: DataFrame, least_rows: int = 10) -> DataFrame:
    """Composition within the period, per million words, and share of rows; small references are null."""
    total = F.sum("sequential_count").over(Window.partitionBy("period"))
    enough = F.col("reference_rows") >= least_rows
    return cells.withColumns(
        {
            "composition": F.round(F.try_divide(F.col("sequential_count") * 100.0, total), 6),
            "per_million": F.round(F.when(enough, F.try_divide(F.col("sequential_count") * 1e6, F.col("reference_words"))), 6),
            "percent_rows": F.round(F.when(enough, F.try_divide(F.col("sequential_count") * 100.0, F.col("reference_rows"))), 6),
        }
    )
