"""Conversions of whole columns, with a dry run and date detection."""

from __future__ import annotations

import re
from dataclasses import dataclass

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.functions.text import literal

#: Strftime directives and what Spark calls them.
DIRECTIVES = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%p": "a", "%z": "xx", "%:z": "xxx", "%j": "DDD"}
#: What each directive looks like in a text.
_LOOKS = {"%Y": "[0-9]{4}", "%f": "[0-9]{6}", "%p": "(?:AM|PM)", "%z": "[+-][0-9]{4}", "%:z": "[+-][0-9]{2}:[0-9]{2}", "%j": "[0-9]{3}"} | dict.fromkeys(("%m", "%d", "%H", "%I"), "[0-9]{1,2}") | dict.fromkeys(("%b", "%B", "%a", "%A"), r"\p{L}+")


def date_formats() -> list[str]:
    """Dates by a grammar: the order of the parts, what stands between, long or short years and months, a weekday.

    Four-digit years come before two-digit ones, the year first before the day
    first before the month first, and numbers before names; of formats that read
    a column equally often, the earlier is the better guess.
    """
    number = {"ymd": ("%Y", "%m", "%d"), "dmy": ("%d", "%m", "%Y"), "mdy": ("%m", "%d", "%Y")}
    out = [sep.join(parts) for parts in number.values() for sep in "-/._"] + ["%Y%m%d"]
    for month in ("%b", "%B"):
        day_first = [f"%d{sep}{month}{sep}%Y" for sep in (" ", "-")]
        weekday = "%a" if month == "%b" else "%A"
        out += [*day_first, f"{month} %d, %Y", f"{month} %d %Y", *(f"{weekday}{comma} {day_first[0]}" for comma in ("", ","))]
    return out + [f.replace("%Y", "%y") for f in out if not f.startswith("%Y") and "%a" not in f and "%A" not in f]


def clock_formats() -> list[str]:
    """Nothing, or a time after a space or a T, to the minute, second or below, with or without a zone."""
    clocks = [sep + clock for sep in " T" for clock in ("%H:%M", "%H:%M:%S", "%H:%M:%S.%f")] + [" %I:%M %p", " %I:%M:%S %p"]
    return ["", *(clock + zone for clock in clocks for zone in ("", "Z", "%z", "%:z", " %z", " %:z"))]


def candidate_formats() -> list[str]:
    return [d + c for d in date_formats() for c in clock_formats()] + ["%a %b %d %H:%M:%S %z %Y"]


def _directives(strftime: str) -> list[str]:
    """A format in its directives and the single characters between."""
    found = re.findall(r"%:z|%.|[^%]", strftime, re.S)
    for part in found:
        if part[0] == "%" and part not in DIRECTIVES:
            raise ValueError(f"unknown directive {part!r}")
    return found


def shape_pattern(strftime: str) -> str:
    """A pattern of the texts a format may read."""
    found = "".join(_LOOKS.get(p, "[0-9]{2}") if p in DIRECTIVES else literal(p) for p in _directives(strftime))
    return found.replace("{1,2}", "{2}") if re.search("%.%", strftime) else found


def java_pattern(strftime: str) -> str:
    """The pattern Spark reads for a strftime format; other letters are quoted."""
    return "".join(DIRECTIVES.get(p) or (f"'{p}'" if p.isalpha() else p) for p in _directives(strftime))


def reading_pattern(strftime: str) -> str:
    """As java_pattern, but days, months and hours may have one digit, unless parts touch."""
    if re.search("%[^:]%", strftime):
        return java_pattern(strftime)
    short = {"%m": "M", "%d": "d", "%H": "H", "%I": "h"}
    return "".join(short.get(p) or java_pattern(p) for p in _directives(strftime))


def to_string(column: Column, kind: T.DataType, pattern: str | None = None) -> Column:
    if pattern and isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, java_pattern(pattern))
    return column.cast("string")


def integer_from_text(text: Column) -> Column:
    """Digits as written; a decimal part rounds half away from zero; exponents go by way of a float; too large is null."""
    t = F.trim(text)
    shape = r"^([+-]?\d+)(?:\.(\d*))?$"
    whole = F.regexp_extract(t, shape, 1).try_cast("bigint")
    up = F.substring(F.regexp_extract(t, shape, 2), 1, 1) >= "5"
    step = F.when(up & t.startswith("-"), F.lit(-1)).when(up, F.lit(1)).otherwise(F.lit(0))
    return F.when(F.rlike(t, F.lit(shape)), whole + step.cast("bigint")).otherwise(F.round(F.when(F.rlike(t, F.lit(r"^[+-]?[\d.]+[eE][+-]?\d+$")), t.try_cast("double"))).try_cast("bigint"))


def integer_from_float(column: Column) -> Column:
    """Half away from zero; infinities, NaN and what is too large are null."""
    return F.when(~F.isnan(column), F.round(column, 0).try_cast("bigint"))


def float_from_text(text: Column, decimal: str = ".", thousands: str | None = None, strip_symbols: bool = False) -> Column:
    """Groups of three are strict where a thousands mark is named; symbols and spaces around may be dropped."""
    t = F.trim(text)
    if strip_symbols:
        t = F.regexp_replace(t, r"^([+-]?)[^\d.,+-]+|[^\d.,]+$", "$1")
    d = literal(decimal)
    integer = rf"\d{{1,3}}(?:{literal(thousands)}\d{{3}})+|\d+" if thousands else r"\d+"
    fits = F.rlike(t, F.lit(rf"^[+-]?(?:(?:{integer})(?:{d}\d*)?|{d}\d+)(?:[eE][+-]?\d+)?$"))
    plain = F.replace(t, F.lit(thousands), F.lit("")) if thousands else t
    return F.when(fits, F.replace(plain, F.lit(decimal), F.lit(".")).try_cast("double"))


def timestamp_from_text(text: Column, pattern: str | None = None, inside: bool = False) -> Column:
    """By an explicit strftime format, or ISO; zones are converted to UTC, times without one are read as UTC.

    inside: the first part of the text that looks like the format is read, and
    the rest of it ignored.
    """
    t = F.trim(text)
    if pattern is None:
        dated = F.when(F.rlike(t, F.lit(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$")), F.concat(t, F.lit("T00:00:00Z")))
        timed = F.when(F.rlike(t, F.lit(r"[0-9]:[0-9]{1,2}(?::[0-9]{1,2}(?:\.[0-9]+)?)?$")) & ~F.rlike(t, F.lit(r"[+-][0-9]{1,2}:[0-9]{1,2}$")), F.concat(t, F.lit("Z")))
        return F.coalesce(dated, timed, t).try_cast("timestamp")
    if inside:
        t = F.nullif(F.regexp_extract(t, rf"(?<!\p{{N}}){shape_pattern(pattern)}(?!\p{{N}})", 0), F.lit(""))
    if pattern.startswith(("%a", "%A")):  # Spark does not read weekdays
        t, pattern = F.ltrim(F.regexp_replace(t, r"^\p{L}+", "")), pattern[2:].lstrip()
    if {"%z", "%:z"} & set(_directives(pattern)):
        return F.try_to_timestamp(t, F.lit(reading_pattern(pattern)))
    return F.try_to_timestamp(F.concat(t, F.lit(" +0000")), F.lit(reading_pattern(pattern) + " xx"))


def two_digit_year(value: Column, start: int) -> Column:
    """The same day in the hundred years from ``start``."""
    year = F.year(value)
    moved = F.pmod(year - start, F.lit(100)) + start
    return F.add_months(value.cast("date"), ((moved - year) * 12).cast("int"))


def from_unix(column: Column, unit: str) -> Column:
    """Plausible times only: 1900 to 2099; unit is s, ms, us or ns."""
    micros = {"s": column * 1_000_000, "ms": column * 1000, "us": column, "ns": F.floor(column / 1000)}[unit]
    value = F.timestamp_micros(micros.cast("bigint"))
    return F.when(F.year(value).between(1900, 2099), value)


def from_excel(column: Column) -> Column:
    """Day numbers from 1 to 73,050, day 1 being 1900-01-01 as spreadsheets count."""
    micros = F.round((column.cast("double") - 25_569) * 86_400_000).cast("bigint") * 1000
    return F.when(column.between(1, 73_050), F.timestamp_micros(micros))


def to_category(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Text with its label order in the column's metadata; a value outside the order is refused."""
    c = df[f"`{column}`"].cast("string")
    if df.where(c.isNotNull() & ~c.isin(order)).limit(1).count():
        raise ValueError("a value is not in the order")
    return df.withMetadata(column, {"category_order": order})


def category_rank(column: Column, order: list[str]) -> Column:
    """The place of a value in the order, from 1; null for a null and for a value outside it."""
    return F.nullif(F.array_position(F.array(*map(F.lit, order)), column), F.lit(0).cast("bigint"))


@dataclass(frozen=True)
class DateFormat:
    """A strftime format, how many of the sample's values it reads, and the one with day and month swapped, if that reads any."""

    format: str
    reads: int
    swap: str | None = None


def detect_datetime(df: DataFrame, column: str, sample: int = 1000) -> list[DateFormat]:
    """Formats that read values of a sample, the best first; of those that read as many, the earlier candidate.

    The sample is of ``sample`` values at most, those of least hash, so it is the
    same however rows are dealt. Only formats that look like one of the values'
    shapes are tried, all in one pass.
    """
    text = F.trim(df[f"`{column}`"].cast("string"))
    values = df.select(text.alias("v")).where(F.col("v") != "").orderBy(F.xxhash64("v"), "v").limit(sample)
    shape = F.regexp_replace(F.regexp_replace("v", "[0-9]", "0"), r"\p{L}{3,}", "xxx")
    shapes = [r.shape for r in values.select(shape.alias("shape")).distinct().collect()]
    formats = [f for f in candidate_formats() if any(regex.fullmatch(shape_pattern(f), s) for s in shapes)]
    if not formats:
        return []
    counted = values.agg(*(F.count(timestamp_from_text(F.col("v"), f)).alias(str(i)) for i, f in enumerate(formats))).first()
    reads = {f: counted[str(i)] for i, f in enumerate(formats) if counted[str(i)]}
    pairs = [(f"%d{sep}%m", f"%m{sep}%d") for sep in "-/._"]
    turned = {f: b + f[len(a) :] for f in reads for pair in pairs for a, b in (pair, pair[::-1]) if f.startswith(a)}
    swap = lambda f: turned[f] if turned.get(f) in reads else None
    return [DateFormat(f, n, swap(f)) for f, n in sorted(reads.items(), key=lambda x: -x[1])]


def check_cast(df: DataFrame, column: str, converted: Column, examples: int = 5) -> DataFrame:
    """How many values are present, convert and fail, and the least failures."""
    c = df[f"`{column}`"]
    fails = c.isNotNull() & converted.isNull()
    return df.agg(F.count(c).alias("present"), F.count(converted).alias("converted"), F.count_if(fails).alias("failed"), F.slice(F.array_sort(F.collect_set(F.when(fails, F.substring(c.cast("string"), 1, 200)))), 1, examples).alias("failures"))
