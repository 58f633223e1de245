"""Elapsed times: bigint microseconds, read and written as people type them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000
UNITS = {"ms": 1000, "s": SECOND, "min": MINUTE, "h": HOUR, "d": DAY}
_SHAPE = r"^\s*(-?)(?:(\d+):)?(\d+):(\d{1,2})(?:[.,](\d+))?\s*$"


def parse(text: str) -> int:
    """Microseconds of ``7:58``, ``1:23:20`` or ``0:00.5``; two parts are minutes and seconds."""
    found = re.match(_SHAPE, str(text))
    if not found or int(found[4]) > 59 or (found[2] and int(found[3]) > 59):
        raise ValueError(f"not an elapsed time: {text!r}")
    sign, hours, minutes, seconds, part = found.groups()
    total = int(hours or 0) * HOUR + int(minutes) * MINUTE + int(seconds) * SECOND + int(((part or "") + "000000")[:6])
    return -total if sign else total


def from_text(text: Column, two_parts: str = "m:s") -> Column:
    """The same for a column; what does not read as a time is null. two_parts: m:s or h:m."""
    part = lambda i: F.regexp_extract(text, _SHAPE, i)
    number = lambda i: F.coalesce(part(i).try_cast("bigint"), F.lit(0))
    fraction = F.coalesce(F.rpad(F.substring(part(5), 1, 6), 6, "0").try_cast("bigint"), F.lit(0))
    clock = number(2) * HOUR + number(3) * MINUTE + number(4) * SECOND + fraction
    if two_parts == "h:m":
        clock = F.when(part(2) == "", number(3) * HOUR + number(4) * MINUTE).otherwise(clock)
    fits = F.rlike(text, F.lit(_SHAPE)) & (number(4) <= 59) & ((part(2) == "") | (number(3) <= 59))
    return F.when(fits, F.when(part(1) == "-", -clock).otherwise(clock))


def from_number(value: Column, unit: str) -> Column:
    """Microseconds of a number of ms, s, min, h or d; days are rounded to milliseconds."""
    micros = value.cast("double") * UNITS[unit]
    return (F.round(micros / 1000) * 1000 if unit == "d" else F.round(micros)).cast("bigint")


def to_number(micros: Column, unit: str) -> Column:
    return micros / F.lit(float(UNITS[unit]))


def from_timestamp(value: Column) -> Column:
    """The time of day."""
    return (F.unix_micros(value.cast("timestamp")) - F.unix_micros(F.date_trunc("day", value.cast("timestamp")))).cast("bigint")


def to_text(micros: Column, style: str = "auto") -> Column:
    """auto: ``7:58.5`` or ``1:23:20``; or h:mm:ss, h:mm:ss.fff, mm:ss, mm:ss.fff."""
    size = F.abs(micros)
    hours, minutes, seconds = F.floor(size / HOUR), F.floor(size / MINUTE), F.floor(size / SECOND) % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    thousandths = F.concat(F.lit("."), F.lpad((F.floor(size / 1000) % 1000).cast("string"), 3, "0"))
    tail = F.regexp_replace(F.lpad((size % SECOND).cast("string"), 6, "0"), "0+$", "")
    rest = F.when(tail == "", F.lit("")).otherwise(F.concat(F.lit("."), tail))
    long = F.concat(hours.cast("string"), F.lit(":"), two(minutes % 60), F.lit(":"), two(seconds))
    short = F.concat(two(minutes), F.lit(":"), two(seconds))
    plain = F.concat(minutes.cast("string"), F.lit(":"), two(seconds))
    text = {
        "auto": F.concat(F.when(hours > 0, long).otherwise(plain), rest),
        "h:mm:ss": long,
        "h:mm:ss.fff": F.concat(long, thousandths),
        "mm:ss": short,
        "mm:ss.fff": F.concat(short, thousandths),
    }[style]
    return F.concat(F.when(micros < 0, F.lit("-")).otherwise(F.lit("")), text)
