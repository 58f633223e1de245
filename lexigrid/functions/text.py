"""Column expressions for text: the empty rule, trimming, matches with their places."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

def trim(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_empty(column: Column, kind: T.DataType) -> Column:
    """Null, NaN, or text that is blank."""
    if isinstance(kind, T.StringType):
        return column.isNull() | (trim(column) == "")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def emptied_to_null(column: Column, kind: T.DataType) -> Column:
    return F.when(~is_empty(column, kind), column)


def literal(text: str) -> str:
    """A pattern for the text itself."""
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", text)


def unicode_pattern(pattern: str, ignore_case: bool = False) -> str:
    """Words, digits and edges by Unicode; look-around and back-references are refused."""
    if re.search(r"\(\?<?[=!]|\\[1-9]|\\k<", pattern):
        raise ValueError("look-around and back-references are not supported")
    return ("(?Ui)" if ignore_case else "(?U)") + pattern


#: Bytes of text that are Python objects at once: those of its words take some hundred times as much.
PIECE = 1 << 18


def pieces(texts: pa.Array, budget: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold ``budget`` bytes of text (PIECE by default), or one row of more."""
    budget = budget or PIECE
    start, held = 0, 0
    for i, size in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if held and held + size > budget:
            yield start, i
            start, held = i, 0
        held += size + 1
    if start < len(texts):
        yield start, len(texts)


def by_pieces(find: Callable[..., pa.Array], texts: pa.Array, *others: pa.Array) -> pa.Array:
    """find of all rows, worked out a piece at a time, so that its objects grow with the piece and not with the batch."""
    return pa.concat_arrays([find(*(c[a:b] for c in (texts, *others))) for a, b in pieces(texts)] or [find(texts, *others)])


MATCHES = "array<struct<value: string, start: int, end: int>>"


def matches(text: Column, pattern: str) -> Column:
    """Array of (value, start, end) of all matches that are not empty, in code points, end exclusive.

    Worked out in Arrow batches, once for each row and in time linear in the
    text. A null text has a null array.
    """
    body = re.sub(r"^\(\?U\)", "", pattern)

    def some(texts: pa.Array) -> pa.Array:
        compiled = regex.compile(body)
        values, spans, ends = [], [], [0]
        for t in texts.to_pylist():
            here = [(a, b) for a, b in (m.span() for m in compiled.finditer(t or "")) if a < b]
            values += [t[a:b] for a, b in here]
            spans += here
            ends.append(len(spans))
        places = np.array(spans, dtype=np.int32).reshape(-1, 2)
        rows = pa.StructArray.from_arrays([pa.array(values, pa.string()), pa.array(places[:, 0]), pa.array(places[:, 1])], fields=list(_ARROW_MATCHES.value_type))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows, _ARROW_MATCHES, mask=texts.is_null())

    def find(texts: pa.Array) -> pa.Array:
        return by_pieces(some, texts)

    return F.arrow_udf(find, MATCHES).asNondeterministic()(text)


_ARROW_MATCHES = pa.list_(pa.struct([("value", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def gaps_and_matches(text: Column, pattern: str) -> Column:
    """What lies between the matches and the matches in turn; joined, they are the text again."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.flatten(F.zip_with(F.split(text, pattern, -1), found, lambda gap, match: F.array_compact(F.array(gap, match))))


def natural_key(label: Column) -> Column:
    """Sorts as people do: case folded, digit runs as numbers of up to 30 digits."""
    padded = F.regexp_replace(F.lower(label), r"([0-9]+)", "000000000000000000000000000000$1")
    return F.regexp_replace(padded, r"0*([0-9]{30})(?![0-9])", "$1")
