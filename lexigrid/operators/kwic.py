"""Concordance: keywords in context, their density, and projections of the nested result."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.functions.shared import durable, written
from lexigrid.functions.text import by_pieces, is_empty, literal, unicode_pattern
from lexigrid.operators.order import numbered

#: Scripts written without spaces have no word edges.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsMyanmar}\p{IsKhmer}"
BINS = (4, 5, 10, 20, 25, 50, 100)


def _unspaced(c: str) -> bool:
    ranges = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x20000, 0x2FFFF))
    return any(a <= ord(c) <= b for a, b in ranges)


def search_pattern(search: str, regex: bool = False, whole_word: bool = False, case_sensitive: bool = False) -> str:
    """The pattern of a search; a literal's word edge is ``\\b`` at a word character and ``\\B`` at punctuation."""
    body = search if regex else literal(search)
    if whole_word:
        if regex:
            body = rf"\b(?:{body})\b"
        else:
            edge = lambda c: "" if _unspaced(c) else r"\b" if c.isalnum() or c == "_" else r"\B"
            body = edge(search[0]) + body + edge(search[-1])
    return unicode_pattern(body, ignore_case=not case_sensitive)


#: What the analysis adds to a hit; a flat row has the same names with a prefix.
PREFIX = "CONC_"
GENERATED = tuple(PREFIX + c for c in ("left_context", "matched_text", "right_context", "start_idx", "end_idx", "l1", "r1", "l1_freq", "r1_freq", "extraction"))
_PLACES = [("matched_text", pa.string()), ("start_idx", pa.int64()), ("end_idx", pa.int64())]
_HIT = [("left_context", pa.string()), _PLACES[0], ("right_context", pa.string()), *_PLACES[1:], ("l1", pa.string()), ("r1", pa.string()), ("extraction", pa.string())]


def _array_of(fields: list) -> str:
    return "array<struct<" + ", ".join(f"{n}: {'string' if t == pa.string() else 'bigint'}" for n, t in fields) + ">>"


class Contexts:
    """What lies beside places of one text, so many tokens far, from one list of its tokens."""

    def __init__(self, text: str, ignore_punctuation: bool):
        self.text = text
        self.spans = [m.span() for m in regex.finditer(r"\w+" if ignore_punctuation else r"\w+|[\p{P}\p{S}]", text)]
        self.starts, self.ends = [a for a, _ in self.spans], [b for _, b in self.spans]
        self.any_gap = ignore_punctuation

    def left(self, at: int, tokens: int) -> tuple[str, str]:
        """The context before a place, and the word nearest to it."""
        last = bisect_left(self.starts, at) - 1
        first, edge = last + 1, at
        while first > 0 and last + 1 - first < tokens and self._meets(min(self.ends[first - 1], edge), edge):
            first -= 1
            edge = self.starts[first]
        return self.text[edge:at], self._word(range(last, first - 1, -1), at, True)

    def right(self, at: int, tokens: int) -> tuple[str, str]:
        first = bisect_right(self.ends, at)
        last, edge = first, at
        while last < len(self.spans) and last - first < tokens and self._meets(edge, max(self.starts[last], edge)):
            edge = self.ends[last]
            last += 1
        return self.text[at:edge], self._word(range(first, last), at, False)

    def _meets(self, a: int, b: int) -> bool:
        return self.any_gap or a == b or self.text[a:b].isspace()

    def _word(self, tokens: range, at: int, left: bool) -> str:
        for i in tokens:
            a, b = self.spans[i]
            word = self.text[a : min(b, at)] if left else self.text[max(a, at) : b]
            if regex.match(r"\w", word):
                return word
        return ""


def concordance(
    df: DataFrame, text: str, search: str, left: int = 10, right: int = 10, regex: bool = False, whole_word: bool = False, case_sensitive: bool = False, ignore_punctuation: bool = True, contexts: bool = True
) -> DataFrame:
    """df with hits: (left_context, matched_text, right_context, start_idx, end_idx, l1, r1, extraction).

    Rows without a hit, blank ones too, are dropped. Contexts are slices of the
    text as it is; l1 and r1 are the nearest words, empty at the text's ends.
    Without ``contexts`` hits have matched_text, start_idx and end_idx alone,
    which is what density and filters by place need.
    """
    t = F.col(text)
    pattern = search_pattern(search, regex, whole_word, case_sensitive)
    body = pattern[pattern.index(")") + 1 :]
    fields = _HIT if contexts else _PLACES
    shape = pa.list_(pa.struct(fields))

    def some(texts: pa.Array) -> pa.Array:
        compiled = compile_pattern(body, case_sensitive)
        out = []
        for value in texts.to_pylist():
            found = [(m[0], m.start(), m.end()) for m in compiled.finditer(value or "") if m[0]]
            beside = Contexts(value, ignore_punctuation) if found and contexts else None
            rows = []
            for word, start, end in found:
                hit = {"matched_text": word, "start_idx": start, "end_idx": end}
                if beside:
                    (a, l1), (b, r1) = beside.left(start, left), beside.right(end, right)
                    hit |= {"left_context": a, "right_context": b, "l1": l1, "r1": r1, "extraction": a + word + b}
                rows.append(hit)
            out.append(rows)
        return pa.array(out, shape)

    def find(texts: pa.Array) -> pa.Array:
        return by_pieces(some, texts)

    found = df.where(~is_empty(t, T.StringType()) & F.rlike(t, F.lit(pattern)))
    return found.withColumn("hits", F.arrow_udf(find, _array_of(fields)).asNondeterministic()(t)).where(F.size("hits") > 0)


def compile_pattern(body: str, case_sensitive: bool):
    return regex.compile(body, 0 if case_sensitive else regex.IGNORECASE)


def concordance_tokens(df: DataFrame, text: str, tokens: str, search: str, left: int = 10, right: int = 10) -> DataFrame:
    """df with hits by exact token, any of the alternatives; case folded; contexts counted in tokens.

    tokens: an array column of (token, start, end).
    """
    wanted = {w.lower() for w in search.replace(",", " ").replace("|", " ").split()}
    if not wanted:
        raise ValueError("no token to look for")
    fields = [f for f in _HIT if f[0] != "extraction"]
    shape = pa.list_(pa.struct(fields))

    def some(texts: pa.Array, listed: pa.Array) -> pa.Array:
        token, start, end = listed.flatten().flatten()
        coded = token.fill_null("").dictionary_encode()
        found = np.array([w.lower() in wanted for w in coded.dictionary.to_pylist()], dtype=bool)[coded.indices.to_numpy()]
        bounds = np.append(0, np.cumsum(listed.value_lengths().fill_null(0).to_numpy())).tolist()
        out = []
        for value, a, b in zip(texts.to_pylist(), bounds, bounds[1:], strict=False):
            rows = []
            for i in (a + np.flatnonzero(found[a:b])).tolist() if value is not None else ():
                at, to = start[i].as_py(), end[i].as_py()
                first, last = start[max(a, i - left)].as_py(), end[min(b - 1, i + right)].as_py()
                rows.append(
                    {
                        "left_context": value[first:at], "matched_text": value[at:to], "right_context": value[to:last],
                        "start_idx": at, "end_idx": to, "l1": token[i - 1].as_py() if i > a else "", "r1": token[i + 1].as_py() if i + 1 < b else "",
                    }
                )
            out.append(rows)
        return pa.array(out, shape)

    def find(texts: pa.Array, listed: pa.Array) -> pa.Array:
        return by_pieces(some, texts, listed)

    return df.withColumn("hits", F.arrow_udf(find, _array_of(fields)).asNondeterministic()(F.col(text), F.col(tokens))).where(F.size("hits") > 0)


def run(df: DataFrame, text: str, ordinal: str, search: str, left: int = 10, right: int = 10, case_sensitive: bool = False, **options) -> DataFrame:
    """The whole result, a row for each document with hits, in the order of the ordinal.

    Earlier results' columns are dropped, see ``rerun``. concordance: the hits in
    the order of their places, fields named as GENERATED; l1_freq and r1_freq
    count the hits that share the neighbour, by lower case unless
    ``case_sensitive``, and are null without one. Only words and places are
    shuffled for that, not texts.
    """
    df, text = rerun(df, text)
    # the hits are used three times below, and found once
    result = durable(concordance(df, text, search, left, right, case_sensitive=case_sensitive, **options))
    places = result.select(F.col(ordinal).alias("__row"), F.posexplode("hits").alias("__i", "h")).select("__row", "__i", *(F.nullif(_folded(F.col(f"h.{s}"), case_sensitive), F.lit("")).alias(s) for s in ("l1", "r1")))
    for side in ("l1", "r1"):
        freq = places.groupBy(side).agg(F.count("*").alias(f"{side}_freq")).where(F.col(side).isNotNull())
        places = places.join(freq, side, "left")
    freqs = places.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("__i", "l1_freq", "r1_freq"))).alias("__f"))
    named = F.zip_with("hits", "__f", lambda h, f: F.struct(*((f if c.endswith("_freq") else h)[c[len(PREFIX) :]].alias(c) for c in GENERATED)))
    joined = result.join(freqs, result[ordinal] == freqs["__row"])
    return joined.withColumn("concordance", named).drop("hits", "__row", "__f").orderBy(ordinal)


def _folded(word: Column, case_sensitive: bool) -> Column:
    return word if case_sensitive else F.lower(word)


def rerun(df: DataFrame, text: str) -> tuple[DataFrame, str]:
    """df without the columns of an earlier run, and the name of its text column.

    A text column that has the name of one of them is kept as ``CONC_source``, or
    ``CONC_source_2`` and so on if that is taken.
    """
    names = set(df.columns)
    out = df.drop(*(c for c in GENERATED if c in names and c != text))
    if text not in GENERATED:
        return out, text
    free = next(c for c in (f"{PREFIX}source" + (f"_{i}" if i > 1 else "") for i in range(1, len(names) + 3)) if c not in names)
    return out.withColumnRenamed(text, free), free


def match_rows(result: DataFrame) -> DataFrame:
    """One row for each hit, with its position in the document and the frequencies of l1 and r1, case folded.

    The frequencies are counted apart and joined back, so a common neighbour is
    no window group in one task. Of the result, used three times, a table is
    written before hits become rows: each row has its document's columns.
    """
    rows = written(result).select("*", F.posexplode("hits").alias("match_index", "hit")).select(*(c for c in result.columns if c != "hits"), F.col("match_index").cast("bigint").alias("match_index"), "hit.*")
    for side in ("l1", "r1"):
        freq = rows.select(F.lower(side).alias("__word")).where("__word <> ''").groupBy("__word").agg(F.count("*").alias(f"{side}_freq"))
        rows = rows.join(freq, F.lower(side) == freq["__word"], "left").drop("__word")
    return rows


def document_filter(result: DataFrame, text: str, exclude: list[str] = (), bins: int | None = None, keep_bins: list[int] = ()) -> DataFrame:
    """Hits without the excluded matched texts, and in the chosen bins of the document's length."""
    kept = F.filter("hits", lambda h: ~h["matched_text"].isin(list(exclude))) if exclude else F.col("hits")
    if bins is not None:
        if bins not in BINS:
            raise ValueError("bins are 4, 5, 10, 20, 25, 50 or 100")
        kept = F.filter(kept, lambda h: position_bin(h["start_idx"], F.length(F.col(text)), bins).isin(list(keep_bins)))
    return result.withColumn("hits", kept).where(F.size("hits") > 0)


def position_bin(start: Column, length: Column, bins: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.floor(start * bins / length), F.lit(bins - 1))).cast("bigint")


def density(result: DataFrame, text: str, bins: int = 100) -> DataFrame:
    """(matched_text, bin, n): hits by relative place."""
    rows = result.select(F.length(text).alias("__n"), F.explode("hits").alias("h"))
    return rows.groupBy(F.col("h.matched_text").alias("matched_text"), position_bin(F.col("h.start_idx"), F.col("__n"), bins).alias("bin")).agg(F.count("*").alias("n"))


def dispersion(dense: DataFrame, bins: int, fold_case: bool = False) -> DataFrame:
    """Density folded into fewer bins, and optionally over the case of the series."""
    label = F.lower("matched_text") if fold_case else F.col("matched_text")
    return dense.groupBy(label.alias("series"), F.floor(F.col("bin") * bins / 100).alias("bin")).agg(F.sum("n").alias("n"))


def document_rows(result: DataFrame) -> DataFrame:
    """One row for each document, its extractions white-space normalised, one on a line."""
    lines = F.transform("hits", lambda h: F.trim(F.regexp_replace(h["extraction"], r"(?U)\s+", " ")))
    return result.withColumn("extractions", F.array_join(lines, "\n")).drop("hits")


def combined(pages: dict[str, DataFrame]) -> DataFrame:
    """Pages of several sources together, tagged with their source."""
    parts = [df.withColumn("source_block", F.lit(name)) for name, df in pages.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _sort_keys(column: str, ordinal: str, descending: bool, fold_case: bool) -> list[Column]:
    key = F.lower(column) if fold_case and column in ("l1", "r1", "matched_text") else F.col(column)
    key = F.nullif(key, F.lit("")) if column in ("l1", "r1", "matched_text") else key
    return [key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col(ordinal).asc(), F.col("match_index").asc()]


def sort_matches(rows: DataFrame, column: str, ordinal: str, descending: bool = False, fold_case: bool = True) -> DataFrame:
    """By one column, empties last; ties by row, then place, always upwards."""
    return rows.orderBy(*_sort_keys(column, ordinal, descending, fold_case))


def place_matches(rows: DataFrame, column: str, ordinal: str, descending: bool = False, fold_case: bool = True) -> DataFrame:
    """rows with their place, from 0, in the order of ``sort_matches``, so that any page is a range of places."""
    return numbered(rows, _sort_keys(column, ordinal, descending, fold_case), "place")
