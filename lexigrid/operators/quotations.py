"""Quotations with all their parts and places, by rule: who says what, by which verb.

A quotation's type lists its parts in order: Q a quotation mark, C what is
said, V the verb, S the speaker. Without a language model at hand, verbs are
of a list and speakers are names, pronouns or short noun phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.functions.text import pieces
from lexigrid.operators.quotes import VERBS

#: The 13 fields of a quotation, in their order.
FIELDS = (
    "speaker string, speaker_start_idx bigint, speaker_end_idx bigint, quote string, quote_start_idx bigint, quote_end_idx bigint, verb string, verb_start_idx bigint, verb_end_idx bigint, "
    "quote_type string, quote_token_count bigint, is_floating_quote boolean, quote_row_idx bigint"
)
_VERB = "(?P<V>" + "|".join(VERBS) + ")"
_NAME = r"(?P<S>\p{Lu}[\p{L}'’.-]*(?: \p{Lu}[\p{L}'’-]*){0,3}|(?i:he|she|they|we|i|it)(?!\p{L})|(?i:the|a|an|his|her|their) (?:\p{Ll}[\p{L}-]* )?\p{Ll}[\p{L}-]*?)"
#: What stands right behind a quotation, or right before one.
_BEHIND = (("VS", rf"[,.]? ?{_VERB} {_NAME}(?![\p{{L}}])"), ("SV", rf"[,.]? ?{_NAME} {_VERB}(?!\p{{L}})"))
_AHEAD = (("SV", rf"(?<![\p{{L}}]){_NAME} {_VERB}(?: that)?[,:]? ?$"), ("VS", rf"(?<!\p{{L}})(?i:{_VERB}) {_NAME}[,:] ?$"))
_ACCORDING = rf"(?<!\p{{L}})(?P<V>[Aa]ccording to) {_NAME}(?:, ?|(?=[.!?]|$))"
#: Reported speech, a whole sentence without marks.
_REPORTED = (("SVC", rf"{_NAME} {_VERB} (?:that )?(?P<C>[^,].{{8,}})"), ("CSV", rf"(?P<C>.{{8,}}), {_NAME} {_VERB}"), ("CVS", rf"(?P<C>.{{8,}}), {_VERB} {_NAME}"))


@lru_cache(maxsize=64)
def _pattern(text: str) -> regex.Pattern:
    return regex.compile(text)


def normalized(text: str) -> tuple[str, list[int]]:
    """The text as rules read it, and for each of its characters, and its end, the place in the original.

    Runs of white space are one space, or one line break if they hold one; all
    double quotation marks are straight; invisible characters are gone.
    """
    out, places, at = [], [], 0
    for m in _pattern(r"\s+|[“”„‟«»〝〞＂]|[­​-‍⁠﻿]+").finditer(text):
        out.append(text[at : m.start()])
        places.extend(range(at, m.start()))
        if m[0][0].isspace():
            new = "\n" if "\n" in m[0] else " "
        else:
            new = '"' if m[0] in "“”„‟«»〝〞＂" else ""
        out.append(new)
        places.extend([m.start()] * len(new))
        at = m.end()
    out.append(text[at:])
    places.extend(range(at, len(text) + 1))
    return "".join(out), places


def _sentences(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Stretches of a paragraph that end in a mark, also inside quotation marks, before a new beginning."""
    at = start
    for m in _pattern(r'[.!?]+"? (?=[\p{Lu}"])').finditer(text, start, end):
        yield at, m.end() - 1
        at = m.end()
    if at < end:
        yield at, end


def parse(text: str) -> list[dict[str, object]]:
    """The quotations of a text, in the order of their places; spans are of the original text, ends exclusive.

    Marks pair up within a paragraph. A quotation takes the verb and speaker
    right behind it, else right before it, else those of ``according to``. One
    without them that follows another with nothing but space between continues
    it and takes its speaker (QCQ, floating). Any other is Heuristic and has the
    nearest verb and speaker of its sentence, if it has. Sentences without marks
    may be reported speech. A mark without a partner counts for nothing.
    """
    clean, places = normalized(text)
    found: list[tuple[int, int, str, regex.Match | None]] = []
    for paragraph in _pattern(r"[^\n]+").finditer(clean):
        begin, end = paragraph.span()
        last, quoted = None, []
        for m in _pattern(r'"[^"\n]{2,}?"').finditer(clean, begin, end):
            kind, who = "Heuristic", None
            ahead_from = last[1] if last else begin
            for order, p in _BEHIND:
                if who is None and (hit := _pattern(p).match(clean, m.end(), end)):
                    kind, who = f"QCQ{order}", hit
            for order, p in _AHEAD:
                if who is None and (hit := _pattern(p).search(clean, ahead_from, m.start())):
                    kind, who = f"{order}QCQ", hit
            if who is None and (hit := _pattern(_ACCORDING + "$").search(clean, ahead_from, m.start()) or _pattern(r",? ?" + _ACCORDING).match(clean, m.end(), end)):
                kind, who = "AccordingTo", hit
            if who is None and last and not clean[last[2] : m.start()].strip(" ,.;"):
                kind, who = "QCQ", last[3]
            if who is None:
                s, e = next(((s, e) for s, e in _sentences(clean, begin, end) if s <= m.start() < e), (begin, end))
                near = [h for p in (rf"{_NAME} {_VERB}(?!\p{{L}})", rf"{_VERB} {_NAME}(?!\p{{L}})") for h in _pattern(p).finditer(clean, s, e) if h.end() <= m.start() or h.start() >= m.end()]
                who = min(near, key=lambda h: (max(m.start() - h.end(), h.start() - m.end()), h.start()), default=None)
            found.append((m.start(), m.end(), kind, who))
            quoted.append(m.span())
            reach = max(m.end(), who.end()) if who is not None and kind not in ("QCQ", "Heuristic") else m.end()
            last = (m.start(), m.end(), reach, who)
        for s, e in _sentences(clean, begin, end):
            if any(a < e and s < b for a, b in quoted):
                continue
            stop = e - len(clean[s:e]) + len(clean[s:e].rstrip(".!? "))
            if hit := _pattern(_ACCORDING + r"(?P<C>.+)?").match(clean, s, stop):
                if hit["C"]:
                    found.append((*hit.span("C"), "AccordingTo", hit))
                continue
            if hit := _pattern(rf"(?P<C>.+?),? {_ACCORDING}$").match(clean, s, stop):
                found.append((*hit.span("C"), "AccordingTo", hit))
                continue
            for kind, p in _REPORTED:
                if hit := _pattern(p).fullmatch(clean, s, stop):
                    found.append((*hit.span("C"), kind, hit))
                    break
    out = []
    for i, (a, b, kind, who) in enumerate(sorted(found, key=lambda x: x[:2])):
        row: dict[str, object] = {}
        for name, span in (("speaker", who.span("S") if who else None), ("quote", (a, b)), ("verb", who.span("V") if who and kind != "QCQ" else None)):
            start, stop = (places[span[0]], places[span[1] - 1] + 1) if span and span[1] > span[0] else (None, None)
            row |= {name: None if start is None else text[start:stop], f"{name}_start_idx": start, f"{name}_end_idx": stop}
        words = len(_pattern(r"[\p{L}\p{M}\p{N}_]+").findall(clean[a:b]))
        out.append(row | {"quote_type": kind, "quote_token_count": words, "is_floating_quote": kind == "QCQ", "quote_row_idx": i})
    return out


def extract(df: DataFrame, text: str, column: str = "quotation") -> DataFrame:
    """df with the quotations of a text, an array of FIELDS, empty without any; null and blank texts have none. No shuffle."""
    kept = [f for f in df.schema if f.name != column]
    at = [f.name for f in kept].index(text)
    kind = pa.list_(pa.struct([(f.name, {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[f.dataType.simpleString()]) for f in T.StructType.fromDDL(FIELDS)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(at)):
                some = batch.slice(a, b - a)
                found = pa.array([parse(t) if t else [] for t in some.column(at).to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([*some.columns, found], [*(f.name for f in kept), column])

    shape = T.StructType([*kept, T.StructField(column, T.ArrayType(T.StructType.fromDDL(FIELDS)))])
    return df.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(run, shape)


def add(result: DataFrame, column: str = "quotation") -> DataFrame:
    """One row for each quotation, its fields prefixed ``QUOTE_``; earlier columns of these names are replaced."""
    names = [f.name for f in T.StructType.fromDDL(FIELDS)]
    own = [c for c in result.columns if c != column and c not in {f"QUOTE_{n}" for n in names}]
    rows = result.select(*(F.col(f"`{c}`") for c in own), F.explode(column).alias("__q"))
    return rows.select(*(F.col(f"`{c}`") for c in own), *(F.col(f"__q.{n}").alias(f"QUOTE_{n}") for n in names))


def preview(df: DataFrame, key: str, text: str, size: int, after: object = None, first: int = 64, growth: int = 4) -> tuple[DataFrame, object, int]:
    """(page, last key, documents read): the first ``size`` documents behind ``after`` that have quotations, by rising key.

    Documents are read in ranges of keys, each ``growth`` times as long as the
    one before, until the page is full or none is left; the last key is where the
    next page begins. A page and a range are bounded, whatever the size of df.
    """
    spark = df.sparkSession
    shape = T.StructType([df.schema[key], df.schema[text], T.StructField("quotation", T.ArrayType(T.StructType.fromDDL(FIELDS)))])
    page: list = []
    read, take = 0, first
    while len(page) < size:
        rest = df.where(F.col(key).isNotNull()) if after is None else df.where(F.col(key) > F.lit(after))
        rows = extract(rest.select(key, text).orderBy(key).limit(take), text).collect()
        rows.sort(key=lambda r: r[key])
        for r in rows:
            after, read = r[key], read + 1
            if r.quotation:
                page.append(r)
                if len(page) == size:
                    break
        if len(rows) < take:
            break
        take *= growth
    return spark.createDataFrame(page, shape), after, read


def finished(df: DataFrame, place: str) -> dict[int, str]:
    """Part and its last fingerprint of what a run at ``place`` has finished; none where there was no run."""
    try:
        rows = df.sparkSession.read.schema("part int, fingerprint string, at timestamp").parquet(f"{place}/manifest").orderBy("at").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {r.part: r.fingerprint for r in rows}


def run(df: DataFrame, text: str, place: str, parts: int = 16) -> DataFrame:
    """Rows of df that have quotations, with ``quotation``; each distinct text is parsed once, and a run that broke goes on where it was.

    Distinct texts are dealt to ``parts`` by a digest. A part is parsed and
    written over whatever a broken run left of it; then the manifest gets its
    number and a fingerprint of its texts. A later run at the same place leaves
    out parts with an equal fingerprint, so only what changed is parsed again.
    Rows meet their texts' quotations by digest; null texts have none.
    """
    spark = df.sparkSession
    digest = F.sha2(F.col(f"`{text}`"), 256)
    texts = df.where(F.col(f"`{text}`").isNotNull()).select(digest.alias("digest"), F.col(f"`{text}`").alias("text")).dropDuplicates(["digest"])
    texts = texts.withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("int"))
    texts.write.mode("overwrite").partitionBy("part").parquet(f"{place}/texts")
    stored = spark.read.schema("digest string, text string, part int").parquet(f"{place}/texts")
    prints = stored.groupBy("part").agg(F.concat_ws(":", F.count("*"), F.bit_xor(F.xxhash64("digest")), F.lit(parts)).alias("fingerprint")).orderBy("part").collect()
    done = finished(df, place)
    for r in prints:
        if done.get(r.part) != r.fingerprint:
            parsed = extract(stored.where(F.col("part") == r.part).select("digest", "text"), "text").where(F.size("quotation") > 0)
            parsed.select("digest", "quotation").write.mode("overwrite").parquet(f"{place}/quotations/part={r.part}")
            spark.createDataFrame([(r.part, r.fingerprint)], "part int, fingerprint string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{place}/manifest")
    shape = T.StructType([T.StructField("digest", T.StringType()), T.StructField("quotation", T.ArrayType(T.StructType.fromDDL(FIELDS))), T.StructField("part", T.IntegerType())])
    if not prints:
        found = spark.createDataFrame([], shape).drop("part")
        return df.withColumn("digest", digest).join(found, "digest").drop("digest")
    found = spark.read.schema(shape).parquet(f"{place}/quotations").where(F.col("part").isin([r.part for r in prints])).drop("part")
    return df.withColumn("digest", digest).join(found, "digest").drop("digest")
