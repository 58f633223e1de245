"""Benchmark decontamination: one Aho-Corasick automaton over the items' word windows."""

from __future__ import annotations

import math
from uuid import uuid4

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm.common import add_columns, durable, lists, table

WINDOW = 10
#: Bytes of item text in one automaton; larger benchmarks take several scans.
AUTOMATON_BYTES = 1 << 20
#: Scans in one plan; after so many the hits so far are written.
MOST_SCANS = 8

#: Bytes of a word stay, in lower case; other ASCII becomes a space. Lengths do not change.
_NORMAL = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


class Matcher:
    """The automaton; each of its keys is a window with a space before and after.

    Texts are seen as one character for each byte, so positions are byte positions.
    """

    def __init__(self, items: list[tuple[str, str]], window: int):
        patterns: dict[str, set[str]] = {}
        for item, text in items:
            words = (text or "").encode().translate(_NORMAL).split()
            for i in range(max(1, len(words) - window + 1) if words else 0):
                key = b" " + b" ".join(words[i : i + window]) + b" "
                patterns.setdefault(key.decode("latin-1"), set()).add(item)
        self.items = list(patterns.values())
        self.automaton = ahocorasick.Automaton()
        for i, key in enumerate(patterns):
            self.automaton.add_word(key, (i, len(key), key.count(" ") - 1))
        if patterns:
            self.automaton.make_automaton()
        self.any = bool(patterns)

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Places (first word, number of words) of windows, and the items they belong to."""
        if not self.any:
            return [], set()
        line = b" " + b" ".join(words) + b" "
        met = list(self.automaton.iter(line.decode("latin-1")))
        if not met:
            return [], set()
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
        starts = np.searchsorted(spaces, [end + 1 - size for end, (_, size, _) in met])
        items = set().union(*(self.items[i] for i in {i for _, (i, _, _) in met}))
        return [(int(at), n) for at, (_, (_, _, n)) in zip(starts, met, strict=True)], items


_built: dict[str, Matcher] = {}


def _matcher(name: str, items: Broadcast, window: int) -> Matcher:
    """One automaton at a time stays in a Python worker."""
    if name not in _built:
        _built.clear()
        _built[name] = Matcher(items.value, window)
    return _built[name]


def _word_ranges(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, in code points of the original text."""
    data = np.frombuffer(raw.translate(_NORMAL), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], data != 0x20, [0])).astype(np.int8)))
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return points[edge[0::2]], points[edge[1::2]]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES
) -> DataFrame:
    """docs with n_words, n_hit (bigint), item_ids (sorted strings) and hits.

    A window is ``window`` consecutive words of an item; an item with fewer
    words, but not none, is one window. n_hit counts the words of a text inside
    any occurrence of a window; hits holds those stretches as (start, end) code
    points of the original text. Null or empty texts have no words, no hits;
    items without words or with a null key match nothing; items that share a
    window, or a key, are all reported, a key once. An empty benchmark hits
    nothing.

    The benchmark is measured first. While its text fits ``automaton_bytes`` it
    is one broadcast automaton and texts are scanned once. A larger one is split
    by hash into blocks of about that size, each with an automaton and a scan of
    its own, whose hits are added up; nothing is left out.
    """
    named = benchmark.where(F.col(item_key).isNotNull()).select(F.col(item_key).cast("string").alias("k"), F.col(item_text).alias("t"))
    blocks = max(1, math.ceil((named.agg(F.sum(F.octet_length("t"))).first()[0] or 0) / automaton_bytes))
    context = docs.sparkSession.sparkContext
    for block in range(blocks):
        rows = named.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == block).collect()
        items = context.broadcast([(r.k, r.t) for r in rows])
        if block and block % MOST_SCANS == 0:
            docs = durable(docs)
        docs = _scan(docs, text, items, window, again=block > 0)
    return docs


def _scan(docs: DataFrame, text: str, items: Broadcast, window: int, again: bool) -> DataFrame:
    name = uuid4().hex

    def compute(texts: pa.Array) -> list[pa.Array]:
        matcher = _matcher(name, items, window)
        n_words, n_hit, ids, starts, ends, sizes = [], [], [], [], [], []
        for value in texts.cast(pa.binary()).to_pylist():
            words = (value or b"").translate(_NORMAL).split()
            places, found = matcher.find(words)
            n_words.append(len(words))
            ids.append(sorted(found))
            covered = np.zeros(len(words) + 1, dtype=np.int64)
            for at, n in places:
                covered[at] += 1
                covered[at + n] -= 1
            inside = np.cumsum(covered)[:-1] > 0
            n_hit.append(int(inside.sum()))
            if places:
                edge = np.flatnonzero(np.diff(np.concatenate(([0], inside, [0])).astype(np.int8)))
                first, last = _word_ranges(value)
                starts.append(first[edge[0::2]])
                ends.append(last[edge[1::2] - 1])
            sizes.append(len(edge) // 2 if places else 0)
        flat = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (starts, ends)]
        spans = pa.StructArray.from_arrays([pa.array(x) for x in flat], ["start", "end"])
        return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(ids, pa.list_(pa.string())), lists(spans, np.array(sizes))]

    shape = "n_words bigint, n_hit bigint, item_ids array<string>, hits array<struct<start: bigint, end: bigint>>"
    if not again:
        return add_columns(docs, text, shape, compute)
    before = docs.withColumnsRenamed({"item_ids": "__items", "hits": "__hits"})
    return _merged(add_columns(before, text, shape, compute), text)


def _merged(docs: DataFrame, text: str) -> DataFrame:
    """Adds the hits of an earlier scan: overlapping stretches become one, and its words are counted anew."""
    last = lambda done: F.try_element_at(done, F.lit(-1))
    grow = lambda done, x: F.concat(
        F.slice(done, F.lit(1), F.size(done) - 1),
        F.array(F.struct(last(done)["start"].alias("start"), F.greatest(last(done)["end"], x["end"]).alias("end"))),
    )
    grown = F.aggregate(
        F.array_sort(F.concat("__hits", "hits")),
        F.array().cast("array<struct<start: bigint, end: bigint>>"),
        lambda done, x: F.when(last(done)["end"] >= x["start"], grow(done, x)).otherwise(F.concat(done, F.array(x))),
    )
    docs = docs.withColumn("hits", grown).withColumn("item_ids", F.array_sort(F.array_union("__items", "item_ids")))
    inside = F.transform("hits", lambda h: F.substring(F.col(text), h["start"].cast("int") + 1, (h["end"] - h["start"]).cast("int")))
    count = F.aggregate(inside, F.lit(0).cast("bigint"), lambda n, x: n + F.regexp_count(x, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))
    return docs.withColumn("n_hit", F.coalesce(count, F.lit(0).cast("bigint"))).drop("__items", "__hits")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH b AS (
    SELECT cast(item_id AS varchar) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE item_id IS NOT NULL
), bw AS (
    SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0
), p AS (
    SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM bw
), d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), dw AS (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n
), m AS (
    SELECT doc_id, i, n, item FROM (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM dw) JOIN p USING (n, g)
), h AS (
    SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM m) GROUP BY doc_id
), t AS (
    SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM m GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
