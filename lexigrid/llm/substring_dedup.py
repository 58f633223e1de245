"""Substring dedup: Rabin-Karp hashes of word windows, counted across documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm.common import durable, lists, meet, pieces, table
from lexigrid.llm.textbytes import WordTable, mix, rolling, window_hashes

WINDOW = 50
#: Marks and copies with over one part in HOT_BOUND of the rows are hot; hot windows are dealt to SALTS places.
HOT_BOUND, SALTS = 5000, 64


def _table(texts: pa.Array) -> WordTable:
    return WordTable([t or b"" for t in texts.cast(pa.binary()).to_pylist()])


def _marks(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window of words, the least hash among its inner runs of half its size.

    Windows of equal words have equal marks, and neighbours mostly share theirs,
    so distinct marks are few. That is winnowing.
    """
    half = (window + 1) // 2
    runs = window_hashes(hashes, half)
    span = window - half + 1
    n = len(hashes) - window + 1
    reach, least = 1, runs
    while 2 * reach <= span:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    return np.minimum(least[:n], least[span - reach : span - reach + n])


def _of_rows(words: WordTable, window: int) -> Iterator[tuple[int, int, int]]:
    """(row, first window, end of windows) of each text that has a window."""
    for row, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        if b - a >= window:
            yield row, a, b - window + 1


def _blobs(words: WordTable, rows: np.ndarray) -> list[bytes]:
    """The hash, in two lanes, of the whole sequence of words of each of the rows."""
    lanes = [mix(rolling(words.hashes(i), words.first[rows], words.first[rows + 1], i, words=True)) for i in (0, 1)]
    return [x.tobytes() for x in np.stack(lanes, axis=1)]


def _copies(words: WordTable, known: pa.Array) -> set[int]:
    """The rows whose own sequence of words is among those that their key has from a smaller one."""
    lists = known.to_pylist()
    rows = np.array([i for i, x in enumerate(lists) if x], dtype=np.int64)
    return {i for i, blob in zip(rows.tolist(), _blobs(words, rows), strict=True) if blob in lists[i]} if len(rows) else set()


def _addresses(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The hash, in two lanes, of the whole sequence of words of each row that has a window; white space has no part in it."""
    for batch in batches:
        for lo, hi in pieces(batch.column(1)):
            words = _table(batch.column(1)[lo:hi])
            rows = np.array([row for row, _, _ in _of_rows(words, window)], dtype=np.int64)
            if len(rows):
                yield pa.record_batch([batch.column(0)[lo:hi].take(pa.array(rows)), pa.array(_blobs(words, rows), pa.binary())], ["k", "blob"])


def _distinct_marks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Each row's distinct marks, with a hash of the row's whole sequence of words."""
    for batch in batches:
        for lo, hi in pieces(batch.column(1)):
            words = _table(batch.column(1)[lo:hi])
            if len(words.starts) < window:
                continue
            hashes = words.hashes()
            marks = _marks(hashes, window)
            found = [(row, np.unique(marks[a:b])) for row, a, b in _of_rows(words, window)]
            if found:
                rows = np.repeat([r for r, _ in found], [len(m) for _, m in found])
                whole = mix(rolling(hashes, words.first[rows], words.first[rows + 1], 0, words=True))
                yield pa.record_batch(
                    [batch.column(0)[lo:hi].take(pa.array(rows)), pa.array(np.concatenate([m for _, m in found]).view(np.int64)), pa.array(whole.view(np.int64))],
                    ["k", "mark", "whole"],
                )


def _windows(batches: Iterator[pa.RecordBatch], window: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Both hash lanes of every window whose mark is among those of its row, and its salt; copies are left out.

    Windows of equal words have equal marks, so all of them are salted (1 to
    SALTS) or none (0), by whether their mark is hot.
    """
    for batch in batches:
        for lo, hi in pieces(batch.column(1)):
            words = _table(batch.column(1)[lo:hi])
            first = words.hashes()
            if len(first) < window:
                continue
            marks = _marks(first, window)
            lanes = window_hashes(first, window), window_hashes(words.hashes(1), window, 1)
            shared = batch.column(2)[lo:hi]
            copies = _copies(words, batch.column(3)[lo:hi])
            found = []
            for row, a, b in _of_rows(words, window):
                if row in copies:
                    continue
                at = a + np.flatnonzero(np.isin(marks[a:b], shared[row].values.to_numpy().view(np.uint64)))
                _, once = np.unique(lanes[0][at], return_index=True)
                found.append((row, at[once]))
            if found:
                rows, at = np.repeat([r for r, _ in found], [len(x) for _, x in found]), np.concatenate([x for _, x in found])
                own = (lanes[1][words.first[rows]] % np.uint64(SALTS)).astype(np.int32) + 1
                salt = np.where(np.isin(marks[at], hot), own, 0).astype(np.int32)
                yield pa.record_batch([batch.column(0)[lo:hi].take(pa.array(rows)), *(pa.array(x[at].view(np.int64)) for x in lanes), pa.array(salt)], ["k", "h1", "h2", "salt"])


def _removals(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Merges the windows to remove into maximal intervals of words."""
    for batch in batches:
        for lo, hi in pieces(batch.column(1)):
            words = _table(batch.column(1)[lo:hi])
            lane = window_hashes(words.hashes(), window) if len(words.starts) >= window else np.zeros(0, np.uint64)
            copies, drop = _copies(words, batch.column(2)[lo:hi]), batch.column(3)[lo:hi]
            total, starts, ends, sizes, kept = [], [], [], [], []
            for row, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                covered = np.zeros(b - a + 1, dtype=np.int64)
                if b - a >= window and drop[row].is_valid:
                    at = np.flatnonzero(np.isin(lane[a : b - window + 1], drop[row].values.to_numpy().view(np.uint64)))
                    np.add.at(covered, at, 1)
                    np.add.at(covered, at + window, -1)
                gone = np.cumsum(covered)[:-1] > 0
                if row in copies:
                    gone[:] = True
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0])).astype(np.int8)))
                total.append(b - a)
                starts.append(edge[0::2])
                ends.append(edge[1::2])
                sizes.append(len(edge) // 2)
                stay = a + np.flatnonzero(~gone)
                kept.append(b" ".join([words.joined[x:y] for x, y in zip(words.starts[stay].tolist(), words.ends[stay].tolist(), strict=True)]))
            spans = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (starts, ends)], ["start", "end"])
            yield pa.record_batch(
                [batch.column(0)[lo:hi], pa.array(total, pa.int64()), lists(spans, np.array(sizes)), pa.array(kept, pa.binary()).cast(pa.string())],
                ["k", "n_words", "removed", "kept"],
            )


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, removed, kept) for each row of docs.

    A word goes if a window of ``window`` consecutive words that covers it also
    starts in a row with a smaller key; windows are judged on the input. removed:
    maximal intervals (start, end) of word positions; kept: the remaining words,
    unchanged, joined by one space. Null and empty texts have no words; a row
    with a null key is neither smaller nor larger than another and keeps all its
    words; rows with equal keys do not remove each other's words.

    Every window has a Rabin-Karp hash in two 64-bit lanes. Two windows with the
    same words also share the least hash of their inner half-size runs (their
    mark), so marks are counted first, some four for 50 words, and only windows
    whose mark occurs in two different texts are counted by their own hash: the
    others cannot occur in two. Texts with the same sequence of words are copies,
    whatever white space parts them: a copy of a text with a smaller key goes
    whole and is not counted again; other rows of its key are judged by
    themselves. A very long text is one row of one batch; an empty table gives
    an empty one. No group is gathered: counts and least keys
    are partial aggregates; marks and copies that hold over 1 / HOT_BOUND of the
    rows are known by a broadcast of that size, and their windows are salted.
    """
    kind = docs.schema[key].dataType.simpleString()
    named = docs.select(key, text).where(F.col(key).isNotNull())

    addresses = durable(named.mapInArrow(lambda it: _addresses(it, window), f"k {kind}, blob binary"))
    groups = durable(addresses.groupBy("blob").agg(F.min("k").alias("least"), F.max("k").alias("most"), F.count("*").alias("n")).where("least < most").drop("most"))
    copies = meet(addresses, groups, "blob", HOT_BOUND).where("least < k").groupBy(F.col("k").alias(key)).agg(F.collect_set("blob").alias("__copies"))

    marks = named.mapInArrow(lambda it: _distinct_marks(it, window), f"k {kind}, mark bigint, whole bigint")
    counted = marks.groupBy("mark").agg(F.min("whole").alias("a"), F.max("whole").alias("b"), F.count("*").alias("n")).where("a <> b").select("mark", "n")
    counted = durable(counted)
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = np.array([r.mark for r in counted.where(F.col("n") * HOT_BOUND >= total).collect()], dtype=np.int64).view(np.uint64)
    shared = meet(marks.select("k", "mark"), counted, "mark", HOT_BOUND).groupBy(F.col("k").alias(key)).agg(F.collect_set("mark").alias("__marks"))

    sought = named.join(shared, key).join(copies, key, "left").select(key, text, "__marks", "__copies")
    windows = sought.mapInArrow(lambda it: _windows(it, window, hot), f"k {kind}, h1 bigint, h2 bigint, salt int")
    least = windows.groupBy("h1", "h2", (F.col("salt") > 0).alias("hot")).agg(F.min("k").alias("least"), F.max("k").alias("most")).where("least < most")
    salts = F.when(F.col("hot"), F.sequence(F.lit(1), F.lit(SALTS))).otherwise(F.array(F.lit(0)))
    met = windows.join(least.select("h1", "h2", "least", F.explode(salts).alias("salt")), ["h1", "h2", "salt"]).where("least < k")
    repeated = met.groupBy(F.col("k").alias(key)).agg(F.collect_set("h1").alias("__drop"))

    shape = f"k {kind}, n_words bigint, removed array<struct<start: bigint, end: bigint>>, kept string"
    nameless = docs.where(F.col(key).isNull()).select(key, text, F.lit(None).cast("array<binary>").alias("__copies"), F.lit(None).cast("array<bigint>").alias("__drop"))
    judged = named.join(copies, key, "left").join(repeated, key, "left").select(key, text, "__copies", "__drop").unionByName(nameless)
    return judged.mapInArrow(lambda it: _removals(it, window), shape).withColumnRenamed("k", key)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"])
    return done.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50
), h AS (
    SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS g FROM s
), m AS (
    SELECT g, min(doc_id) AS least FROM h GROUP BY g HAVING min(doc_id) < max(doc_id)
), r AS (
    SELECT h.doc_id, h.i FROM h JOIN m USING (g) WHERE m.least < h.doc_id
), c AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM r
), g AS (
    SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(len(g.gone), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN g.gone IS NULL THEN d.w
              ELSE list_transform(list_filter(range(1, len(d.w) + 1), lambda p: NOT list_contains(g.gone, p)), lambda p: d.w[p]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
