"""Vector code compression: product codes by integer codebooks.

All arithmetic is on whole numbers, so every run gives the same codes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.llm.common import durable, meet, table

#: Parts of a vector, entries of a codebook (a code is one byte a part), rounds of fitting, steps to the unit.
PARTS, ENTRIES, ROUNDS, STEPS = 4, 256, 4, 1024
#: Vectors whose distances are held at once.
TILE = 2048


@dataclass(frozen=True)
class Codebooks:
    """values: part, entry, position within the part; whole numbers of 1 / STEPS."""

    values: np.ndarray

    @property
    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.values.ravel().tolist())).encode()).hexdigest()


def largest_component(width: int) -> int:
    """Components beyond this, either way, count as this, so that every distance fits in 64 bits.

    It is a power of two: 2**27 for vectors of 64 components, that is 131,072 before scaling.
    """
    return 1 << ((60 - max(width - 1, 0).bit_length()) // 2)


def _whole(column: pa.ListArray, width: int) -> np.ndarray:
    """The vectors in whole steps, a row each; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    limit = float(largest_component(width))
    steps = np.floor(np.clip(values, -limit, limit) * STEPS).clip(-limit, limit).astype(np.int64)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = steps
    return out


def nearest(vectors: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its nearest entry, the first of equals, and the squared distance to it.

    |x - c|**2 = |x|**2 - 2 x.c + |c|**2: all distances of a tile are one exact
    product of whole numbers.
    """
    norms = np.einsum("ed,ed->e", book, book)
    turned = np.ascontiguousarray(book.T)
    places, errors = [], []
    for a in range(0, len(vectors), TILE):
        x = vectors[a : a + TILE]
        scores = norms - 2 * np.einsum("nd,de->ne", x, turned)
        place = scores.argmin(axis=1)
        places.append(place)
        errors.append(scores[np.arange(len(x)), place] + np.einsum("nd,nd->n", x, x))
    return np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.int64), *errors])


def kept(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vectors without the rows whose vector is null or holds null or non-finite components."""
    finite = F.forall(F.col(vector), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return vectors.where(F.col(vector).isNotNull() & finite)


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of ``entries`` (at most 256) for each of ``parts`` equal consecutive parts.

    They start as the vectors of the smallest keys, nulls last, and of equal
    keys the smaller vector; there are fewer entries where there are fewer
    vectors. Each round deals every part to its nearest entry and replaces an
    entry by the floor of its parts' mean; an entry without parts stays. Vectors
    shorter than the longest, or whose length the parts do not divide, count
    as if zeros followed. Rows that repeat count each time. An empty table
    gives codebooks without entries.

    All rows take part in every round. A task sends one sum for each entry it
    used, and these are merged by a grouped shuffle, so what reaches the driver
    is parts x entries sums, whatever the number of rows; what is broadcast is
    codebooks of that size.
    """
    rows = kept(vectors, vector)
    longest = rows.agg(F.coalesce(F.max(F.size(vector)), F.lit(0))).first()[0]
    width = -(-longest // parts) * parts
    firsts = rows.select(vector, key).orderBy(F.col(key).asc_nulls_last(), vector).limit(entries)
    seeds = pa.array([r[0] for r in firsts.collect()], pa.list_(pa.float64()))
    books = _whole(seeds, width).reshape(len(seeds), parts, width // parts).transpose(1, 0, 2).copy()
    inner = width // parts
    for _ in range(rounds if books.size else 0):
        shared = vectors.sparkSession.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(shared.value)
            n = np.zeros(total.shape[:2], dtype=np.int64)
            for batch in batches:
                x = _whole(batch.column(0), width)
                for p in range(parts):
                    part = x[:, p * inner : (p + 1) * inner]
                    place, _ = nearest(part, shared.value[p])
                    order = np.argsort(place, kind="stable")
                    used, cuts = np.unique(place[order], return_index=True)
                    if len(used):
                        total[p, used] += np.add.reduceat(part[order], cuts, axis=0)
                        n[p] += np.bincount(place, minlength=n.shape[1])
            p, e = np.nonzero(n)
            offsets = pa.array(np.arange(len(p) + 1, dtype=np.int32) * inner)
            yield pa.record_batch([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(total[p, e].ravel())), pa.array(n[p, e])], ["part", "entry", "sums", "n"])

        found = rows.select(vector).mapInArrow(sums, "part int, entry int, sums array<bigint>, n bigint")
        wide = F.array(*(F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(inner)))
        books = books.copy()
        for r in found.groupBy("part", "entry").agg(wide.alias("sums"), F.sum("n").alias("n")).collect():
            books[r.part, r.entry] = [int(s) // r.n for s in r.sums]
        shared.destroy()
    return Codebooks(books)


def encode(vectors: DataFrame, codebooks: Codebooks, keep: tuple[str, ...] = ("vec_id",), vector: str = "embedding") -> DataFrame:
    """(*keep, code, error) for each row of vectors whose vector is kept.

    code: the entries of the parts, two hexadecimal digits each. error: the
    squared distance in steps, summed over the parts. Columns of vectors named
    code or error can be kept only under another name. Components beyond
    ``largest_component`` count as that. No shuffle.
    """
    books = codebooks.values
    parts, _, inner = books.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    fields = [vectors.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _whole(batch.column(len(keep)), parts * inner)
            code = np.zeros((len(x), parts), dtype=np.uint8)
            error = np.zeros(len(x), dtype=np.int64)
            for p in range(parts):
                place, part = nearest(x[:, p * inner : (p + 1) * inner], shared.value[p])
                code[:, p], error = place, error + part
            digits = code.tobytes().hex()
            spelt = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(spelt, pa.string()), pa.array(error)], [*keep, "code", "error"])

    rows = kept(vectors, vector).select(*(F.col(f"`{c}`") for c in keep), vector)
    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def decode(codes: DataFrame, codebooks: Codebooks, code: str = "code") -> DataFrame:
    """(code, decoded) for each row of codes: the vector (array of double) that its code stands for; null codes have none."""
    books = codebooks.values
    parts, _, inner = books.shape
    shared = codes.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelt = batch.column(0)
            place = np.frombuffer(bytes.fromhex("".join(c or "" for c in spelt.to_pylist())), np.uint8).reshape(-1, parts)
            flat = np.concatenate([shared.value[p][place[:, p]] for p in range(parts)], axis=1) / STEPS
            valid = spelt.is_valid().to_numpy(zero_copy_only=False)
            offsets = np.append(0, np.cumsum(valid * parts * inner)).astype(np.int32)
            vectors = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~valid, False)), pa.array(flat.ravel()))
            yield pa.record_batch([spelt, vectors], ["code", "decoded"])

    return codes.select(code).mapInArrow(run, "code string, decoded array<double>")


def _group(label: str) -> Column:
    """A label as text that is never null: equal labels, and nulls, have equal ones."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{label}`").cast("string")), F.lit(""))


def label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """coded, written once, with label_error: error summed over the rows with the same label, nulls together.

    null where a sum is beyond 64 bits. Sums are partial before they are
    shuffled; labels with a large share of the rows are met by broadcast.
    """
    rows = durable(coded.withColumn("__label", _group(label)))
    groups = durable(rows.groupBy("__label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n")))
    return meet(rows, groups, "__label").drop("__label")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = fit(vectors)
    coded = label_errors(encode(vectors, books, keep=("vec_id", "label")))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def _oracle() -> str:
    """Rounds written one after the other; components are numbered within their part."""
    floor = "(s - ((s % n) + n) % n) // n"
    assign = lambda r: f"""
d{r} AS MATERIALIZED (
    SELECT x.i, x.p, b.e, sum((x.v - b.v) * (x.v - b.v)) AS d FROM x JOIN b{r} b ON x.p = b.p AND x.j = b.j GROUP BY ALL
),
a{r} AS MATERIALIZED (
    SELECT i, p, e, d FROM (SELECT *, row_number() OVER (PARTITION BY i, p ORDER BY d, e) AS k FROM d{r}) WHERE k = 1
)"""  # noqa: E731
    renew = lambda r: f"""
m{r} AS (SELECT x.p, a.e, x.j, cast(sum(x.v) AS bigint) AS s, count(*) AS n FROM x JOIN a{r} a ON x.i = a.i AND x.p = a.p GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, CASE WHEN n IS NULL THEN b.v ELSE {floor} END AS v FROM b{r} b LEFT JOIN m{r} m ON b.p = m.p AND b.e = m.e AND b.j = m.j)"""  # noqa: E731
    steps = ",".join(assign(r) + "," + renew(r) for r in range(ROUNDS)) + "," + assign(ROUNDS)
    return f"""
WITH k AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, label, list_transform(embedding, lambda y: cast(floor({STEPS} * cast(y AS double)) AS bigint)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
),
u AS (SELECT i, len(v) // {PARTS} AS w, unnest(range(1, len(v) + 1)) AS q, unnest(v) AS v FROM k),
x AS MATERIALIZED (SELECT i, (q - 1) // w AS p, (q - 1) % w AS j, v FROM u),
b0 AS MATERIALIZED (SELECT p, i - 1 AS e, j, v FROM x WHERE i <= {ENTRIES}),
{steps},
f AS (SELECT i, cast(sum(d) AS bigint) AS error, string_agg(printf('%02x', e), '' ORDER BY p) AS code FROM a{ROUNDS} GROUP BY i),
h AS (SELECT sha256(string_agg(cast(v AS varchar), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, cast(sum(error) OVER (PARTITION BY label) AS bigint) AS label_error, codebooks_sha256
FROM k JOIN f USING (i), h
"""


ORACLE = _oracle()
