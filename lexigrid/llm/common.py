"""What the corpus operators share: cutting lineage, small expressions, batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.functions.shared import durable, shared_folder  # noqa: F401

#: White space that separates words: space, tab, line feed, VT, FF, CR.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def crc_remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key written as text, modulo ``modulus``; -1 for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus, F.lit(-1))


def words_of(text: Column) -> Column:
    """Runs of characters that are not white space; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def pieces(column: pa.Array | pa.ChunkedArray, budget: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow string column that hold about ``budget`` bytes each.

    One row larger than the budget is a range of its own, so the memory a task
    needs follows the budget and the longest text, not the batch.
    """
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > budget:
            yield start, i
            start, held = i, 0
        held += int(size) + 1
    if start < len(sizes):
        yield start, len(sizes)


def add_columns(docs: DataFrame, text: str, outputs: str, compute: Callable[[pa.Array], list[pa.Array]], budget: int = 1 << 20) -> DataFrame:
    """docs with columns that ``compute`` makes of the string column ``text``.

    outputs: the new columns as a schema string; compute gets a slice of the
    column as an Arrow array of strings, nulls included, and returns one array
    for each of them. A column of docs with the name of an output is replaced.
    No shuffle; every batch is worked through in pieces of about ``budget``
    bytes of text. The text goes to Python once, also where it is kept.
    """
    added = T.StructType.fromDDL(outputs)
    taken = {f.name.lower() for f in added}
    kept = [f for f in docs.schema if f.name.lower() not in taken]
    width = len(kept)
    names = [f.name for f in kept] + [f.name for f in added]
    at = next((i for i, f in enumerate(kept) if f.name.lower() == text.lower() and f.dataType == T.StringType()), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(at), budget):
                yield pa.RecordBatch.from_arrays([batch.column(i)[a:b] for i in range(width)] + compute(batch.column(at)[a:b]), names)

    columns = [docs[f"`{f.name}`"] for f in kept]
    if at == width:
        columns.append(docs[f"`{text}`"].cast("string").alias("__text"))
    return docs.select(*columns).mapInArrow(run, T.StructType([*kept, *added]))


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """An Arrow list column whose rows are consecutive runs of values."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def meet(rows: DataFrame, groups: DataFrame, on: str, bound: int = 5000) -> DataFrame:
    """Inner equi-join of rows with one row for each key, whatever a key's share of the rows.

    groups: the key, its number of rows as n, and what to bring. A key with at
    least 1 / bound of the rows is hot; there can be no more than ``bound`` of
    them, so they are broadcast and their rows are not shuffled. The rest meet
    by shuffle, where each key is a small part of a task.
    """
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = groups.where(F.col("n") * bound >= total).drop("n")
    cold = groups.where(F.col("n") * bound < total).drop("n")
    apart = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on)
    return rows.join(F.broadcast(hot), on).unionByName(apart)
