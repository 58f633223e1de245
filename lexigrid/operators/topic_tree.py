"""The tree by which topics merge, their terms, and the coverage of documents by them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.functions.shared import written
from lexigrid.operators.density import TILE, _by_tiles, _jump, _matrix, _steps
from lexigrid.operators.order import numbered


def centroids(vectors: DataFrame, topic: str, vector: str) -> tuple[DataFrame, int]:
    """(topic_id, steps): the direction of each real topic's mean, in whole steps, and the vectors' length.

    Rows without a finite vector or of the outlier topic -1 count for nothing.
    Sums are of whole numbers and partial before they are shuffled.
    """
    rows, width = _steps(vectors.where(F.col(topic) >= 0).select(F.col(topic).cast("bigint").alias("topic_id"), vector), vector)
    sums = F.array(*(F.sum(F.coalesce(F.get("steps", F.lit(i)), F.lit(0)).cast("bigint")) for i in range(width)))
    found = written(rows.groupBy("topic_id").agg(sums.alias("sums")))
    bits = max(12, min(16, 27 - max(found.count() - 1, 1).bit_length()))  # so that products of sums are exact
    norm = F.sqrt(F.aggregate("sums", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = F.transform("sums", lambda x: F.round(F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0)) * (1 << bits)).cast("int"))
    return found.select("topic_id", unit.alias("steps")), width


def merge_tree(topics: DataFrame, width: int) -> DataFrame:
    """(place, kept, absorbed, height): the merges of topics by average linkage of cosine distance, nearest first.

    topics: topic_id (from 0) and steps, its direction. The distance of two
    groups of topics is the mean of their members' distances, that is, one
    less the product of their sums by both counts. Groups that are nearest to
    each other merge in the same round, which gives the tree of merging one pair
    at a time, as no merge brings a third group nearer. Of equal distances the
    pair with the smaller ids is nearer; the merged group keeps the smaller id.
    """
    one = F.sqrt(F.aggregate("steps", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = topics.agg(F.max(one)).first()[0] or 1.0
    state = written(topics.select(F.col("topic_id").alias("idx"), F.lit(1).cast("bigint").alias("n"), F.transform("steps", lambda x: x.cast("bigint")).alias("sums"), F.lit(0.0).alias("height")))
    merges, turn = None, 0

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left["idx"].to_numpy(), right["idx"].to_numpy()
        if not len(a) or not len(b):
            return pa.table({"idx": pa.array([], pa.int64()), "height": pa.array([], pa.float64()), "low": pa.array([], pa.int64()), "high": pa.array([], pa.int64())})
        distance = 1 - (_matrix(left["sums"], width) @ _matrix(right["sums"], width).T) / (left["n"].to_numpy()[:, None] * right["n"].to_numpy() * unit**2)
        distance[a[:, None] == b] = np.inf
        low, high = np.minimum(a[:, None], b), np.maximum(a[:, None], b)
        # of the columns at the least distance, the pair of the smallest ids
        least = distance.min(axis=1)
        rows, columns = np.nonzero((distance == least[:, None]) & np.isfinite(least)[:, None])
        order = np.lexsort((high[rows, columns], low[rows, columns], rows))
        _, first = np.unique(rows[order], return_index=True)
        r, c = rows[order][first], columns[order][first]
        return pa.table({"idx": a[r], "height": least[r], "low": low[r, c], "high": high[r, c]})

    while True:
        tiles = state.withColumn("tile", F.floor(F.col("idx") / TILE).cast("int")).select("idx", "n", "sums", "tile")
        near = _by_tiles(tiles, nearest, "idx bigint, height double, low bigint, high bigint")
        near = written(near.groupBy("idx").agg(F.min(F.struct("height", "low", "high")).alias("e")).select("idx", "e.*"))
        if near.isEmpty():
            break
        mutual = near.where("idx = low").join(near.where("idx = high").select("low", "high"), ["low", "high"]).select("low", "high", F.col("height").alias("at"))
        gone = state.select(F.col("idx").alias("high"), F.col("n").alias("m"), F.col("sums").alias("more"), F.col("height").alias("other"))
        met = written(state.join(mutual.withColumnRenamed("low", "idx"), "idx").join(gone, "high"))
        height = F.greatest("at", "height", "other")
        new = met.select(F.lit(turn).alias("turn"), F.col("idx").alias("kept"), F.col("high").alias("absorbed"), height.alias("height"))
        merges, turn = new if merges is None else merges.union(new), turn + 1
        merged = met.select("idx", (F.col("n") + F.col("m")).alias("n"), F.zip_with("sums", "more", lambda x, y: x + y).alias("sums"), height.alias("height"))
        used = met.select("idx").union(met.select("high"))
        state = written(state.join(used, "idx", "left_anti").union(merged))
    if merges is None:
        return near.select(F.col("idx").alias("place"), F.col("low").alias("kept"), F.col("high").alias("absorbed"), "height")
    return numbered(merges, [F.col("height"), F.col("turn"), F.col("kept")], "place").select("place", "kept", "absorbed", "height")


def cut(topics: DataFrame, merges: DataFrame, k: int) -> DataFrame:
    """(topic_id, merged): where each topic is when the first merges leave k topics."""
    total = topics.count()
    if not 1 <= k <= total:
        raise ValueError("k is from 1 to the number of topics")
    into = _jump(merges.where(F.col("place") < total - k).select(F.col("absorbed").alias("node"), F.col("kept").alias("up")))
    return topics.select("topic_id").join(into.withColumnRenamed("node", "topic_id"), "topic_id", "left").select("topic_id", F.coalesce("root", "topic_id").alias("merged"))


def project(coverage: DataFrame, into: DataFrame) -> DataFrame:
    """Coverage (doc, topic_id, coverage) by merged topic, given (topic_id, merged); what merges adds up, the outlier topic stays."""
    return coverage.join(into, "topic_id", "left").groupBy("doc", F.coalesce("merged", "topic_id").alias("topic_id")).agg(F.sum("coverage").alias("coverage"))


def coverage(segments: DataFrame, memberships: DataFrame) -> DataFrame:
    """(doc, topic_id, coverage): what share of a document's characters each topic has, 1 together.

    segments: doc, segment, characters; memberships: segment, topic_id,
    membership. A segment without memberships is of the outlier topic -1; of a
    document without characters each segment counts alike.
    """
    weight = F.when(F.sum("characters").over(Window.partitionBy("doc")) > 0, F.col("characters")).otherwise(F.lit(1)).cast("double")
    parts = segments.select("doc", "segment", weight.alias("weight"))
    total = parts.groupBy("doc").agg(F.sum("weight").alias("total"))
    shared = parts.join(memberships, "segment", "left").select("doc", F.coalesce("topic_id", F.lit(-1)).alias("topic_id"), (F.col("weight") * F.coalesce("membership", F.lit(1.0))).alias("part"))
    sums = shared.groupBy("doc", "topic_id").agg(F.sum("part").alias("part"))
    return sums.join(total, "doc").select("doc", "topic_id", (F.col("part") / F.col("total")).alias("coverage"))


def terms(words: DataFrame, n: int) -> DataFrame:
    """(topic_id, place, term, occurrences, score): the n terms of each topic that set it apart most.

    words: topic_id and words (array). score: a term's share of its topic's
    words, by log(1 + mean words of a topic / the term's occurrences in all).
    Ties go by term. Counts are partial before they are shuffled, and only the
    best n of a partition are brought together.
    """
    counts = written(words.select("topic_id", F.explode("words").alias("term")).groupBy("topic_id", "term").agg(F.count("*").alias("occurrences")))
    sizes = counts.groupBy("topic_id").agg(F.sum("occurrences").alias("size"))
    mean = sizes.agg(F.avg("size").alias("mean"))
    every = counts.groupBy("term").agg(F.sum("occurrences").alias("every"))
    scored = counts.join(every, "term").join(sizes, "topic_id").crossJoin(F.broadcast(mean))
    score = F.col("occurrences") / F.col("size") * F.log(1 + F.col("mean") / F.col("every"))
    best = Window.partitionBy("topic_id").orderBy(F.desc("rounded"), "term")
    ranked = scored.withColumn("score", score).withColumn("rounded", F.round("score", 12)).withColumn("place", F.row_number().over(best)).where(F.col("place") <= n)
    return ranked.select("topic_id", F.col("place").cast("bigint").alias("place"), "term", "occurrences", F.col("rounded").alias("score"))
