"""What follows a topic model: merging topics, ranks, activations, colours and examples.

Coverage is kept in long form (doc, topic_id, coverage); -1 is the outlier topic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.functions.shared import durable


def cut_merges(topics: list[int], merges: list[tuple[int, int]], k: int) -> dict[int, int]:
    """Topic to merged topic, when the first merges (kept, absorbed) leave k topics."""
    if not 1 <= k <= len(topics):
        raise ValueError("k is from 1 to the number of topics")
    into = {t: t for t in topics}
    for kept, gone in merges[: len(topics) - k]:
        into = {t: (kept if m == gone else m) for t, m in into.items()}
    return into


def project(coverage: DataFrame, into: dict[int, int]) -> DataFrame:
    """Coverage by merged topic; what merges adds up, the outlier topic stays."""
    pairs = F.create_map(*(F.lit(x) for pair in into.items() for x in pair))
    topic = F.coalesce(F.try_element_at(pairs, F.col("topic_id")), F.col("topic_id"))
    return coverage.groupBy("doc", topic.alias("topic_id")).agg(F.sum("coverage").alias("coverage"))


def ranks(coverage: DataFrame) -> DataFrame:
    """Rank of each real topic with positive coverage within its document; ties share one."""
    real = coverage.where((F.col("topic_id") >= 0) & (F.col("coverage") > 0))
    return real.withColumn("rank", F.rank().over(Window.partitionBy("doc").orderBy(F.desc("coverage"))))


def top_n(coverage: DataFrame, n: int) -> DataFrame:
    return ranks(coverage).where(F.col("rank") <= n)


def activations(coverage: DataFrame, corpus: Column) -> DataFrame:
    """(corpus, topic_id, minimum_n, documents)."""
    return ranks(coverage).groupBy(corpus.alias("corpus"), "topic_id", F.col("rank").alias("minimum_n")).agg(F.count("*").alias("documents"))


def colors(coverage: DataFrame, documents: DataFrame, group: str, n: int = 1) -> DataFrame:
    """Documents of each topic by a group of 2 to 8 values; missing ones are last, as ``(missing)``."""
    value = F.coalesce(F.col(group).cast("string"), F.lit("(missing)"))
    found = documents.select("doc", value.alias("value"))
    if not 2 <= found.select("value").distinct().limit(9).count() <= 8:
        raise ValueError("the group needs 2 to 8 values")
    return top_n(coverage, n).join(found, "doc").groupBy("topic_id", "value").agg(F.count("*").alias("documents"))


def examples(coverage: DataFrame, per_topic: int, seed: int | None = None) -> DataFrame:
    """The documents of highest coverage of each topic, or seeded random ones, with the percentile of their coverage."""
    real = coverage.where((F.col("topic_id") >= 0) & (F.col("coverage") > 0))
    order = [F.desc("coverage"), F.asc("doc")] if seed is None else [F.xxhash64(F.lit(seed), "doc"), F.asc("doc")]
    # only the best of each partition of a topic are brought together
    best = durable(real.withColumn("place", F.row_number().over(Window.partitionBy("topic_id").orderBy(*order))).where(F.col("place") <= per_topic))
    levels = real.groupBy("topic_id", F.col("coverage").alias("level")).agg(F.count("*").alias("n"))
    sought = best.select("topic_id", "coverage").distinct()
    under = sought.join(levels, "topic_id").groupBy("topic_id", "coverage").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("level") < F.col("coverage"), F.col("n")).otherwise(0)).alias("below"))
    percentile = F.round(100 * F.coalesce(F.try_divide(F.col("below"), F.col("all") - 1), F.lit(0.0)), 6)
    return best.join(under, ["topic_id", "coverage"]).select(*(f"`{c}`" for c in coverage.columns), percentile.alias("percentile"), "place")


def segment_lengths(counts: str, shares: tuple[float, ...] = (0.5, 0.9, 0.95, 1.0)) -> list[Column]:
    """Nearest-rank percentiles of token counts."""
    name = lambda p: f"p{round(p * 100)}"
    return [F.expr(f"percentile_disc({p}) within group (order by {counts})").alias(name(p)) for p in shares]


def unspaced_share(df: DataFrame, text: str) -> DataFrame:
    """Share of letters in scripts without spaces, and whether a dictionary tokenizer is due (a fifth or more)."""
    t = F.col(text)
    share = F.try_divide(F.sum(F.regexp_count(t, F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"))), F.sum(F.regexp_count(t, F.lit(r"\p{L}"))))
    return df.agg(F.coalesce(share, F.lit(0.0)).alias("share")).withColumn("dictionary", F.col("share") >= 0.2)


def add_topics(segments: DataFrame) -> DataFrame:
    """One row for each document and topic: joined segments, share of characters, number.

    segments: doc, position, topic_id, text.
    """
    joined = segments.groupBy("doc", "topic_id").agg(F.expr("listagg(text, '\n') within group (order by position)").alias("text"), F.sum(F.length("text")).alias("characters"), F.count("*").alias("segments"))
    total = F.sum("characters").over(Window.partitionBy("doc"))
    return joined.withColumn("share", F.round(F.try_divide(F.col("characters").cast("double"), total), 6))


def with_coverage_array(coverage: DataFrame) -> DataFrame:
    """(doc, coverage): arrays of (topic_id, coverage), the outlier first."""
    pair = F.struct("topic_id", "coverage")
    return coverage.groupBy("doc").agg(F.array_sort(F.collect_list(pair)).alias("coverage"))


def fingerprint(df: DataFrame, ordinal: str, text: str) -> DataFrame:
    """One hash of the ordered documents; it changes if any text or their order does."""
    each = F.xxhash64(F.col(ordinal), F.col(text))
    return df.agg(F.count("*").alias("documents"), F.bit_xor(each).alias("xor"), F.sum(each.cast(T.DecimalType(38, 0))).cast("string").alias("sum"))
