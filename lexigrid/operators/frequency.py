"""Tokens, their frequencies, and keyness of one corpus against another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.text import literal, matches

#: Words are runs of letters, marks, digits and underscores, after lower-casing.
WORD = r"[\p{L}\p{M}\p{N}_]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


#: Tokenizers by name, each from a text to an array of tokens; one's own are added here.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "words": words,
    "whitespace": lambda text: F.filter(F.split(text, r"(?U)\s+"), lambda t: t != ""),
    "characters": lambda text: F.regexp_extract_all(text, F.lit(r"(?U)\S"), F.lit(0)),
}


def tokenize(text: Column) -> Column:
    """Array of (token, start, end); places are code points of the text."""
    return F.transform(matches(text, WORD), lambda m: F.struct(F.lower(m["value"]).alias("token"), m["start"].cast("bigint").alias("start"), m["end"].cast("bigint").alias("end")))


def token_frequency(df: DataFrame, text: str, tokenizer: str = "words") -> DataFrame:
    """(token, frequency, per_million), the most frequent first; tokenizer: a name in TOKENIZERS."""
    counts = df.select(F.explode(TOKENIZERS[tokenizer](F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("frequency"))
    total = counts.agg(F.sum("frequency").alias("all_tokens"))  # one row
    per_million = F.round(F.col("frequency") / F.col("all_tokens") * 1_000_000).cast("bigint")
    return counts.crossJoin(F.broadcast(total)).select("token", "frequency", per_million.alias("per_million")).orderBy(F.desc("frequency"), "token")


def without_stop_words(counts: DataFrame, stop_words: list[str]) -> DataFrame:
    return counts.where(~F.lower("token").isin([w.lower() for w in stop_words])) if stop_words else counts


def token_wildcard(counts: DataFrame, pattern: str) -> DataFrame:
    """``*`` any run, ``?`` any character; anchored, case folded."""
    body = "".join(".*" if c == "*" else "." if c == "?" else literal(c) for c in pattern)
    return counts.where(F.rlike("token", F.lit(f"(?iu)^{body}$")))


def keyness(study: DataFrame, reference: DataFrame) -> DataFrame:
    """Statistics of two tables (token, frequency); S is the study, R the reference.

    A token absent from one side counts zero there. Undefined ratios are null,
    infinite ones infinite.
    """
    s = study.select("token", F.col("frequency").alias("s"))
    r = reference.select("token", F.col("frequency").alias("r"))
    totals = s.agg(F.sum("s").alias("ns")).crossJoin(r.agg(F.sum("r").alias("nr")))  # one row
    both = s.join(r, "token", "full").select("token", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "sr")).crossJoin(F.broadcast(totals))
    n = F.col("ns") + F.col("nr")
    part = lambda o, e: F.when(o > 0, o * F.ln(o / e)).otherwise(0.0)
    ratio = lambda a, b: F.when(b == 0, F.when(a > 0, F.lit(float("inf")))).otherwise(F.try_divide(a, b))
    half = lambda c, total: F.when(c == 0, F.lit(0.5)).otherwise(c) / total
    S, R = F.col("s"), F.col("r")  # noqa: N806
    step = both.withColumns({"es": F.col("ns") * (S + R) / n, "er": F.col("nr") * (S + R) / n, "ps": S / F.col("ns") * 100, "pr": R / F.col("nr") * 100})
    step = step.withColumn("ll", 2 * (part(S, F.col("es")) + part(R, F.col("er"))))
    least = F.ln(F.least("es", "er"))
    level = F.when(F.col("ll") >= 15.13, "****").when(F.col("ll") >= 10.83, "***").when(F.col("ll") >= 6.63, "**").when(F.col("ll") >= 3.84, "*").otherwise("n.s.")
    return step.select(
        "token",
        S.cast("bigint").alias("freq_study"),
        R.cast("bigint").alias("freq_reference"),
        F.col("ps").alias("percent_study"),
        F.col("pr").alias("percent_reference"),
        F.col("es").alias("expected_study"),
        F.col("er").alias("expected_reference"),
        F.col("ll").alias("log_likelihood_llv"),
        ((F.col("ps") - F.col("pr")) / F.when(F.col("pr") == 0, F.lit(1e-18)).otherwise(F.col("pr")) * 100).alias("percent_diff"),
        (F.col("ll") - F.ln(n)).alias("bayes_factor_bic"),
        F.when(least != 0, F.try_divide(F.col("ll"), n * least)).alias("effect_size_ell"),
        ratio(F.col("ps"), F.col("pr")).alias("relative_risk"),
        F.log2(half(S, F.col("ns")) / half(R, F.col("nr"))).alias("log_ratio"),
        ratio(S * (F.col("nr") - R), R * (F.col("ns") - S)).alias("odds_ratio"),
        level.alias("significance"),
        (F.col("ps") > F.col("pr")).alias("overuse"),
    )
