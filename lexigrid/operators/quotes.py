"""Quotations by rule: quoted text with a reporting verb and a speaker beside it.

The reference analysis parses sentences with a language model that is not at
hand; this is the regular-expression subset: direct quotes in double quotation
marks, ``according to``, and the order of quote (Q), verb (V) and speaker (S).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.text import matches

#: Reporting verbs.
VERBS = ("said", "says", "say", "told", "tells", "asked", "asks", "added", "adds", "wrote", "writes", "replied", "claimed", "claims", "announced", "argued", "argues", "explained", "explains", "insisted", "noted", "notes", "stated", "states", "warned", "warns")
_VERB = "(?:" + "|".join(VERBS) + ")"
_NAME = r"(?:\p{Lu}[\p{L}'-]*(?: \p{Lu}[\p{L}'-]*){0,3}|he|she|they|He|She|They)"
QUOTE = r"[\"“«][^\"“”«»]{2,}[\"”»]"


def find_quotes(df: DataFrame, text: str) -> DataFrame:
    """df with quotes: (quote, quote_start, quote_end, speaker, verb, quote_type); rows without any are dropped.

    Rows are worked through where they are: that costs less than to bring equal
    texts together and their quotations back.
    """
    t = F.col(text)
    after = lambda m: t.substr(m["end"] + 1, F.lit(80))
    before = lambda m: F.substring(t, F.greatest(m["start"] - 80, F.lit(0)) + 1, F.least(m["start"], F.lit(80)))
    qvs, qsv = rf"^[,.]?\s*({_VERB})\s+({_NAME})", rf"^[,.]?\s*({_NAME})\s+({_VERB})"
    svq, acc = rf"({_NAME})\s+({_VERB})[,:]?\s*$", rf"[Aa]ccording to ({_NAME}),?\s*$"

    def quote(m):
        a, b = after(m), before(m)
        kinds = (("QVS", a, qvs, 2, 1), ("QSV", a, qsv, 1, 2), ("SVQ", b, svq, 1, 2), ("AccordingTo", b, acc, 1, 0))
        pick = lambda f, other: F.coalesce(*(F.when(F.rlike(c, F.lit(p)), f(k, c, p, s, v)) for k, c, p, s, v in kinds), F.lit(other))
        return F.struct(
            m["value"].alias("quote"),
            m["start"].cast("bigint").alias("quote_start"),
            m["end"].cast("bigint").alias("quote_end"),
            pick(lambda k, c, p, s, v: F.regexp_extract(c, p, s), "").alias("speaker"),
            pick(lambda k, c, p, s, v: F.regexp_extract(c, p, v) if v else F.lit(""), "").alias("verb"),
            pick(lambda k, c, p, s, v: F.lit(k), "Heuristic").alias("quote_type"),
        )

    found = df.where(F.rlike(t, F.lit(QUOTE))).withColumn("__m", matches(t, QUOTE)).where(F.size("__m") > 0)
    return found.withColumn("quotes", F.transform("__m", quote)).drop("__m")


def quote_rows(result: DataFrame) -> DataFrame:
    """One row for each quotation, fields prefixed ``QUOTE_``."""
    rows = result.select(*(c for c in result.columns if c != "quotes"), F.explode("quotes").alias("q"))
    fields = ("quote", "quote_start", "quote_end", "speaker", "verb", "quote_type")
    return rows.select(*(c for c in rows.columns if c != "q"), *(F.col(f"q.{f}").alias(f"QUOTE_{f}") for f in fields))
