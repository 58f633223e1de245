"""One row for each piece of a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.text import trim, unicode_pattern

# What ends a sentence, with the closing marks that stay with it.
SENTENCE_END = r"[.!?\u2026]+[\"'\u201d\u2019)\]]*"
#: Between paragraphs a blank line, between lines a line end.
EDGES = {"paragraph": r"\r?\n[ \t]*(?:\r?\n[ \t]*)+", "line": r"\r?\n|\r"}


def _pieces(df: DataFrame, column: str, parts) -> DataFrame:
    kept = F.filter(F.transform(parts, trim), lambda p: p != "")
    rows = df.select("*", F.posexplode(kept).alias("__at", "__piece"))
    return rows.withColumn(column, F.col("__piece")).withColumn("segment", (F.col("__at") + 1).cast("bigint")).drop("__at", "__piece")


def segment(df: DataFrame, column: str, unit: str) -> DataFrame:
    """Pieces are trimmed, blank ones dropped, and numbered from 1 in each row (``segment``)."""
    if "segment" in df.columns:
        raise ValueError("column 'segment' exists")
    text = F.col(column)
    if unit != "sentence":
        return _pieces(df, column, F.split(text, EDGES[unit], -1))
    # each end goes back behind the piece it closes
    edge = rf"(?U){SENTENCE_END}\s+"
    ends = F.concat(F.regexp_extract_all(text, F.lit(edge), F.lit(0)), F.array(F.lit("")))
    return _pieces(df, column, F.zip_with(F.split(text, edge, -1), ends, lambda piece, end: F.concat(piece, end)))


def segment_pattern(df: DataFrame, column: str, pattern: str, lead_column: str | None = None) -> DataFrame:
    """Each match starts a piece; text before the first one is kept with a null lead.

    The match goes to ``lead_column``, without trailing colons, or is dropped.
    """
    found = unicode_pattern(pattern)
    leads = F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(F.col(column), F.lit(found), F.lit(0)))
    shown = lambda lead: trim(F.regexp_replace(lead, r"[:\s]+$", ""))
    parts = F.zip_with(F.split(F.col(column), found, -1), leads, lambda piece, lead: F.struct(shown(lead).alias("lead"), trim(piece).alias("piece")))
    kept = F.filter(parts, lambda p: p["piece"] != "")
    rows = df.select("*", F.posexplode(kept).alias("__at", "__p"))
    rows = rows.withColumn(column, F.col("__p.piece")).withColumn("segment", (F.col("__at") + 1).cast("bigint"))
    if lead_column:
        rows = rows.withColumn(lead_column, F.col("__p.lead"))
    return rows.drop("__at", "__p")
