"""Keywords in context on small texts of our own."""

from __future__ import annotations

import pytest

from lexigrid.operators import kwic
from lexigrid.plans import analyses


def hits(spark, text, search, *args, **options):
    df = spark.createDataFrame([(1, text), (2, None), (3, " ")], "id bigint, text string")
    rows = kwic.concordance(df, "text", search, *args, **options).collect()
    return [tuple(h)[:7] for h in rows[0].hits] if rows else []


def test_contexts_are_slices_of_the_text(spark):
    assert hits(spark, "One two, three (four) five - six.", "three", 2, 2) == [("One two, ", "three", " (four) five", 9, 14, "two", "four")]
    assert hits(spark, "three", "three", 2, 2) == [("", "three", "", 0, 5, "", "")]
    assert hits(spark, "a \U0001f600 bé three c", "THREE", 1, 1) == [("bé ", "three", " c", 7, 12, "bé", "c")]
    assert hits(spark, "nothing", "three") == []


@pytest.mark.parametrize("gap", [" ", " " * 500, " -- " * 200])
def test_contexts_longer_than_the_first_look(spark, gap):
    long = "x" * 400
    text = f"far{gap}{long}{gap}key{gap}{long}{gap}far"
    ((left, value, right, *_),) = hits(spark, text, "key", 2, 2)
    assert (left, value, right) == (f"far{gap}{long}{gap}", "key", f"{gap}{long}{gap}far")


def test_whole_words_and_punctuation(spark):
    assert len(hits(spark, "the other the", "the", whole_word=True)) == 2
    assert hits(spark, "a, b ! c", "b", 2, 2, ignore_punctuation=False)[0][:3] == ("a, ", "b", " ! c")


def test_a_search_of_text_brings_the_contexts_of_its_hits(spark, tmp_path):
    spark.createDataFrame([(1, "Of all, the best - and The"), (2, None), (3, "other")], "doc_id bigint, text string").withColumn("lang", analyses.F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    found = analyses.kwic_text(spark, str(tmp_path))
    assert found.columns == ["doc_id", "match_index", "left_context", "matched_text", "right_context", "start_idx", "end_idx", "l1", "r1"]
    assert sorted(map(tuple, found.collect())) == [
        (1, 0, "Of all, ", "the", " best - and The", 8, 11, "all", "best"),
        (1, 1, "the best - and ", "The", "", 23, 26, "and", ""),
    ]
