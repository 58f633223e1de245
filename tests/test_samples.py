"""What SQL cannot state, against plain Python: samples, the fingerprint of a corpus, the order of matches."""

from __future__ import annotations

import struct

import xxhash
from pyspark.sql import functions as F

from lexigrid.operators import rows, topics
from lexigrid.plans import analyses, tables


def spark_hash(*values) -> int:
    """Spark's xxhash64 of whole numbers and texts: each value's hash is the seed of the next."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64(struct.pack("<q", v) if isinstance(v, int) else v.encode(), seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def test_samples_are_the_first_by_hash(spark, tiny):
    keys = [r.c_custkey for r in tables.load(spark, tiny, "customer").select("c_custkey").collect()]
    order = tables.load(spark, tiny, "customer").select("c_custkey", rows._dealt("c_custkey", 7).alias("h")).collect()
    dealt = [r.c_custkey for r in sorted(order, key=lambda r: (r.h, r.c_custkey))]
    assert [r.c_custkey for r in tables.QUERIES["sample_n"](spark, tiny).collect()] == dealt[:25]
    assert [r.c_custkey for r in tables.QUERIES["sample_fraction"](spark, tiny).collect()] == dealt[: len(keys) // 10]


def test_fingerprint_of_a_corpus(spark, tiny):
    docs = tables.load(spark, tiny, "documents").select("doc_id", "text").collect()
    each = [spark_hash(r.doc_id, r.text) for r in docs if r.text is not None]
    found = topics.fingerprint(tables.load(spark, tiny, "documents").where("text is not null"), "doc_id", "text").first()
    xor = 0
    for h in each:
        xor ^= h
    assert (found.documents, found.xor, found.sum) == (len(each), xor, str(sum(each)))


def test_matches_are_in_the_order_asked_for(spark, tiny):
    matches = analyses.kwic.match_rows(analyses._hits(spark, tiny)).select("doc_id", "match_index", F.nullif(F.lower("l1"), F.lit("")).alias("l1")).collect()
    # falling by code points, empties last, then by row and place
    plain = sorted(matches, key=lambda r: (r.doc_id, r.match_index))
    plain.sort(key=lambda r: (r.l1 is not None, r.l1 or ""), reverse=True)
    assert [(r.doc_id, r.match_index) for r in analyses.QUERIES["result_sort"](spark, tiny).collect()] == [(r.doc_id, r.match_index) for r in plain]
