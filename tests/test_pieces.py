"""Texts become Python objects a piece at a time, whatever the batch."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa
import pytest

from lexigrid.functions import text
from lexigrid.operators import frequency, kwic, quotations


def test_pieces_hold_all_rows_in_order(monkeypatch):
    texts = pa.array(["ab", None, "", "abcdef", "é", "x" * 50, None])
    for budget in (1, 4, 1000):
        ranges = list(text.pieces(texts, budget))
        assert [i for a, b in ranges for i in range(a, b)] == list(range(7))
    assert len(list(text.pieces(texts, 1000))) == 1 and list(text.pieces(texts[:0])) == []
    monkeypatch.setattr(text, "PIECE", 4)
    double = lambda a: pa.array([None if x is None else x * 2 for x in a.to_pylist()], pa.string())
    assert text.by_pieces(double, texts).to_pylist() == double(texts).to_pylist()
    assert text.by_pieces(double, texts[:0]).to_pylist() == []


def peak_mb(monkeypatch, column, *arrays) -> float:
    """MB of Python objects at most, while the function behind an Arrow column works through a batch."""
    taken = []
    monkeypatch.setattr(text, "PIECE", 1 << 13, raising=False)
    monkeypatch.setattr(column[0].F, "arrow_udf", lambda f, shape: taken.append(f) or (_ for _ in ()).throw(InterruptedError))
    with pytest.raises(InterruptedError):
        column[1]()
    tracemalloc.start()
    try:
        taken[0](*arrays)
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


LONG = pa.array(["the cat of the house and the dog of it " * 20] * 300)


def test_matches_of_a_batch_are_not_all_objects_at_once(spark, monkeypatch):
    assert peak_mb(monkeypatch, (text, lambda: text.matches(text.F.col("t"), r"\w+")), LONG) < 8


def test_tokens_of_a_batch_are_not_all_objects_at_once(spark, monkeypatch):
    words = LONG[0].as_py().split()
    row, at = [], 0
    for w in words:
        row.append({"token": w, "start": at, "end": at + len(w)})
        at += len(w) + 1
    kind = pa.list_(pa.struct([("token", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    df = spark.createDataFrame([("a",)], "t string").withColumn("tokens", frequency.tokenize(text.F.col("t")))
    listed = pa.array([row] * len(LONG), kind)
    assert peak_mb(monkeypatch, (kwic, lambda: kwic.concordance_tokens(df, "t", "tokens", "the", 2, 2)), LONG, listed) < 8


def test_hits_of_a_batch_are_not_all_objects_at_once(spark, monkeypatch):
    df = spark.createDataFrame([("a",)], "t string")
    for contexts in (True, False):
        assert peak_mb(monkeypatch, (kwic, lambda c=contexts: kwic.concordance(df, "t", "the", 3, 3, contexts=c)), LONG) < 8


def test_tokens_beside_nulls_and_other_rows(spark, monkeypatch):
    """By batches of one row and of all, null and empty texts and token lists among them."""
    for piece in (1, 1 << 18):
        monkeypatch.setattr(text, "PIECE", piece)
        df = spark.createDataFrame([(1, "The end"), (2, None), (3, ""), (4, "of the of"), (5, "none")], "id int, t string").coalesce(1).withColumn("tokens", frequency.tokenize(text.F.col("t")))
        assert [r.tokens for r in df.where("id in (2, 3)").orderBy("id").collect()] == [None, []]
        rows = kwic.concordance_tokens(df, "t", "tokens", "THE, of", 1, 1).orderBy("id").collect()
        assert [(r.id, [tuple(h) for h in r.hits]) for r in rows] == [
            (1, [("", "The", " end", 0, 3, "", "end")]),
            (4, [("", "of", " the", 0, 2, "", "the"), ("of ", "the", " of", 3, 6, "of", "of"), ("the ", "of", "", 7, 9, "the", "")]),
        ]


def test_quotations_leave_a_batch_in_pieces(spark, monkeypatch):
    """Batches that leave Python hold a piece of text each, and all rows in their order."""
    monkeypatch.setattr(text, "PIECE", 1 << 10, raising=False)
    texts = [None, "", *(f'"Number {i} is here, and so is this," said Anna Berg.' for i in range(200))]
    taken = []
    df = spark.createDataFrame([(1, "a")], "id bigint, t string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, shape: taken.append(f))
    quotations.extract(df, "t")
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["id", "t"])
    out = list(taken[0](iter([batch])))
    assert max(b.num_rows for b in out) < 40
    rows = pa.Table.from_batches(out).to_pylist()
    assert [(r["id"], r["t"]) for r in rows] == list(enumerate(texts))
    assert [len(r["quotation"]) for r in rows] == [0, 0] + [1] * 200
