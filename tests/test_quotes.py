"""Quotations by rule, on texts of our own."""

from __future__ import annotations

from lexigrid.operators import quotes


def test_speaker_verb_and_order(spark):
    rows = [(1, 'Then "We will go," said Anna Berg.'), (2, 'Mr Holt warned: "Do not go."'), (3, "no quotes"), (4, None)]
    found = quotes.quote_rows(quotes.find_quotes(spark.createDataFrame(rows, "id bigint, text string"), "text")).collect()
    by_id = {r.id: r for r in found}
    assert set(by_id) == {1, 2}
    assert (by_id[1].QUOTE_speaker, by_id[1].QUOTE_verb, by_id[1].QUOTE_quote_type) == ("Anna Berg", "said", "QVS")
    assert (by_id[2].QUOTE_verb, by_id[2].QUOTE_quote_type) == ("warned", "SVQ")
    text = dict(rows)[1]
    assert text[by_id[1].QUOTE_quote_start : by_id[1].QUOTE_quote_end] == by_id[1].QUOTE_quote
