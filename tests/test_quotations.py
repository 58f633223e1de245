"""Quotations with all fields: types, places in the original, previews, and runs that break."""

from __future__ import annotations

import pytest

from lexigrid.operators import quotations

CASES = [
    ('"We will act," said the minister.', [("QCQVS", '"We will act,"', "the minister", "said")]),
    ('“We will act,”  the minister said.', [("QCQSV", '“We will act,”', "the minister", "said")]),
    ('The minister said, "We will act."', [("SVQCQ", '"We will act."', "The minister", "said")]),
    ("The minister said the government would act.", [("SVC", "the government would act", "The minister", "said")]),
    ("The government would act, the minister said.", [("CSV", "The government would act", "the minister", "said")]),
    ("The government would act, said Anna Berg.", [("CVS", "The government would act", "Anna Berg", "said")]),
    ("According to Anna Berg, the government will act.", [("AccordingTo", "the government will act", "Anna Berg", "According to")]),
    ('According to Anna Berg, "nobody knows".', [("AccordingTo", '"nobody knows"', "Anna Berg", "According to")]),
    ('"We will act," said Anna Berg. "Nobody else will."', [("QCQVS", '"We will act,"', "Anna Berg", "said"), ("QCQ", '"Nobody else will."', "Anna Berg", None)]),
    ('A sign read "closed today" there.', [("Heuristic", '"closed today"', None, None)]),
    ('One "mark only.\n\nAnna Berg replied: "Yes­ indeed."', [("SVQCQ", '"Yes­ indeed."', "Anna Berg", "replied")]),
    ('"One. The minister said the state would act. Two," said Anna Berg.', [("QCQVS", '"One. The minister said the state would act. Two,"', "Anna Berg", "said")]),
    ("Nothing here at all.", []),
    ("", []),
    (" \n ", []),
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_types_and_parts(text, expected):
    found = quotations.parse(text)
    assert [(q["quote_type"], q["quote"], q["speaker"], q["verb"]) for q in found] == expected
    for i, q in enumerate(found):
        assert q["quote_row_idx"] == i and q["is_floating_quote"] == (q["quote_type"] == "QCQ") and len(q) == 13
        for part in ("quote", "speaker", "verb"):
            if q[part] is not None:
                assert text[q[f"{part}_start_idx"] : q[f"{part}_end_idx"]] == q[part]


def test_places_lead_back_to_the_original():
    """Each character of the normalised text is that of its place, or stands for a run that begins there."""
    text = " a \n\n b c​d “e” f\t\tg­­h„ "
    clean, places = quotations.normalized(text)
    assert clean == ' a\nb cd "e" f gh" ' and len(places) == len(clean) + 1 and places[-1] == len(text)
    assert places == sorted(places)
    for c, at in zip(clean, places, strict=False):
        assert c == text[at] or c == '"' or text[at].isspace()


def docs_of(spark, n=40):
    rows = [(i, f'Line {i % 7}. "We will act," said Anna Berg.' if i % 5 == 0 else None if i % 11 == 1 else f"plain {i}") for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, text string"), rows


def test_preview_reads_no_more_than_it_needs(spark):
    docs, rows = docs_of(spark)
    page, after, read = quotations.preview(docs, "id", "text", 3, first=4, growth=2)
    assert [r.id for r in page.collect()] == [0, 5, 10] and after == 10 and read == 11
    page, after, read = quotations.preview(docs, "id", "text", 3, after=after, first=4, growth=2)
    assert [r.id for r in page.collect()] == [15, 20, 25] and after == 25
    page, after, read = quotations.preview(docs, "id", "text", 9, after=25)
    assert [r.id for r in page.collect()] == [30, 35] and read == 14
    assert quotations.preview(docs.where("id < 0"), "id", "text", 9)[0].count() == 0


def test_a_broken_run_goes_on(spark, tmp_path, monkeypatch):
    docs, rows = docs_of(spark)
    whole = {(r.id, r.quotation[0].quote) for r in quotations.run(docs, "text", str(tmp_path / "whole"), parts=4).collect()}
    assert {i for i, _ in whole} == {i for i, t in rows if t and "Anna" in t}
    parsed = []
    extract = quotations.extract

    def breaking(df, text, limit):
        if len(parsed) == limit:
            raise RuntimeError("lost")
        parsed.append(sorted(r.digest for r in df.collect()))
        return extract(df, text)

    place = str(tmp_path / "broken")
    monkeypatch.setattr(quotations, "extract", lambda df, text: breaking(df, text, 2))
    with pytest.raises(RuntimeError, match="lost"):
        quotations.run(docs, "text", place, parts=4)
    assert len(quotations.finished(docs, place)) == 2
    monkeypatch.setattr(quotations, "extract", lambda df, text: breaking(df, text, 99))
    again = quotations.run(docs, "text", place, parts=4)
    assert {(r.id, r.quotation[0].quote) for r in again.collect()} == whole
    digests = [d for part in parsed for d in part]
    assert len(digests) == len(set(digests)) == len({t for _, t in rows if t})
    n = len(parsed)
    assert quotations.run(docs, "text", place, parts=4).count() == len(whole) and len(parsed) == n
    assert quotations.run(docs.where("id < 0"), "text", str(tmp_path / "none")).count() == 0


def test_rows_carry_prefixed_fields(spark):
    docs, _ = docs_of(spark, 1)
    found = quotations.add(quotations.extract(docs.withColumn("QUOTE_verb", docs.text), "text"))
    assert len(found.columns) == 15 and found.first().QUOTE_verb == "said"
