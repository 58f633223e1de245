"""Cleaners, splits, replacements and segments on texts of our own."""

from __future__ import annotations

import pytest

from lexigrid.operators import edits, groups, segments


def one(spark, text):
    return spark.createDataFrame([(text,)], "t string")


@pytest.mark.parametrize(
    ("how", "text", "clean"),
    [
        ("remove_html_tags", "a < b > c <p title='x'>d</p><!-- e -->", "a  c d"),
        ("remove_html_tags", "1 <> 2 < 3", "1 <> 2 < 3"),
        ("remove_xml_tags", "<?xml version='1.0'?><!DOCTYPE a [<!ENTITY b 'c'>]><a x='1>2'>t &amp;lt; <![CDATA[<raw>]]></a><!-- - -->", "t &lt; "),
        ("remove_xml_tags", "1 < 2 and <1> stay", "1 < 2 and <1> stay"),
        ("title_case", "it's  A\u001fb\tÉTÉ x", "It's  A\u001fb\tÉté X"),
    ],
)
def test_cleaners(spark, how, text, clean):
    assert edits.clean(one(spark, text), "t", how).first().t == clean


def test_texts_with_control_characters_stay_as_they_are(spark):
    text = "a\u001fb,c\u001e,d"
    assert tuple(edits.split(one(spark, text), "t", [","], ["x", "y"]).first()) == (text, "a\u001fb", "c\u001e,d")
    assert edits.replace(one(spark, text), "t", ",", ";", limit=1).first().t == "a\u001fb;c\u001e,d"
    assert [r.t for r in segments.segment_pattern(one(spark, text), "t", ",").collect()] == ["a\u001fb", "c\u001e", "d"]


def test_sentences_keep_their_closing_marks(spark):
    text = 'He said "Go." Then (we left!) And… "what?!"\n\nNo 3.5 end'
    rows = segments.segment(one(spark, text), "t", "sentence").orderBy("segment").collect()
    assert [r.t for r in rows] == ['He said "Go."', "Then (we left!)", "And…", '"what?!"', "No 3.5 end"]
    assert [r.segment for r in rows] == [1, 2, 3, 4, 5]


def test_more_groups_than_allowed_are_refused(spark):
    df = spark.range(60)
    with pytest.raises(ValueError):
        groups.split_groups(df, df.id)
    assert groups.split_groups(df, df.id % 50).count() == 50
