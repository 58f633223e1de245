"""Every registered query outside the corpus operators against its SQL, and the contract of the entry file."""

from __future__ import annotations

import sys

import pytest

import __spark_entry__
from lexigrid.plans import catalog
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def con(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(name, spark, tiny, con):
    assert_same(catalog.QUERIES[name](spark, tiny), con, catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(name, spark, tiny):
    found = catalog.QUERIES[name](spark, tiny)
    assert found.columns and (found.count() > 0 or name == "quote_heuristic")  # the tables hold no quotation marks


def test_entry_has_a_stable_schema(spark):
    first, again = __spark_entry__.entry(spark), __spark_entry__.entry(spark)
    assert first.schema == again.schema
    assert first.count() > 0


def test_sql_names_are_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_imports_without_the_corpus_operators(monkeypatch):
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("lexigrid.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "lexigrid.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    import __spark_entry__ as bare

    assert set(bare.queries()) == set(catalog.QUERIES)
    assert set(bare.oracle_sql()) == set(catalog.ORACLE_SQL)
