"""The SQL surface: what it refuses, what it translates, and what it leaves behind."""

from __future__ import annotations

import pytest

from lexigrid.operators import sql, sql_plan


@pytest.fixture
def blocks(spark):
    words = spark.createDataFrame([(2, "Anna's", ["x", "y"], "b"), (1, "bea", ["x"], "a"), (3, None, None, "c")], "id bigint, name string, tags array<string>, key string")
    return {"words": words, "Other Block": spark.createDataFrame([("a", 1), ("b", 2)], "key string, n int")}


@pytest.mark.parametrize(
    "statement",
    [
        "SELECT * FROM scan_csv /* no bypass */ ('x')",
        "SELECT * FROM read_ndjson -- no bypass\n ('x')",
        "SELECT * FROM json.`/x`",
        "SELECT * FROM words JOIN `csv`.`/x` ON true",
        "SELECT * FROM words, text.`/x`",
        "SELECT (SELECT max(id) FROM hidden) FROM words",
        "SELECT * FROM (words JOIN hidden ON true)",
        "SELECT * FROM words UNION ALL SELECT * FROM hidden",
        "SELECT * FROM spark_catalog.default.words",
        "DROP VIEW words",
        "SELECT count(*) OVER hidden FROM hidden WINDOW hidden AS (ORDER BY id)",
        "SELECT id FROM words UNION ALL TABLE hidden",
        "WITH q AS (TABLE hidden) SELECT * FROM q",
        "WITH q AS (SELECT * FROM r), r AS (SELECT 1) SELECT * FROM q",
        "SELECT reflect('java.lang.System', 'getProperty', 'user.dir') FROM words",
        "SELECT java_method('java.lang.System', 'getProperty', 'user.dir') FROM words",
        "SELECT max(try_reflect('java.lang.System', 'getProperty', 'user.dir')) FROM words",
        "SELECT id FROM words WHERE id IN (SELECT id FROM IDENTIFIER('hid' || 'den'))",
        "SELECT TRANSFORM(id) USING 'cat' FROM words",
        "SELECT input_file_name() FROM words",
        "SELECT own_function(id) FROM words",
        "SELECT transform(tags, x -> reflect('java.lang.System', 'getProperty', x)) FROM words",
        "SELECT id FROM words LATERAL VIEW java_method('a', 'b') t AS x",
        "SELECT 1; SELECT 2",
        "",
    ],
)
def test_refused(spark, blocks, statement):
    spark.range(3).createOrReplaceTempView("hidden")
    spark.udf.register("own_function", lambda x: x)
    with pytest.raises(ValueError):
        sql.run_sql(spark, blocks, statement)


@pytest.mark.parametrize(
    ("statement", "rows"),
    [
        ("SELECT name FROM words WHERE name ~* '^a.*' ORDER BY 1", [("Anna's",)]),
        ("SELECT name FROM words WHERE name !~ '^A'", [("bea",)]),
        ("SELECT id FROM words WHERE name = 'Anna''s'", [(2,)]),
        ("SELECT id FROM words WHERE name ~ '\\w{5}'", []),
        ("SELECT \"words\".id, t.tag FROM words, UNNEST(tags) AS t(tag) ORDER BY 1, 2", [(1, "x"), (2, "x"), (2, "y")]),
        ("SELECT w.id, t.tag FROM words AS w CROSS JOIN UNNEST(w.tags) AS t(tag) WHERE w.id = 1", [(1, "x")]),
        ("SELECT UNNEST(tags) AS tag FROM words ORDER BY tag", [("x",), ("x",), ("y",)]),
        ("SELECT STRFTIME(DATE '2024-03-05', '%d/%m/%Y') AS t FROM words LIMIT 1", [("05/03/2024",)]),
        ("SELECT id, ROW_NUMBER() OVER () - 1 AS i FROM words ORDER BY i", [(1, 0), (2, 1), (3, 2)]),
        ("SELECT id, COUNT(*) OVER () AS n FROM words WHERE id = 1", [(1, 1)]),
        ("SELECT l.id, r.n FROM words l JOIN \"Other Block\" r ON l.key = r.key ORDER BY 1", [(1, 1), (2, 2)]),
        ("WITH t AS (SELECT key FROM words), u AS (SELECT key FROM t WHERE key IS DISTINCT FROM 'a') SELECT COUNT(*) AS n FROM u", [(2,)]),
        ("SELECT EXTRACT(YEAR FROM DATE '2024-03-05') AS y, TRIM(BOTH 'x' FROM 'xax') AS t FROM words WHERE id = 1", [(2024, "a")]),
        ("SELECT 'from hidden; read_csv(' AS t FROM words WHERE id IN (1, 3) -- from hidden", [("from hidden; read_csv(",)] * 2),
    ],
)
def test_translated(spark, blocks, statement, rows):
    assert [tuple(r) for r in sql.run_sql(spark, blocks, statement, ordinal="id").collect()] == rows


def test_nothing_stays_bound(spark, blocks):
    before = {t.name for t in spark.catalog.listTables()}
    sql.run_sql(spark, blocks, "SELECT 1 AS x FROM words")
    assert {t.name for t in spark.catalog.listTables()} == before
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"


def test_created_blocks(spark, blocks):
    made = sql.create_block(spark, blocks, "SELECT key, COUNT(*) AS n FROM words GROUP BY key", " counts ")
    assert made.name == "counts" and made.parents == ("words", "Other Block") and made.frame.count() == 3
    for statement, name in (("SELECT id, id FROM words", "x"), ("SELECT id FROM words", " "), ("SELECT id FROM words", "words")):
        with pytest.raises(ValueError):
            sql.create_block(spark, blocks, statement, name)


def test_plans_are_looked_through(spark):
    rich = "SELECT a, rank() OVER (ORDER BY a) FROM v WHERE EXISTS (SELECT 1 FROM v w WHERE w.a = v.a) GROUP BY a HAVING count(*) > 1 ORDER BY a LIMIT 3 OFFSET 1"
    for statement in ("SELECT abs(a) FROM v", rich, "SELECT explode(a) FROM v INTERSECT SELECT DISTINCT b FROM VALUES (1) AS t(b)"):
        sql_plan.check(spark, statement, {"v"})
    other = spark.newSession()
    other.udf.register("upper", lambda x: x)
    with pytest.raises(ValueError, match="not allowed"):
        sql_plan.check(other, "SELECT upper(a) FROM v", {"v"})
