"""Registered queries of the table operators, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions import elapsed
from lexigrid.operators import casts, edits, expressions, filters, groups, pages, rows, segments, sql
from lexigrid.operators.expressions import call, col, lit
from lexigrid.operators.filters import Condition
from lexigrid.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if oracle:
            ORACLE_SQL[name] = oracle
        return function

    return keep


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Scans and pages


@query("scan_parquet", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_parquet(spark, d):
    return load(spark, d, "nation")


@query("normalize_dtypes", "SELECT cast(o_orderkey AS bigint) AS o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at, o_totalprice FROM orders")
def normalize_dtypes(spark, d):
    df, _ = tables.normalize_types(load(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"))
    return df.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("at"), "o_totalprice")


@query("table_page", "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 51 OFFSET 100")
def table_page(spark, d):
    return pages.table_page(load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey", 3, 50, "c_acctbal", True)


@query("file_page", "SELECT page_id, url FROM pages ORDER BY page_id LIMIT 21")
def file_page(spark, d):
    return pages.table_page(load(spark, d, "pages").select("page_id", "url"), "page_id", 1, 20)


# Rows

@query("clone", "SELECT * FROM region")
def clone(spark, d):
    return load(spark, d, "region").select("*")


@query("slice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 200")
def slice_(spark, d):
    return rows.slice_rows(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 200, 500)


@query("sample_fraction")
def sample_fraction(spark, d):
    return rows.sample(load(spark, d, "customer"), "c_custkey", 0.1, 7)


@query("sample_n")
def sample_n(spark, d):
    return rows.sample(load(spark, d, "customer"), "c_custkey", 25, 7)


@query("shuffle", "SELECT * FROM supplier")
def shuffle(spark, d):
    return rows.shuffle(load(spark, d, "supplier"), "s_suppkey", 11)


def _filter(name: str, table: str, columns: list[str], conditions: list[Condition], where: str, logic: str = "and") -> None:
    QUERIES[name] = lambda spark, d: filters.filter_rows(load(spark, d, table), conditions, logic).select(*columns)
    ORACLE_SQL[name] = f"SELECT {', '.join(columns)} FROM {table} WHERE {where}"


for _op, _sign in (("eq", "="), ("ne", "<>"), ("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    _filter(f"f_{_op}", "part", ["p_partkey", "p_size"], [Condition("p_size", _op, "25")], f"p_size {_sign} 25")
_filter("f_eq_text", "customer", ["c_custkey"], [Condition("c_mktsegment", "eq", "BUILDING")], "c_mktsegment = 'BUILDING'")
_filter("f_lte_day", "events", ["event_id"], [Condition("ts", "lte", "2024-01-15")], "ts < TIMESTAMP '2024-01-16'")
_filter("f_in", "nation", ["n_name"], [Condition("n_regionkey", "in", [1, 3])], "n_regionkey IN (1, 3)")
_filter("f_contains", "part", ["p_partkey", "p_type"], [Condition("p_type", "contains", "CONOM")], "contains(lower(p_type), 'conom')")
_filter("f_contains_regex", "documents", ["doc_id"], [Condition("text", "contains", r"licen[sc]ed? under", regex=True)], r"regexp_matches(text, '(?i)licen[sc]ed? under')")
_filter("f_starts_with", "documents", ["doc_id"], [Condition("text", "starts_with", "Th")], "starts_with(text, 'Th')")
_filter("f_ends_with", "documents", ["doc_id"], [Condition("text", "ends_with", ".")], "ends_with(text, '.')")
QUERIES["f_is_null"] = lambda spark, d: filters.filter_rows(load(spark, d, "documents").select("doc_id", F.nullif(F.replace("lang", F.lit("de"), F.lit(" ")), F.lit("fr")).alias("lang")), [Condition("lang", "is_null")]).select("doc_id")
ORACLE_SQL["f_is_null"] = "SELECT doc_id FROM documents WHERE lang IN ('de', 'fr')"
_filter("f_is_not_null", "documents", ["doc_id"], [Condition("lang", "is_not_null")], "lang IS NOT NULL AND trim(lang) <> ''")
_filter("f_between", "orders", ["o_orderkey"], [Condition("o_totalprice", "between", (1000, 50000))], "o_totalprice BETWEEN 1000 AND 50000")
_filter("f_between_days", "events", ["event_id"], [Condition("ts", "between", ("2024-01-05", "2024-01-09"))], "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10'")
_filter("f_negate", "customer", ["c_custkey"], [Condition("c_mktsegment", "in", ["BUILDING", "MACHINERY"], negate=True)], "NOT c_mktsegment IN ('BUILDING', 'MACHINERY')")
_filter("filter", "customer", ["c_custkey"], [Condition("c_acctbal", "gt", 5000), Condition("c_mktsegment", "eq", "AUTOMOBILE"), Condition("c_nationkey", "lt", 3)], "c_acctbal > 5000 OR c_mktsegment = 'AUTOMOBILE' OR c_nationkey < 3", "or")


@query("f_elapsed", "SELECT event_id FROM events WHERE epoch_us(ts) % 86400000000 >= 3600000000")
def f_elapsed(spark, d):
    df = load(spark, d, "events").withColumn("clock", elapsed.from_timestamp(F.col("ts")))
    return filters.filter_rows(df, [Condition("clock", "gte", "1:00:00", elapsed=True)]).select("event_id")


@query("stack", "SELECT 'c' AS kind, c_custkey AS key, c_acctbal AS balance FROM customer UNION ALL SELECT 's', s_suppkey, s_acctbal FROM supplier")
def stack(spark, d):
    a = load(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    b = load(spark, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return rows.stack([a, b])


@query("stack_dedup", "SELECT min(i) AS row, r, c FROM (SELECT n_nationkey AS i, n_regionkey AS r, substr(n_name, 1, 1) AS c FROM nation UNION ALL SELECT r_regionkey + 1000, r_regionkey, substr(r_name, 1, 1) FROM region) GROUP BY r, c")
def stack_dedup(spark, d):
    a = load(spark, d, "nation").select(F.col("n_nationkey").alias("row"), F.col("n_regionkey").alias("r"), F.substring("n_name", 1, 1).alias("c"))
    b = load(spark, d, "region").select((F.col("r_regionkey") + 1000).alias("row"), F.col("r_regionkey").alias("r"), F.substring("r_name", 1, 1).alias("c"))
    return rows.drop_exact_duplicates(rows.stack([a, b]), "row")


def _sides(spark, d):
    """Whole tables whose keys, one moved by 100, meet in part: both have rows without a partner."""
    left = load(spark, d, "documents").select("doc_id", "lang", F.col("doc_id").alias("key"))
    right = load(spark, d, "labels").select((F.col("doc_id") + 100).alias("key"), "quality")
    return left, right


_L = "(SELECT doc_id, lang, doc_id AS key FROM documents) a"
_R = "(SELECT doc_id + 100 AS key, quality FROM labels) b"
for _how, _sql in {
    "inner": f"SELECT a.*, quality FROM {_L} JOIN {_R} ON a.key = b.key",
    "left": f"SELECT a.*, quality FROM {_L} LEFT JOIN {_R} ON a.key = b.key",
    "right": f"SELECT doc_id, lang, b.* FROM {_L} RIGHT JOIN {_R} ON a.key = b.key",
    "full": f"SELECT a.*, b.key AS key_labels, quality FROM {_L} FULL JOIN {_R} ON a.key = b.key",
    "semi": f"SELECT a.* FROM {_L} SEMI JOIN {_R} ON a.key = b.key",
    "anti": f"SELECT a.* FROM {_L} ANTI JOIN {_R} ON a.key = b.key",
}.items():
    QUERIES[f"join_{_how}"] = lambda spark, d, how=_how: rows.join(*_sides(spark, d), "key", "key", how, "labels")
    ORACLE_SQL[f"join_{_how}"] = _sql


@query("join_cross", "SELECT r_regionkey, r_name, n_nationkey, n_name, n_regionkey FROM region, nation")
def join_cross(spark, d):
    return rows.join(load(spark, d, "region"), load(spark, d, "nation"), "r_regionkey", "n_regionkey", "cross")


@query("join_order", "SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def join_order(spark, d):
    joined = rows.join(load(spark, d, "orders").select("o_orderkey", "o_custkey"), load(spark, d, "customer").select("c_custkey", "c_name"), "o_custkey", "c_custkey", "left")
    return rows.order_join(joined, "o_orderkey", None, "left")


@query("join_columns", "SELECT n_nationkey, n_name, n_regionkey, r_name AS name_region FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_columns(spark, d):
    right = load(spark, d, "region").select("r_regionkey", F.col("r_name").alias("name"))
    left = load(spark, d, "nation").withColumn("name", F.col("n_name"))
    return rows.join(left, right, "n_regionkey", "r_regionkey", "inner", "region").drop("name")


_NEAR = r"trim(regexp_replace(regexp_replace(lower(text), '[\p{P}\p{S}]', '', 'g'), '[\s]+', ' ', 'g'))"


@query("dedup_kept", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_kept(spark, d):
    df = load(spark, d, "documents")
    return rows.dedup_keep_first(df, "doc_id", [F.col("text")]).select("doc_id")


@query("dedup_near", f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {_NEAR}")
def dedup_near(spark, d):
    df = load(spark, d, "documents")
    return rows.dedup_keep_first(df, "doc_id", [rows.near_key(F.col("text"))]).select("doc_id")


@query("dedup_groups", "SELECT doc_id, dense_rank() OVER (ORDER BY f) AS duplicate_group, doc_id = f AS kept FROM (SELECT doc_id, min(doc_id) OVER w AS f, count(*) OVER w AS n FROM documents WINDOW w AS (PARTITION BY text)) WHERE n > 1")
def dedup_groups(spark, d):
    return rows.duplicate_groups(load(spark, d, "documents"), "doc_id", [F.col("text")]).select("doc_id", "duplicate_group", "kept")


@query("segment_line", r"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS segment, t AS text FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE t <> ''")
def segment_line(spark, d):
    return segments.segment(load(spark, d, "documents").select("doc_id", "text"), "text", "line").select("doc_id", "segment", "text")


# chr(1) is in no document, so it can stand for the edges in SQL
_SENTENCES = r"string_split(regexp_replace(text, '([.!?…]+[\"''”’)\]]*)\s+', '\1' || chr(1), 'g'), chr(1))"


@query("segment_sentence", f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS segment, t AS text FROM (SELECT doc_id, trim(unnest(p), chr(10) || chr(13) || chr(9) || ' ') AS t, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, {_SENTENCES} AS p FROM documents)) WHERE t <> ''")
def segment_sentence(spark, d):
    return segments.segment(load(spark, d, "documents").select("doc_id", "text"), "text", "sentence")


@query("segment_paragraph", r"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS segment, t AS text FROM (SELECT doc_id, trim(unnest(string_split_regex(text, '\n[ \t]*(?:\n[ \t]*)+'))) AS t, unnest(range(1, len(string_split_regex(text, '\n[ \t]*(?:\n[ \t]*)+')) + 1)) AS i FROM documents) WHERE t <> ''")
def segment_paragraph(spark, d):
    return segments.segment(load(spark, d, "documents").select("doc_id", "text"), "text", "paragraph").select("doc_id", "segment", "text")


@query("segment_pattern", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS segment, role AS lead, trim(text, chr(10) || ' ') AS text FROM conversations WHERE trim(text) <> ''")
def segment_pattern(spark, d):
    turns = load(spark, d, "conversations").groupBy("conv_id").agg(F.expr("listagg(concat(role, ': ', text), '\n') within group (order by turn)").alias("text"))
    return segments.segment_pattern(turns, "text", r"(?m)^(?:user|assistant|system):", "lead")


# Groups

@query("gs_rows", "SELECT c_mktsegment, c_nationkey, count(*) AS rows FROM customer GROUP BY ALL")
def gs_rows(spark, d):
    return groups.group_summary(load(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], [], "c_custkey")


def _summary(name: str, table: str, keys: list[str], ordinal: str, summaries: list[groups.Summary], chosen: str) -> None:
    QUERIES[name] = lambda spark, d: groups.group_summary(load(spark, d, table), keys, summaries, ordinal)
    ORACLE_SQL[name] = f"SELECT {', '.join(keys)}, count(*) AS rows, {chosen} FROM {table} GROUP BY {', '.join(keys)}"


_S = groups.Summary
_summary("gs_join_text", "nation", ["n_regionkey"], "n_nationkey", [_S("n_name", "join_text", " / ")], "string_agg(n_name, ' / ' ORDER BY n_nationkey) AS n_name")
_summary("gs_count_distinct", "orders", ["o_orderstatus"], "o_orderkey", [_S("o_custkey", "count_distinct")], "count(DISTINCT o_custkey) AS o_custkey_count_distinct")
_summary("gs_distinct_values", "customer", ["c_nationkey"], "c_custkey", [_S("c_mktsegment", "distinct_values", ", ")], "(SELECT string_agg(m, ', ' ORDER BY f) FROM (SELECT c_mktsegment AS m, min(c_custkey) AS f FROM customer k WHERE k.c_nationkey = customer.c_nationkey GROUP BY 1)) AS c_mktsegment")
_summary("gs_earliest_latest", "events", ["event_type"], "event_id", [_S("ts", "earliest_latest")], "min(ts) AS ts_earliest, max(ts) AS ts_latest")
_summary("gs_first", "events", ["event_type"], "event_id", [_S("value", "first")], "arg_min(value, event_id) AS value_first")
_summary("gs_last", "events", ["event_type"], "event_id", [_S("value", "last")], "arg_max(value, event_id) AS value_last")
_summary("gs_sum", "part", ["p_brand"], "p_partkey", [_S("p_size", "sum")], "cast(sum(p_size) AS bigint) AS p_size_sum")
_summary("gs_mean", "part", ["p_brand"], "p_partkey", [_S("p_size", "mean")], "avg(p_size) AS p_size_mean")
_summary("gs_min", "part", ["p_brand"], "p_partkey", [_S("p_retailprice", "min")], "min(p_retailprice) AS p_retailprice_min")
_summary("gs_max", "part", ["p_brand"], "p_partkey", [_S("p_retailprice", "max")], "max(p_retailprice) AS p_retailprice_max")
_summary("gs_earliest", "orders", ["o_orderpriority"], "o_orderkey", [_S("o_orderdate", "earliest")], "min(o_orderdate) AS o_orderdate_earliest")
_summary("gs_latest", "orders", ["o_orderpriority"], "o_orderkey", [_S("o_orderdate", "latest")], "max(o_orderdate) AS o_orderdate_latest")
_summary("group_summary", "lineitem", ["l_returnflag", "l_linestatus"], "l_orderkey", [_S("l_quantity", "sum"), _S("l_quantity", "max"), _S("l_linenumber", "count_distinct")], "sum(l_quantity) AS l_quantity_sum, max(l_quantity) AS l_quantity_max, count(DISTINCT l_linenumber) AS l_linenumber_count_distinct")


@query("value_counts", "SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def value_counts(spark, d):
    return groups.value_counts(load(spark, d, "events"), "event_type", 3)[0]


@query("value_counts_totals", "SELECT 0 AS empty, count(DISTINCT n_name) AS distinct_values, count(*) - 5 AS unlisted FROM nation")
def value_counts_totals(spark, d):
    return groups.value_counts(load(spark, d, "nation"), "n_name", 5)[1]


@query("category_values", "SELECT p_brand AS value, count(*) AS count FROM part GROUP BY 1")
def category_values(spark, d):
    return groups.category_values(load(spark, d, "part"), "p_brand")


@query("natural_order", "SELECT value, row_number() OVER (ORDER BY k) AS place FROM (SELECT DISTINCT source AS value, cast(substr(source, 4) AS int) AS k FROM documents)")
def natural_order(spark, d):
    from pyspark.sql import Window

    from lexigrid.functions.text import natural_key

    labels = load(spark, d, "documents").select(F.col("source").alias("value")).distinct()
    return labels.select("value", F.row_number().over(Window.orderBy(natural_key(F.col("value")), "value")).cast("bigint").alias("place"))


@query("merge_orders", "SELECT i AS place, label FROM (SELECT unnest(range(1, 5)) AS i, unnest(['low', 'middle', 'high', 'top']) AS label) UNION ALL SELECT count(*), 'rows' FROM (SELECT * FROM part UNION ALL SELECT * FROM part)")
def merge_orders(spark, d):
    """Stacked blocks whose categories have different orders: one order that agrees with both, and all rows."""
    size = lambda *labels: load(spark, d, "part").select(F.element_at(F.array(*map(F.lit, labels)), F.col("p_size") % len(labels) + 1).alias("size"))
    blocks = [casts.to_category(size(*labels), "size", list(labels)) for labels in (("low", "middle", "top"), ("middle", "high", "top"))]
    stacked = rows.stack(blocks)
    places = [(i, x) for i, x in enumerate(stacked.schema["size"].metadata["category_order"], 1)]
    return spark.createDataFrame([*places, (stacked.count(), "rows")], "place bigint, label string")


@query("distinct_value_columns", "SELECT * FROM (SELECT 'c_nationkey' AS column, count(DISTINCT c_nationkey) AS distinct_values FROM customer UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) FROM customer) WHERE distinct_values BETWEEN 2 AND 50")
def distinct_value_columns(spark, d):
    return groups.distinct_value_columns(load(spark, d, "customer"), 2, 50)


@query("column_examples", "SELECT 'item_id' AS column, '0' AS example UNION ALL SELECT 'text', substr(trim(regexp_replace(arg_min(text, item_id), '\\s+', ' ', 'g')), 1, 200) FROM benchmark")
def column_examples(spark, d):
    return groups.column_examples(load(spark, d, "benchmark"), "item_id")


@query(
    "corpus_overview",
    r"SELECT count(*) AS documents, count(*) FILTER (text IS NULL OR trim(text) = '') AS empty, count(*) FILTER (trim(text) <> '') - count(DISTINCT text) FILTER (trim(text) <> '') AS duplicates, 'words' AS unit, cast(sum(n) AS bigint) AS total, min(n) AS shortest, median(n) AS median, round(avg(n), 6) AS mean, max(n) AS longest FROM (SELECT text, len(regexp_extract_all(text, '\S+')) AS n FROM documents)",
)
def corpus_overview(spark, d):
    return groups.corpus_overview(load(spark, d, "documents"), "text")


@query("emptied_report", r"SELECT count(*) AS emptied, min(n_nationkey) AS first_row, arg_min(n_name, n_nationkey) AS first_value FROM nation WHERE regexp_replace(n_name, '[AEIOU].*', '') = ''")
def emptied_report(spark, d):
    before = load(spark, d, "nation")
    return groups.emptied_report(before, edits.replace(before, "n_name", "[AEIOU].*", "", regex=True), "n_nationkey", "n_name")


@query("changed_rows", "SELECT c_custkey AS row, c_mktsegment AS old, lower(c_mktsegment) AS new FROM customer WHERE c_mktsegment <> lower(c_mktsegment)")
def changed_rows(spark, d):
    before = load(spark, d, "customer")
    return groups.changed_rows(before, edits.clean(before, "c_mktsegment", "lowercase"), "c_custkey", "c_mktsegment")


@query("split_by_group", "SELECT cast(floor((p_retailprice - 900) / 50) AS bigint) AS \"group\", count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1")
def split_by_group(spark, d):
    return groups.split_groups(load(spark, d, "part"), groups.number_interval(F.col("p_retailprice"), 900, 50))


@query("split_by_month", "SELECT strftime(o_orderdate, '%m') AS \"group\", count(*) AS n FROM orders GROUP BY 1")
def split_by_month(spark, d):
    return groups.split_groups(load(spark, d, "orders"), F.date_format("o_orderdate", "MM"))


@query("expr_group_by_agg", "SELECT o_orderstatus AS status, year(o_orderdate) AS y, count(o_orderkey) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1, 2")
def expr_group_by_agg(spark, d):
    keys = {"status": col("o_orderstatus"), "y": call("year", col("o_orderdate"))}
    made = {"n": call("count", col("o_orderkey")), "low": call("min", col("o_totalprice")), "high": call("max", col("o_totalprice")), "customers": call("n_unique", col("o_custkey"))}
    return expressions.group_by_agg(load(spark, d, "orders"), keys, made)


# Expressions

def _expr(name: str, table: str, key: str, e: expressions.Expr, value: str) -> None:
    QUERIES[name] = lambda spark, d: expressions.select(load(spark, d, table), {key: col(key), "v": e})
    ORACLE_SQL[name] = f"SELECT {key}, {value} AS v FROM {table}"


_expr("x_column", "part", "p_partkey", col("p_name"), "p_name")
_expr("x_literal", "part", "p_partkey", lit("x"), "'x'")
_expr("x_add", "part", "p_partkey", call("add", col("p_size"), 7), "p_size + 7")
_expr("x_add_text", "part", "p_partkey", call("add", col("p_brand"), "!"), "p_brand || '!'")
_expr("x_subtract", "part", "p_partkey", call("subtract", col("p_size"), 60), "p_size - 60")
_expr("x_multiply", "part", "p_partkey", call("multiply", col("p_size"), 3), "p_size * 3")
_expr("x_divide", "part", "p_partkey", call("divide", col("p_size"), call("subtract", col("p_size"), 10)), "cast(p_size AS double) / (p_size - 10)")
_expr("x_modulo", "part", "p_partkey", call("modulo", call("subtract", col("p_size"), 25), 7), "(((p_size - 25) % 7) + 7) % 7")
for _op, _sign in (("eq", "="), ("ne", "<>"), ("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    _expr(f"x_{_op}", "part", "p_partkey", call(_op, col("p_size"), 20), f"p_size {_sign} 20")
_expr("x_and", "part", "p_partkey", call("and", call("gt", col("p_size"), 10), call("lt", col("p_size"), 20)), "p_size > 10 AND p_size < 20")
_expr("x_or", "part", "p_partkey", call("or", call("gt", col("p_size"), 40), call("lt", col("p_size"), 5)), "p_size > 40 OR p_size < 5")
_expr("x_not", "part", "p_partkey", call("not", call("gt", col("p_size"), 40)), "NOT p_size > 40")
_expr("x_is_in", "part", "p_partkey", expressions.Expr("is_in", (col("p_size"), lit([1, 2, 3]))), "p_size IN (1, 2, 3)")
_expr("x_fill_null", "documents", "doc_id", call("fill_null", col("lang"), "?"), "coalesce(lang, '?')")
_expr("x_is_null", "documents", "doc_id", call("is_null", col("lang")), "lang IS NULL")
_expr("x_is_not_null", "documents", "doc_id", call("is_not_null", col("lang")), "lang IS NOT NULL")
_expr("x_abs", "customer", "c_custkey", call("abs", col("c_acctbal")), "abs(c_acctbal)")
_expr("x_lowercase", "part", "p_partkey", call("lowercase", col("p_type")), "lower(p_type)")
_expr("x_uppercase", "part", "p_partkey", call("uppercase", col("p_name")), "upper(p_name)")
_expr("x_year", "orders", "o_orderkey", call("year", col("o_orderdate")), "year(o_orderdate)")
_expr("x_month", "orders", "o_orderkey", call("month", col("o_orderdate")), "month(o_orderdate)")
_expr("x_day", "orders", "o_orderkey", call("day", col("o_orderdate")), "day(o_orderdate)")
_expr("x_contains", "part", "p_partkey", call("contains", col("p_type"), "BRASS"), "contains(p_type, 'BRASS')")
_expr("x_starts_with", "part", "p_partkey", call("starts_with", col("p_type"), "PROMO"), "starts_with(p_type, 'PROMO')")
_expr("x_ends_with", "part", "p_partkey", call("ends_with", col("p_type"), "TIN"), "ends_with(p_type, 'TIN')")
_expr("x_cast", "part", "p_partkey", call("cast", col("p_brand"), to="integer", strict=False), "try_cast(p_brand AS bigint)")
_expr("x_round", "customer", "c_custkey", call("round", col("c_acctbal"), decimals=0), "round(c_acctbal, 0)")
_expr("x_concat_string", "nation", "n_nationkey", call("concat_string", col("n_name"), col("n_regionkey"), separator="-"), "n_name || '-' || n_regionkey")


def _whole(op: str, value: str) -> None:
    QUERIES[f"x_{op}"] = lambda spark, d: expressions.with_columns(load(spark, d, "nation").select("n_nationkey", "n_regionkey"), {"v": call(op, col("n_regionkey"))})
    ORACLE_SQL[f"x_{op}"] = f"SELECT n_nationkey, n_regionkey, {value} AS v FROM nation"


for _op, _value in (("sum", "cast(sum(n_regionkey) OVER () AS bigint)"), ("mean", "avg(n_regionkey) OVER ()"), ("min", "min(n_regionkey) OVER ()"), ("max", "max(n_regionkey) OVER ()"), ("count", "count(n_regionkey) OVER ()"), ("n_unique", "(SELECT count(DISTINCT n_regionkey) FROM nation)")):
    _whole(_op, _value)


@query("x_sort", "SELECT s_suppkey, s_nationkey FROM supplier")
def x_sort(spark, d):
    return expressions.sort(load(spark, d, "supplier").select("s_suppkey", "s_nationkey"), [(col("s_nationkey"), True), (col("s_suppkey"), False)])


# Column edits

def _edit(name: str, table: str, columns: list[str], change: Callable[[DataFrame], DataFrame], chosen: str) -> None:
    QUERIES[name] = lambda spark, d: change(load(spark, d, table).select(*columns))
    ORACLE_SQL[name] = f"SELECT {chosen} FROM {table}"


_DOC = ["doc_id", "text"]
_edit("e_rename", "region", ["r_regionkey", "r_name"], lambda df: edits.rename(df, "r_name", "name"), "r_regionkey, r_name AS name")
_edit("e_delete", "region", ["r_regionkey", "r_name"], lambda df: edits.delete(df, "r_name"), "r_regionkey")
_edit("e_delete_many", "nation", ["n_nationkey", "n_name", "n_regionkey"], lambda df: edits.delete(df, "n_name", "n_regionkey"), "n_nationkey")
_edit("e_duplicate", "region", ["r_regionkey", "r_name"], lambda df: edits.duplicate(edits.duplicate(df, "r_name"), "r_name"), 'r_regionkey, r_name, r_name AS "r_name copy", r_name AS "r_name copy 2"')
_edit("e_clean_trim", "documents", _DOC, lambda df: edits.clean(df, "text", "trim"), r"doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text")
_edit("e_clean_collapse_whitespace", "documents", _DOC, lambda df: edits.clean(df, "text", "collapse_whitespace"), r"doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text")
_edit("e_clean_lowercase", "documents", _DOC, lambda df: edits.clean(df, "text", "lowercase"), "doc_id, lower(text) AS text")
_edit("e_clean_uppercase", "part", ["p_partkey", "p_name"], lambda df: edits.clean(df, "p_name", "uppercase"), "p_partkey, upper(p_name) AS p_name")
_edit("e_clean_title_case", "part", ["p_partkey", "p_type"], lambda df: edits.clean(df, "p_type", "title_case"), "p_partkey, array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS p_type")
_edit("e_clean_remove_punctuation", "documents", _DOC, lambda df: edits.clean(df, "text", "remove_punctuation"), r"doc_id, regexp_replace(text, '[\p{P}\p{S}]', '', 'g') AS text")
_edit("e_clean_remove_digits", "documents", _DOC, lambda df: edits.clean(df, "text", "remove_digits"), r"doc_id, regexp_replace(text, '[0-9]', '', 'g') AS text")
_edit("e_clean_remove_urls", "pages", ["page_id", "url"], lambda df: edits.clean(df, "url", "remove_urls"), r"page_id, regexp_replace(url, '(?i)\b(?:https?://|www\.)\S+', '', 'g') AS url")
_edit("e_clean_remove_html_tags", "pages", ["page_id", "html"], lambda df: edits.clean(df, "html", "remove_html_tags"), r"page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS html")
_XML = "regexp_replace(html, '" + "|".join(edits.XML_MARKUP).replace("'", "''") + "', '', 'g')"
for _entity, _char in edits.ENTITIES:
    _XML = f"replace({_XML}, '{_entity}', chr({ord(_char)}))"
_edit("e_clean_remove_xml_tags", "pages", ["page_id", "html"], lambda df: edits.clean(df, "html", "remove_xml_tags"), f"page_id, {_XML} AS html")
_edit("e_split", "customer", ["c_custkey", "c_name"], lambda df: edits.split(df, "c_name", ["#"], ["a", "b"]), "c_custkey, c_name, split_part(c_name, '#', 1) AS a, CASE WHEN contains(c_name, '#') THEN substr(c_name, instr(c_name, '#') + 1) END AS b")
_edit("e_count_words", "documents", _DOC, lambda df: edits.count_column(df, "text", "words", "n").drop("text"), r"doc_id, len(regexp_extract_all(text, '\S+')) AS n")
_edit("e_count_characters", "documents", _DOC, lambda df: edits.count_column(df, "text", "characters", "n").drop("text"), "doc_id, length(text) AS n")
_edit("e_count_characters_no_spaces", "documents", _DOC, lambda df: edits.count_column(df, "text", "characters_no_spaces", "n").drop("text"), r"doc_id, length(regexp_replace(text, '\s', '', 'g')) AS n")
_edit("e_count_matches", "documents", _DOC, lambda df: edits.count_column(df, "text", "matches", "n", "[A-Z]", True).drop("text"), "doc_id, len(regexp_extract_all(text, '[A-Z]')) AS n")
_edit("e_map_values", "customer", ["c_custkey", "c_mktsegment"], lambda df: edits.map_values(df, "c_mktsegment", {"BUILDING": "b", "MACHINERY": " "}, into="m"), "c_custkey, c_mktsegment, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' END AS m")
_edit("e_combine", "nation", ["n_nationkey", "n_name"], lambda df: edits.combine(df, [("text", "<"), ("column", "n_name"), ("text", ":"), ("column", "n_nationkey"), ("text", ">")], "c"), "n_nationkey, n_name, '<' || n_name || ':' || n_nationkey || '>' AS c")
_edit("e_replace_all", "documents", _DOC, lambda df: edits.replace(df, "text", "(th)(e)", "${2}${1}", regex=True), r"doc_id, regexp_replace(text, '(th)(e)', '\2\1', 'g') AS text")
_edit("e_replace_first", "documents", _DOC, lambda df: edits.replace(df, "text", "the", "X", limit=1), "doc_id, regexp_replace(text, 'the', 'X') AS text")
_edit("e_extract", "documents", _DOC, lambda df: edits.extract(df, "text", "[A-Z][a-z]+", "x", "|", 2).drop("text"), "doc_id, nullif(array_to_string(list_slice(regexp_extract_all(text, '[A-Z][a-z]+'), 1, 2), '|'), '') AS x")
_edit("e_set_cell", "region", ["r_regionkey", "r_name"], lambda df: edits.set_cell(df, "r_name", "r_regionkey", 2, "here"), "r_regionkey, CASE WHEN r_regionkey = 2 THEN 'here' ELSE r_name END AS r_name")
_edit("e_expression", "nation", ["n_nationkey", "n_name"], lambda df: expressions.with_columns(df, {"n_name": call("lowercase", col("n_name"))}), "n_nationkey, lower(n_name) AS n_name")


def _undone(df: DataFrame) -> DataFrame:
    history = edits.History(df)
    history.apply(edits.clean(df, "r_name", "lowercase"))
    history.apply(edits.delete(history.now, "r_name"))
    return history.undo()


def _redone(df: DataFrame) -> DataFrame:
    history = edits.History(df)
    history.apply(edits.clean(df, "r_name", "lowercase"))
    history.undo()
    return history.redo()


_edit("e_undo", "region", ["r_regionkey", "r_name"], _undone, "r_regionkey, lower(r_name) AS r_name")
_edit("e_redo", "region", ["r_regionkey", "r_name"], _redone, "r_regionkey, lower(r_name) AS r_name")


@query("e_annotation_classes", "SELECT l.doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS quality, toxic FROM labels l")
def e_annotation_classes(spark, d):
    from lexigrid.operators import annotations

    df = load(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"), "toxic")
    classes = df.select("doc_id", F.when(F.col("quality") == "1", "good").otherwise("bad").alias("quality"))
    return annotations.replace_classes(df, classes, "doc_id", ["quality"])


# Casts

def _cast(name: str, table: str, key: str, made: Callable[[DataFrame], object], value: str) -> None:
    QUERIES[name] = lambda spark, d: (lambda df: df.select(key, made(df).alias("v")))(load(spark, d, table))
    ORACLE_SQL[name] = f"SELECT {key}, {value} AS v FROM {table}"


_cast("c_string", "orders", "o_orderkey", lambda df: casts.to_string(F.col("o_orderdate"), df.schema["o_orderdate"].dataType, "%d/%m/%Y"), "strftime(o_orderdate, '%d/%m/%Y')")
_cast("c_integer_text", "customer", "c_custkey", lambda df: casts.integer_from_text(F.col("c_acctbal").cast("string")), "cast(sign(c_acctbal) * floor(abs(cast(c_acctbal AS decimal(18,4))) + 0.5) AS bigint)")
_cast("c_integer_float", "customer", "c_custkey", lambda df: casts.integer_from_float(F.col("c_acctbal")), "cast(sign(c_acctbal) * floor(abs(cast(c_acctbal AS decimal(18,4))) + 0.5) AS bigint)")
_cast("c_float_text", "part", "p_partkey", lambda df: casts.float_from_text(F.concat(F.lit("$"), F.format_number("p_retailprice", 2)), ".", ",", True), "round(p_retailprice, 2)")
_cast("c_datetime_text", "events", "event_id", lambda df: F.date_format(casts.timestamp_from_text(F.date_format("ts", "dd.MM.yyyy HH:mm"), "%d.%m.%Y %H:%M"), "yyyy-MM-dd HH:mm"), "strftime(ts, '%Y-%m-%d %H:%M')")
_cast("c_two_digit_year", "orders", "o_orderkey", lambda df: F.year(casts.two_digit_year(F.col("o_orderdate"), 1930)), "1930 + ((year(o_orderdate) - 1930) % 100 + 100) % 100")
_cast("c_unix", "events", "event_id", lambda df: F.date_format(casts.from_unix(F.unix_seconds(F.col("ts").cast("timestamp")), "s"), "yyyy-MM-dd HH:mm:ss"), "strftime(ts, '%Y-%m-%d %H:%M:%S')")
_cast("c_excel_serial", "part", "p_partkey", lambda df: F.date_format(casts.from_excel(F.col("p_size") + 40000), "yyyy-MM-dd"), "strftime(DATE '1899-12-30' + cast(p_size + 40000 AS int), '%Y-%m-%d')")
_cast("c_date", "orders", "o_orderkey", lambda df: F.col("o_orderdate").cast("date").cast("string"), "cast(cast(o_orderdate AS date) AS varchar)")
_cast("c_categorical", "customer", "c_custkey", lambda df: casts.category_rank(F.col("c_mktsegment"), ["MACHINERY", "BUILDING"]), "list_position(['MACHINERY', 'BUILDING'], c_mktsegment)")
_cast("c_duration_text", "part", "p_partkey", lambda df: elapsed.from_text(F.concat(F.col("p_size").cast("string"), F.lit(":07.5"))), "cast(p_size AS bigint) * 60000000 + 7500000")
_cast("c_duration_number", "part", "p_partkey", lambda df: elapsed.from_number(F.col("p_size"), "min"), "cast(p_size AS bigint) * 60000000")
_cast("c_duration_to_number", "part", "p_partkey", lambda df: elapsed.to_number(F.col("p_size").cast("bigint") * 1_800_000_000, "h"), "cast(p_size AS double) / 2")
_cast("c_duration_datetime", "events", "event_id", lambda df: elapsed.from_timestamp(F.col("ts")), "epoch_us(ts) % 86400000000")
_cast("c_duration_to_text", "part", "p_partkey", lambda df: elapsed.to_text(F.col("p_size").cast("bigint") * 61_500_000, "h:mm:ss"), "((p_size * 61500) // 3600000) || ':' || lpad(cast(((p_size * 61500) // 60000) % 60 AS varchar), 2, '0') || ':' || lpad(cast(((p_size * 61500) // 1000) % 60 AS varchar), 2, '0')")


@query("check_cast", "SELECT count(*) AS present, 0 AS converted, count(*) AS failed FROM part")
def check_cast(spark, d):
    df = load(spark, d, "part")
    return casts.check_cast(df, "p_brand", F.col("p_brand").try_cast("double")).drop("failures")


@query("detect_datetime", "SELECT unnest(['%Y-%m-%d %H:%M:%S', '%d/%m/%Y', '%a, %d %b %Y %H:%M']) AS format, count(*) AS reads, unnest([false, true, false]) AS swaps FROM events GROUP BY 1, 3")
def detect_datetime(spark, d):
    found = []
    for shown in ("yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy", "EEE, dd MMM yyyy HH:mm"):
        # days of the month up to 12 alone read both ways round
        day = F.expr("make_timestamp_ntz(2024, 1 + event_id % 12, 1 + event_id % 11, event_id % 24, 30, 0)")
        texts = load(spark, d, "events").select(F.date_format(day, shown).alias("t"))
        best = casts.detect_datetime(texts, "t", sample=texts.count())[0]
        found.append((best.format, best.reads, best.swap is not None))
    return spark.createDataFrame(found, "format string, reads bigint, swaps boolean")


_cast("c_datetime_in_text", "events", "event_id", lambda df: F.date_format(casts.timestamp_from_text(F.concat(F.lit("seen on "), F.date_format("ts", "dd.MM.yyyy"), F.lit(" by us, 3.4.")), "%d.%m.%Y", inside=True), "yyyy-MM-dd"), "strftime(ts, '%Y-%m-%d')")


# SQL

def _sql(name: str, tables_: list[str], statement: str, oracle: str | None = None) -> None:
    QUERIES[name] = lambda spark, d: sql.run_sql(spark, {t: load(spark, d, t) for t in tables_}, statement)
    ORACLE_SQL[name] = oracle or statement


_sql("sql_query", ["nation"], 'SELECT n_name FROM "nation" WHERE n_regionkey = 1')
_sql("sql_project_order", ["nation"], "SELECT n_nationkey, n_name FROM nation ORDER BY n_name")
_sql("sql_join", ["nation", "region"], "SELECT l.n_name, r.r_name FROM nation l JOIN region r ON l.n_regionkey = r.r_regionkey")
QUERIES["sql_cte_row_number"] = lambda spark, d: sql.run_sql(spark, {"nation": load(spark, d, "nation")}, 'WITH s AS (SELECT * FROM "nation"), t AS (SELECT ROW_NUMBER() OVER () - 1 AS row, * FROM s) SELECT row, n_name FROM t WHERE row < 5 ORDER BY row', ordinal="n_nationkey")
ORACLE_SQL["sql_cte_row_number"] = "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS row, n_name FROM nation QUALIFY row < 5"
_sql("sql_distinct", ["customer"], "SELECT DISTINCT c_mktsegment FROM customer")
_sql("sql_regex_ci", ["nation"], """SELECT DISTINCT "value" FROM (SELECT "n_name" AS "value" FROM "nation") AS "values" WHERE CAST("value" AS VARCHAR) ~* '^n[a-z]*_?[12]?\\d$' ORDER BY "value" ASC NULLS FIRST""",
     r"SELECT DISTINCT n_name AS value FROM nation WHERE regexp_matches(n_name, '(?i)^n[a-z]*_?[12]?\d$')")
QUERIES["sql_unnest"] = lambda spark, d: sql.run_sql(spark, {"part": load(spark, d, "part").select(F.split("p_type", " ").alias("tags"))}, 'SELECT "value", COUNT(*) AS "n" FROM (SELECT UNNEST("tags") AS "value" FROM "part") AS "values" GROUP BY "value"')
ORACLE_SQL["sql_unnest"] = "SELECT value, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS value FROM part) GROUP BY value"
_sql("sql_group_alias", ["orders"], "SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY p ORDER BY n DESC, p NULLS LAST LIMIT 3")
_sql("sql_strftime", ["orders"], """SELECT STRFTIME("o_orderdate", '%Y-%m') AS value, COUNT(*) AS n FROM "orders" GROUP BY value ORDER BY value ASC NULLS LAST LIMIT 500""")
_sql("sql_floor_bin", ["part"], "SELECT CAST(FLOOR((p_retailprice - 900) / 25) AS BIGINT) AS bin, count(*) AS n FROM part GROUP BY bin")
_sql("sql_case_nullif", ["customer"], "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING') THEN NULLIF(TRIM(c_mktsegment), '') ELSE CAST(c_nationkey AS STRING) END AS v FROM customer")
_sql("sql_union_all", ["nation", "region"], "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
_sql("sql_stats", ["part"], "SELECT MIN(p_size) AS low, MAX(p_size) AS high, MEDIAN(p_size) AS middle, COUNT(*) - COUNT(p_size) AS missing FROM part")
_sql("sql_count_distinct", ["orders"], "SELECT COUNT(DISTINCT o_custkey) AS n, COUNT(*) > COUNT(o_custkey) AS gaps FROM orders")
_sql("sql_length_replace", ["documents"], "SELECT lang, SUM(LENGTH(REPLACE(text, ' ', ''))) AS n, MAX(GREATEST(LENGTH(text), 100)) AS m, CAST(CEIL(COALESCE(AVG(LENGTH(text)), 0)) AS BIGINT) AS a FROM documents GROUP BY lang",
     "SELECT lang, CAST(SUM(LENGTH(REPLACE(text, ' ', ''))) AS BIGINT) AS n, MAX(GREATEST(LENGTH(text), 100)) AS m, CAST(CEIL(COALESCE(AVG(LENGTH(text)), 0)) AS BIGINT) AS a FROM documents GROUP BY lang")


_UNSAFE = (
    "SELECT * FROM read_parquet('{0}/nation.parquet')",
    "SELECT * FROM `parquet`.`{0}/nation.parquet`",
    'SELECT * FROM "parquet"."{0}/nation.parquet"',
    "SELECT * FROM nation, parquet.`{0}/nation.parquet`",
    "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT n_nationkey FROM other)",
    "SELECT 1 FROM nation; DROP TABLE nation",
    "SELECT count(*) OVER other FROM other WINDOW other AS (ORDER BY 1)",
    "SELECT n_name FROM nation UNION ALL TABLE other",
    "WITH q AS (TABLE other) SELECT * FROM q",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.dir') FROM nation",
    "SELECT TRANSFORM(n_name) USING 'cat' FROM nation",
)


@query("sql_guard", "SELECT i, CASE WHEN i < 11 THEN 'refused' ELSE cast((SELECT count(*) FROM nation WHERE n_name <> 'read_csv(') AS varchar) END AS outcome FROM range(12) t(i)")
def sql_guard(spark, d):
    outcomes = []
    for statement in (*_UNSAFE, "SELECT n_name /* FROM other; */ FROM nation WHERE n_name <> 'read_csv(' -- scan_x("):
        try:
            outcomes.append(str(sql.run_sql(spark, {"nation": load(spark, d, "nation")}, statement.format(d)).count()))
        except ValueError:
            outcomes.append("refused")
    return spark.createDataFrame(list(enumerate(outcomes)), "i bigint, outcome string")


@query("sql_create", "SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY 1 HAVING count(*) > 4")
def sql_create(spark, d):
    """A block from a query, then a query over that block."""
    made = sql.create_block(spark, {"nation": load(spark, d, "nation")}, "SELECT n_regionkey AS region, COUNT(*) AS n FROM nation GROUP BY region", "regions")
    return sql.run_sql(spark, {made.name: made.frame}, 'SELECT * FROM "regions" WHERE n > 4')
