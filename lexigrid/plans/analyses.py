"""Registered queries of the corpus analyses, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrid.operators import agreement, annotations, density, filters, frequency, kwic, pages, quotations, quotes, topic_tree, topics, trends
from lexigrid.functions.shared import shared_folder, written
from lexigrid.operators.filters import Condition
from lexigrid.streaming import trends as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if oracle:
            ORACLE_SQL[name] = oracle
        return function

    return keep


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Frequency

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')"


@query("tokenize", f"SELECT doc_id, len(w) AS n, array_to_string(w, ' ') AS tokens FROM (SELECT doc_id, {_WORDS} AS w FROM documents)")
def tokenize(spark, d):
    words = frequency.words(F.col("text"))
    return load(spark, d, "documents").select("doc_id", F.size(words).cast("bigint").alias("n"), F.array_join(words, " ").alias("tokens"))


@query("tokenize_offsets", f"SELECT item_id, array_to_string({_WORDS}, ' ') AS tokens, true AS placed FROM benchmark")
def tokenize_offsets(spark, d):
    df = load(spark, d, "benchmark").withColumn("t", frequency.tokenize(F.col("text")))
    placed = F.forall("t", lambda x: F.lower(F.col("text").substr((x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))) == x["token"])
    return df.select("item_id", F.array_join(F.transform("t", lambda x: x["token"]), " ").alias("tokens"), placed.alias("placed"))


def _counts(table: str) -> str:
    return f"(SELECT token, count(*) AS frequency FROM (SELECT unnest({_WORDS}) AS token FROM {table}) GROUP BY token)"



@query("token_frequency", f"SELECT token, frequency FROM {_counts('documents')}")
def token_frequency(spark, d):
    return frequency.token_frequency(load(spark, d, "documents"), "text").select("token", "frequency")


@query("tokenizer_models", r"SELECT 'whitespace' AS model, token, count(*) AS frequency FROM (SELECT unnest(regexp_extract_all(text, '\S+')) AS token FROM benchmark) GROUP BY ALL UNION ALL SELECT 'characters', token, count(*) FROM (SELECT unnest(regexp_extract_all(text, '\S')) AS token FROM benchmark) GROUP BY ALL UNION ALL SELECT 'initials', token, count(*) FROM (SELECT substr(unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')), 1, 1) AS token FROM benchmark) GROUP BY ALL")
def tokenizer_models(spark, d):
    """Two tokenizers that come with the library, and one that is plugged in."""
    frequency.TOKENIZERS["initials"] = lambda text: F.transform(frequency.words(text), lambda w: F.substring(w, 1, 1))
    names = ("whitespace", "characters", "initials")
    parts = [frequency.token_frequency(load(spark, d, "benchmark"), "text", n).select(F.lit(n).alias("model"), "token", "frequency") for n in names]
    return reduce(DataFrame.union, parts)


@query("token_counts", f"SELECT lang, token, count(*) AS frequency FROM (SELECT lang, unnest({_WORDS}) AS token FROM documents) GROUP BY ALL")
def token_counts(spark, d):
    return load(spark, d, "documents").select("lang", F.explode(frequency.words(F.col("text"))).alias("token")).groupBy("lang", "token").agg(F.count("*").alias("frequency"))


@query("per_million", f"SELECT token, cast(round(frequency / (sum(frequency) OVER ()) * 1000000) AS bigint) AS per_million FROM {_counts('benchmark')}")
def per_million(spark, d):
    return frequency.token_frequency(load(spark, d, "benchmark"), "text").select("token", "per_million")


@query("stop_words", f"SELECT token, frequency FROM {_counts('benchmark')} WHERE token NOT IN ('the', 'of', 'and')")
def stop_words(spark, d):
    return frequency.without_stop_words(frequency.token_frequency(load(spark, d, "benchmark"), "text"), ["The", "of", "and"]).select("token", "frequency")


@query("token_wildcard", f"SELECT token, frequency FROM {_counts('documents')} WHERE regexp_matches(token, '^th.*e.$')")
def token_wildcard(spark, d):
    return frequency.token_wildcard(frequency.token_frequency(load(spark, d, "documents"), "text"), "TH*e?").select("token", "frequency")


_KEY = f"""
WITH s AS {_counts("(SELECT text FROM documents WHERE lang = 'en')")}, r AS {_counts("benchmark")},
c AS (SELECT coalesce(s.token, r.token) AS token, coalesce(s.frequency, 0) AS a, coalesce(r.frequency, 0) AS b FROM s FULL JOIN r ON s.token = r.token),
t AS (SELECT *, cast(sum(a) OVER () AS double) AS na, cast(sum(b) OVER () AS double) AS nb FROM c),
e AS (SELECT *, na * (a + b) / (na + nb) AS ea, nb * (a + b) / (na + nb) AS eb, a / na * 100 AS pa, b / nb * 100 AS pb FROM t),
l AS (SELECT *, 2 * (CASE WHEN a > 0 THEN a * ln(a / ea) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b / eb) ELSE 0 END) AS ll FROM e)
SELECT token, cast(a AS bigint) AS freq_study, cast(b AS bigint) AS freq_reference, round(ll, 4) AS ll, round(ll - ln(na + nb), 4) AS bic,
       round(log2((CASE WHEN a = 0 THEN 0.5 ELSE a END / na) / (CASE WHEN b = 0 THEN 0.5 ELSE b END / nb)), 4) AS log_ratio,
       CASE WHEN ll >= 15.13 THEN '****' WHEN ll >= 10.83 THEN '***' WHEN ll >= 6.63 THEN '**' WHEN ll >= 3.84 THEN '*' ELSE 'n.s.' END AS significance, pa > pb AS overuse
FROM l
"""


@query("keyness", _KEY)
def keyness(spark, d):
    study = frequency.token_frequency(load(spark, d, "documents").where("lang = 'en'"), "text")
    found = frequency.keyness(study, frequency.token_frequency(load(spark, d, "benchmark"), "text"))
    near = lambda c, name: F.round(c, 4).alias(name)
    return found.select("token", "freq_study", "freq_reference", near("log_likelihood_llv", "ll"), near("bayes_factor_bic", "bic"), near("log_ratio", "log_ratio"), "significance", "overuse")


# Concordance

def _hits(spark, d, contexts=True):
    return kwic.concordance(load(spark, d, "documents").select("doc_id", "lang", "text"), "text", "the", 3, 3, whole_word=True, contexts=contexts)


_PARTS = r"""
p AS (SELECT doc_id, text, regexp_split_to_array(text, '(?i)the') AS g, regexp_extract_all(text, '(?i)the') AS m FROM documents WHERE regexp_matches(text, '(?i)the')),
i AS (SELECT doc_id, text, g, m, unnest(range(1, len(m) + 1)) AS k FROM p),
h AS (SELECT doc_id, text, m[k] AS matched_text, k - 1 AS match_index,
      list_sum(list_transform(list_slice(g, 1, k), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, k - 1), lambda x: length(x))), 0) AS s FROM i),
w AS (SELECT doc_id, text, matched_text, cast(s AS bigint) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS match_index FROM h
      WHERE NOT regexp_matches(coalesce(nullif(substr(text, cast(s AS bigint), 1), ''), ' '), '[\p{L}\p{M}\p{N}_]')
      AND NOT regexp_matches(coalesce(nullif(substr(text, cast(s AS bigint) + 4, 1), ''), ' '), '[\p{L}\p{M}\p{N}_]'))
"""


# contexts of three words on either side, the nearest words, and their case-folded frequencies
_W, _N = r"[\p{L}\p{M}\p{N}_]", r"[^\p{L}\p{M}\p{N}_]"
_CONTEXTS = _PARTS + rf""",
c AS (SELECT *, reverse(regexp_extract(reverse(substr(text, 1, s)), '^((?:{_N}*{_W}+){{0,3}})', 1)) AS a, regexp_extract(substr(text, s + 4), '^((?:{_N}*{_W}+){{0,3}})', 1) AS b FROM w),
n AS (SELECT *, regexp_extract(a, '({_W}+){_N}*$', 1) AS l1, regexp_extract(b, '^{_N}*({_W}+)', 1) AS r1 FROM c),
q AS (SELECT *, CASE WHEN l1 <> '' THEN count(*) OVER (PARTITION BY lower(l1)) END AS l1_freq, CASE WHEN r1 <> '' THEN count(*) OVER (PARTITION BY lower(r1)) END AS r1_freq FROM n)
"""


@query("kwic_text", f"WITH {_CONTEXTS} SELECT doc_id, match_index, a AS left_context, matched_text, b AS right_context, s AS start_idx, s + 3 AS end_idx, l1, r1 FROM n")
def kwic_text(spark, d):
    """Each hit as it is found: its contexts, its place and its nearest words."""
    rows = _hits(spark, d).select("doc_id", F.posexplode("hits").alias("i", "h"))
    return rows.select("doc_id", F.col("i").cast("bigint").alias("match_index"), *(f"h.{c}" for c in ("left_context", "matched_text", "right_context", "start_idx", "end_idx", "l1", "r1")))


QUERIES["kwic_whole_word"] = lambda spark, d: kwic.concordance(load(spark, d, "documents").select("doc_id", "text"), "text", "licen[sc]ed?", 2, 2, regex=True, whole_word=True).select("doc_id", F.size("hits").cast("bigint").alias("n"))
ORACLE_SQL["kwic_whole_word"] = r"SELECT doc_id, len(regexp_extract_all(text, '(?i)\blicen[sc]ed?\b')) AS n FROM documents WHERE regexp_matches(text, '(?i)\blicen[sc]ed?\b')"


@query("kwic_match_rows", f"WITH {_CONTEXTS} SELECT doc_id, match_index, s AS start_idx, matched_text, l1_freq, r1_freq FROM q")
def kwic_match_rows(spark, d):
    return kwic.match_rows(_hits(spark, d)).select("doc_id", "match_index", "start_idx", "matched_text", "l1_freq", "r1_freq")


@query("kwic_context", f"WITH {_CONTEXTS} SELECT doc_id, match_index, a AS left_context, matched_text, b AS right_context, l1, r1, l1_freq, r1_freq FROM q")
def kwic_context(spark, d):
    return kwic.match_rows(_hits(spark, d)).select("doc_id", "match_index", "left_context", "matched_text", "right_context", "l1", "r1", "l1_freq", "r1_freq")


@query("kwic_edges", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)^[^\p{L}\p{M}\p{N}_]*the\b')")
def kwic_edges(spark, d):
    return _hits(spark, d).where(F.exists("hits", lambda h: (h["l1"] == "") & (F.rlike(h["left_context"], F.lit(r"(?U)^\W*$"))))).select("doc_id")


@query("kwic_extraction", f"WITH {_CONTEXTS} SELECT doc_id, s AS start_idx, a || matched_text || b AS extraction FROM q")
def kwic_extraction(spark, d):
    return _hits(spark, d).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.start_idx", "h.extraction")


_RUN = f"WITH {_CONTEXTS} SELECT doc_id, lang, string_agg(concat_ws('|', a, matched_text, b, s, coalesce(l1_freq, 0), coalesce(r1_freq, 0)), '~' ORDER BY s) AS hits FROM (SELECT q.*, lang FROM q JOIN documents USING (doc_id)) GROUP BY doc_id, lang"


def _run_rows(result):
    shown = lambda h: F.concat_ws("|", h["CONC_left_context"], h["CONC_matched_text"], h["CONC_right_context"], h["CONC_start_idx"], F.coalesce(h["CONC_l1_freq"], F.lit(0)), F.coalesce(h["CONC_r1_freq"], F.lit(0)))
    return result.select("doc_id", "lang", F.array_join(F.transform("concordance", shown), "~").alias("hits"))


@query("kwic_run", _RUN)
def kwic_run(spark, d):
    return _run_rows(kwic.run(load(spark, d, "documents").select("doc_id", "lang", "text"), "text", "doc_id", "the", 3, 3, whole_word=True))


@query("kwic_rerun", _RUN)
def kwic_rerun(spark, d):
    """On a block that has the columns of an earlier run, its text among them."""
    before = load(spark, d, "documents").select("doc_id", "lang", F.col("text").alias("CONC_extraction"), F.lit("old").alias("CONC_l1"), F.lit("mine").alias("CONC_source"))
    result = kwic.run(before, "CONC_extraction", "doc_id", "the", 3, 3, whole_word=True)
    if result.columns != ["doc_id", "lang", "CONC_source_2", "CONC_source", "concordance"]:
        raise ValueError(result.columns)
    return _run_rows(result)


_LINES = r"string_agg(trim(regexp_replace(a || matched_text || b, '\s+', ' ', 'g')), chr(10) ORDER BY s)"


@query("kwic_document_rows", f"WITH {_CONTEXTS} SELECT doc_id, {_LINES} AS extractions FROM q GROUP BY doc_id")
def kwic_document_rows(spark, d):
    return kwic.document_rows(_hits(spark, d)).select("doc_id", "extractions")


@query("kwic_add_document", f"WITH {_CONTEXTS} SELECT lang, cast(len(text) AS bigint) AS n_chars, {_LINES} AS extractions FROM (SELECT q.*, lang FROM q JOIN documents USING (doc_id)) GROUP BY doc_id, lang, text")
def kwic_add_document(spark, d):
    """A new block of the documents with hits, their other columns beside the extractions."""
    return kwic.document_rows(_hits(spark, d)).select("lang", F.length("text").cast("bigint").alias("n_chars"), "extractions")


_BIN = "least(cast(floor(s * {0} / length(text)) AS bigint), {0} - 1)"


@query("kwic_document_filter", f"WITH {_PARTS} SELECT doc_id, count(*) AS n FROM w WHERE matched_text <> 'The' AND {_BIN.format(4)} IN (0, 3) GROUP BY doc_id")
def kwic_document_filter(spark, d):
    return kwic.document_filter(_hits(spark, d, contexts=False), "text", ["The"], 4, [0, 3]).select("doc_id", F.size("hits").cast("bigint").alias("n"))


@query("kwic_density", f"WITH {_PARTS} SELECT matched_text, {_BIN.format(100)} AS bin, count(*) AS n FROM w GROUP BY ALL")
def kwic_density(spark, d):
    return kwic.density(_hits(spark, d, contexts=False), "text")


ORACLE_SQL["density_bins"] = ORACLE_SQL["kwic_density"]
QUERIES["density_bins"] = kwic_density


@query("page_size_probe", f"WITH {_PARTS}, n AS (SELECT doc_id, count(*) AS c FROM w GROUP BY 1), r AS (SELECT doc_id, sum(coalesce(c, 0)) OVER (ORDER BY doc_id) AS s, row_number() OVER (ORDER BY doc_id) AS k FROM documents LEFT JOIN n USING (doc_id)) SELECT cast(coalesce(min(size) FILTER (s >= 10), 100) AS bigint) AS size FROM r, (VALUES (10), (20), (50), (100)) v(size) WHERE k = size")
def page_size_probe(spark, d):
    docs = load(spark, d, "documents").select("doc_id")
    found = _hits(spark, d, contexts=False).select("doc_id", F.size("hits").alias("n"))
    counted = docs.join(found, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"))
    return spark.createDataFrame([(pages.page_size_probe(counted, "doc_id", "n"),)], "size bigint")


@query("kwic_dispersion", f"WITH {_PARTS}, b AS (SELECT lower(matched_text) AS series, {_BIN.format(100)} AS b FROM w) SELECT series, cast(floor(b * 10 / 100) AS bigint) AS bin, count(*) AS n FROM b GROUP BY ALL")
def kwic_dispersion(spark, d):
    return kwic.dispersion(kwic.density(_hits(spark, d, contexts=False), "text"), 10, fold_case=True)


@query("kwic_tokens", f"SELECT doc_id, array_to_string(list_filter({_WORDS}, lambda w: w IN ('the', 'of')), ',') AS found FROM documents WHERE len(list_filter({_WORDS}, lambda w: w IN ('the', 'of'))) > 0")
def kwic_tokens(spark, d):
    df = load(spark, d, "documents").withColumn("tokens", frequency.tokenize(F.col("text")))
    hits = kwic.concordance_tokens(df, "text", "tokens", "the, of", 2, 2)
    return hits.select("doc_id", F.array_join(F.transform("hits", lambda h: F.lower(h["matched_text"])), ",").alias("found"))


@query("kwic_combined", "SELECT 'documents' AS source_block, cast(doc_id AS varchar) AS id FROM documents WHERE contains(lower(text), 'ing ') UNION ALL SELECT 'benchmark', cast(item_id AS varchar) FROM benchmark WHERE contains(lower(text), 'ing ')")
def kwic_combined(spark, d):
    parts = {"documents": "doc_id", "benchmark": "item_id"}
    return kwic.combined({n: kwic.concordance(load(spark, d, n).select(F.col(k).cast("string").alias("id"), "text"), "text", "ing ").select("id") for n, k in parts.items()})


@query("kwic_add_match", f"WITH {_PARTS} SELECT doc_id, match_index, matched_text FROM w")
def kwic_add_match(spark, d):
    return kwic.sort_matches(kwic.match_rows(_hits(spark, d)), "matched_text", "doc_id").select("doc_id", "match_index", "matched_text")


@query("result_sort", f"WITH {_CONTEXTS} SELECT doc_id, match_index, matched_text, row_number() OVER (ORDER BY nullif(lower(l1), '') DESC NULLS LAST, doc_id, match_index) - 1 AS place FROM q")
def result_sort(spark, d):
    rows = kwic.match_rows(_hits(spark, d).select("doc_id", "hits")).select("doc_id", "match_index", "matched_text", "l1")
    return kwic.place_matches(rows, "l1", "doc_id", descending=True).drop("l1")


# Windows

@query("w_row_number", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events")
def w_row_number(spark, d):
    return load(spark, d, "events").select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint").alias("n"))


@query("w_count", "SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n FROM events")
def w_count(spark, d):
    return load(spark, d, "events").select("event_id", F.count("*").over(Window.partitionBy("user_id")).alias("n"))


@query("w_min", "SELECT event_id, min(event_id) OVER (PARTITION BY user_id) AS first FROM events")
def w_min(spark, d):
    return load(spark, d, "events").select("event_id", F.min("event_id").over(Window.partitionBy("user_id")).alias("first"))


@query("w_dense_rank", "SELECT c_custkey, dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS r FROM customer")
def w_dense_rank(spark, d):
    return load(spark, d, "customer").select("c_custkey", F.dense_rank().over(Window.partitionBy("c_mktsegment").orderBy("c_nationkey")).cast("bigint").alias("r"))


@query("w_lag_cumsum", "SELECT event_id, cast(sum(c) OVER (PARTITION BY user_id ORDER BY event_id) % 2 AS bigint) AS band FROM (SELECT event_id, user_id, cast(coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), false) AS int) AS c FROM events)")
def w_lag_cumsum(spark, d):
    by = Window.partitionBy("user_id").orderBy("event_id")
    df = load(spark, d, "events").withColumn("c", F.coalesce(F.col("event_type") != F.lag("event_type").over(by), F.lit(False)).cast("int"))
    return df.select("event_id", (F.sum("c").over(by.rowsBetween(Window.unboundedPreceding, 0)) % 2).cast("bigint").alias("band"))


# Trends

_TEXT = {"second": "%Y-%m-%d %H:%M:%S", "minute": "%Y-%m-%d %H:%M", "hourly": "%Y-%m-%d %H:%M", "daily": "%Y-%m-%d", "monthly": "%Y-%m", "yearly": "%Y", "weekly": "%Y-W%W"}


def _trend(unit: str) -> None:
    def run(spark, d):
        axis = F.col("ts").cast("timestamp")
        counted = trends.counts(load(spark, d, "events"), axis, trends.period(axis, unit), ["event_type"])
        return counted.select(trends.label(F.col("period"), unit).alias("label"), "event_type", "sequential_count", "period_index", "group_index")

    part = trends.UNITS[unit]
    text = f"strftime(period, '{_TEXT[unit]}')" if unit != "quarterly" else "year(period) || '-Q' || quarter(period)"
    QUERIES[f"tr_{unit}"] = run
    ORACLE_SQL[f"tr_{unit}"] = f"SELECT {text} AS label, event_type, n AS sequential_count, dense_rank() OVER (ORDER BY period) - 1 AS period_index, dense_rank() OVER (ORDER BY event_type) - 1 AS group_index FROM (SELECT date_trunc('{part}', ts) AS period, event_type, count(*) AS n FROM events GROUP BY ALL)"


for _unit in trends.UNITS:
    _trend(_unit)
_QUARTER = "year(t) || '-Q' || quarter(t)"
_LABELS = " UNION ALL ".join(f"SELECT '{u}' AS unit, {_QUARTER if u == 'quarterly' else f'strftime(date_trunc({chr(39)}{p}{chr(39)}, t), {chr(39)}{_TEXT[u]}{chr(39)})'} AS label, count(*) AS n FROM (SELECT o_orderdate AS t FROM orders) GROUP BY ALL" for u, p in trends.UNITS.items())


@query("tr_labels", _LABELS)
def tr_labels(spark, d):
    """The label of every order's date in each of the units."""
    axis = F.col("o_orderdate").cast("timestamp")
    pairs = [F.struct(F.lit(u).alias("unit"), trends.label(trends.period(axis, u), u).alias("label")) for u in trends.UNITS]
    return load(spark, d, "orders").select(F.explode(F.array(*pairs)).alias("x")).groupBy("x.unit", "x.label").agg(F.count("*").alias("n"))


@query("tr_counts", """
WITH g AS (SELECT date_trunc('hour', ts) AS period, nullif(event_type, (SELECT min(event_type) FROM events)) AS kind, user_id % 2 AS half, count(*) AS n, min(ts) AS a, max(ts) AS b FROM events GROUP BY ALL)
SELECT strftime(period, '%Y-%m-%d %H') AS label, kind, half, n AS sequential_count, strftime(a, '%H:%M:%S') AS first, strftime(b, '%H:%M:%S') AS last,
       dense_rank() OVER (ORDER BY period) - 1 AS period_index, dense_rank() OVER (ORDER BY kind NULLS LAST, half NULLS LAST) - 1 AS group_index FROM g
""")
def tr_counts(spark, d):
    """Hours by two groups, one of which is null for some rows: first and last times, and dense places."""
    events = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    least = events.agg(F.min("event_type")).first()[0]
    rows = events.select("ts", F.nullif("event_type", F.lit(least)).alias("kind"), (F.col("user_id") % 2).alias("half"))
    counted = trends.counts(rows, F.col("ts"), trends.period(F.col("ts"), "hourly"), ["kind", "half"])
    shown = lambda c, pattern: F.date_format(c, pattern)
    return counted.select(shown("period", "yyyy-MM-dd HH").alias("label"), "kind", "half", "sequential_count", shown("period_start", "HH:mm:ss").alias("first"), shown("period_end", "HH:mm:ss").alias("last"), "period_index", "group_index")


@query("tr_custom", "SELECT strftime(make_timestamp(cast(floor(epoch(ts) / 21600) * 21600 AS bigint) * 1000000), '%Y-%m-%d %H') AS label, count(*) AS sequential_count FROM events GROUP BY 1")
def tr_custom(spark, d):
    axis = F.col("ts").cast("timestamp")
    counted = trends.counts(load(spark, d, "events"), axis, trends.custom_period(axis, 6, "hours"), [])
    return counted.select(F.date_format("period", "yyyy-MM-dd HH").alias("label"), "sequential_count")


@query("tr_custom_weeks", "SELECT strftime(make_timestamp(cast(floor((epoch(ts) - 345600) / 1209600) * 1209600 + 345600 AS bigint) * 1000000), '%Y-%m-%d') AS label, count(*) AS sequential_count FROM events GROUP BY 1")
def tr_custom_weeks(spark, d):
    axis = F.col("ts").cast("timestamp")
    counted = trends.counts(load(spark, d, "events"), axis, trends.custom_period(axis, 2, "weeks"), [])
    return counted.select(F.date_format("period", "yyyy-MM-dd").alias("label"), "sequential_count")


@query("tr_elapsed", "SELECT floor((epoch_us(ts) % 86400000000) / 900000000) * 900 AS period, count(*) AS sequential_count FROM events GROUP BY 1")
def tr_elapsed(spark, d):
    from lexigrid.functions import elapsed

    df = load(spark, d, "events").withColumn("clock", elapsed.from_timestamp(F.col("ts")))
    return trends.counts(df, F.col("clock"), trends.elapsed_period(F.col("clock"), 900), []).select("period", "sequential_count")


@query("tr_category", "SELECT lang AS period, count(*) AS sequential_count, dense_rank() OVER (ORDER BY lang) - 1 AS period_index FROM documents GROUP BY lang")
def tr_category(spark, d):
    at = trends.category(F.col("lang"))
    return trends.counts(load(spark, d, "documents"), F.col("lang"), at, []).select("period", "sequential_count", "period_index")


@query("tr_numeric", "SELECT cast(floor(cast(value AS decimal(38,18)) / 2.5) AS bigint) AS period, count(*) AS sequential_count FROM (SELECT cast(value AS varchar) AS value FROM events WHERE value IS NOT NULL) GROUP BY 1")
def tr_numeric(spark, d):
    return trends.counts(load(spark, d, "events"), F.col("value"), trends.numeric_bin(F.col("value"), "2.5"), []).select("period", "sequential_count")


@query("tr_numeric_label", "SELECT '[' || (p_size // 10) * 10 || ', ' || ((p_size // 10) * 10 + 10) || ')' AS label, count(*) AS sequential_count FROM part GROUP BY 1")
def tr_numeric_label(spark, d):
    counted = trends.counts(load(spark, d, "part"), F.col("p_size"), trends.numeric_bin(F.col("p_size"), "10"), [])
    return counted.select(trends.numeric_label(F.col("period"), "10").alias("label"), "sequential_count")


@query("tr_publication", "SELECT event_id, dense_rank() OVER (ORDER BY date_trunc('day', ts)) - 1 AS period_index, dense_rank() OVER (ORDER BY event_type) - 1 AS group_index FROM events")
def tr_publication(spark, d):
    df, axis = load(spark, d, "events"), F.col("ts").cast("timestamp")
    counted = trends.counts(df, axis, trends.period(axis, "daily"), ["event_type"])
    return trends.publication(df, trends.period(axis, "daily"), ["event_type"], counted).select("event_id", "period_index", "group_index")


_REF = r"""
WITH m AS (SELECT source AS period, lang, count(*) AS n FROM documents WHERE contains(lower(text), 'license') GROUP BY ALL),
r AS (SELECT source AS period, lang, count(*) AS reference_rows, cast(sum(len(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+'))) AS bigint) AS reference_words FROM documents GROUP BY ALL),
c AS (SELECT * FROM (SELECT period FROM m UNION SELECT period FROM r), (SELECT DISTINCT lang FROM m))
SELECT c.period, c.lang, coalesce(n, 0) AS sequential_count, coalesce(reference_rows, 0) AS reference_rows, coalesce(reference_words, 0) AS reference_words
FROM c LEFT JOIN m ON c.period = m.period AND c.lang IS NOT DISTINCT FROM m.lang LEFT JOIN r ON c.period = r.period AND c.lang IS NOT DISTINCT FROM r.lang
"""


def _reference(spark, d):
    docs = load(spark, d, "documents")
    found = filters.filter_rows(docs, [Condition("text", "contains", "license")])
    counted = trends.counts(found, F.col("source"), F.col("source"), ["lang"])
    reference = docs.groupBy(F.col("source").alias("period"), "lang").agg(F.count("*").alias("reference_rows"), F.sum(F.size(frequency.words(F.col("text")))).alias("reference_words"))
    return trends.with_reference(counted, reference, ["lang"])


@query("tr_reference", _REF)
def tr_reference(spark, d):
    return _reference(spark, d)


@query("tr_scales", f"SELECT period, lang, round(sequential_count * 100.0 / nullif(sum(sequential_count) OVER (PARTITION BY period), 0), 6) AS composition, round(CASE WHEN reference_rows >= 10 THEN sequential_count * 1e6 / reference_words END, 6) AS per_million, round(CASE WHEN reference_rows >= 10 THEN sequential_count * 100.0 / reference_rows END, 6) AS percent_rows FROM ({_REF})")
def tr_scales(spark, d):
    return trends.scales(_reference(spark, d)).select("period", "lang", "composition", "per_million", "percent_rows")


@query("tr_add", "SELECT event_id FROM events WHERE strftime(ts, '%Y-%m-%d') IN ('2024-01-03', '2024-01-04') AND event_type <> 'view'")
def tr_add(spark, d):
    label = trends.label(trends.period(F.col("ts").cast("timestamp"), "daily"), "daily")
    return load(spark, d, "events").where(label.isin("2024-01-03", "2024-01-04") & (F.col("event_type") != "view")).select("event_id")


@query("stream_windowed_counts", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS period, event_type, count(*) AS sequential_count FROM events GROUP BY ALL")
def stream_windowed_counts(spark, d):
    df = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = streaming.windowed_counts(df, "ts", "1 day", "1 hour", ["event_type"])
    return counted.select(F.date_format("period", "yyyy-MM-dd").alias("period"), "event_type", "sequential_count")


# Quotations

_MARKS = "\"“”„‟«»〝〞＂\n\r\t"
_PLAIN = f"translate(text, '{_MARKS}', '{' ' * len(_MARKS)}')"
#: Places do not depend on white space and invisible characters, which the rules read as one space or nothing.
_QUOTED = f"(SELECT doc_id, '\"' || {_PLAIN} || ',\" ' || CASE WHEN doc_id % 2 = 0 THEN 'said Anna Berg.' ELSE 'Anna Berg said.' END AS text, length(text) AS n FROM documents WHERE length(text) >= 2)"
_EVEN = "CASE WHEN doc_id % 2 = 0 THEN"
_QUOTE_FIELDS = {
    "speaker": "'Anna Berg'", "speaker_start_idx": f"{_EVEN} n + 9 ELSE n + 4 END", "speaker_end_idx": f"{_EVEN} n + 18 ELSE n + 13 END",
    "quote": "substr(text, 1, n + 3)", "quote_start_idx": "0", "quote_end_idx": "n + 3",
    "verb": "'said'", "verb_start_idx": f"{_EVEN} n + 4 ELSE n + 14 END", "verb_end_idx": f"{_EVEN} n + 8 ELSE n + 18 END",
    "quote_type": f"{_EVEN} 'QCQVS' ELSE 'QCQSV' END", "is_floating_quote": "false", "quote_row_idx": "0",
}
_QUOTE_SQL = f"SELECT doc_id, {', '.join(f'{v} AS QUOTE_{k}' for k, v in _QUOTE_FIELDS.items())} FROM {_QUOTED}"


def _quoted(spark, d):
    """Every whole text as what somebody says."""
    docs = load(spark, d, "documents").where(F.length("text") >= 2)
    who = F.when(F.col("doc_id") % 2 == 0, "said Anna Berg.").otherwise("Anna Berg said.")
    return docs.select("doc_id", F.concat(F.lit('"'), F.translate("text", _MARKS, " " * len(_MARKS)), F.lit('," '), who).alias("text"))


@query("quote_local", _QUOTE_SQL)
def quote_local(spark, d):
    found = quotations.extract(_quoted(spark, d), "text").select("doc_id", F.explode("quotation").alias("q"))
    return found.select("doc_id", *(F.col(f"q.{k}").alias(f"QUOTE_{k}") for k in _QUOTE_FIELDS))


@query("quote_add", f"SELECT doc_id, lang, {', '.join(f'{v} AS QUOTE_{k}' for k, v in _QUOTE_FIELDS.items())} FROM {_QUOTED} JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)")
def quote_add(spark, d):
    """A row for each quotation with a column of its document; an earlier column of the same name is replaced."""
    docs = _quoted(spark, d).join(load(spark, d, "documents").select("doc_id", "lang", F.lit("old").alias("QUOTE_speaker")), "doc_id")
    return quotations.add(quotations.extract(docs, "text")).drop("text", "QUOTE_quote_token_count")


@query("quote_run", f"SELECT doc_id, QUOTE_quote_type AS type, QUOTE_speaker AS speaker FROM ({_QUOTE_SQL}) UNION ALL SELECT doc_id + 1000000000, QUOTE_quote_type, QUOTE_speaker FROM ({_QUOTE_SQL})")
def quote_run(spark, d):
    """All texts twice, under other keys: each distinct text is parsed once."""
    docs = _quoted(spark, d)
    twice = docs.union(docs.select(F.col("doc_id") + 1_000_000_000, "text"))
    done = quotations.run(twice, "text", f"{shared_folder(spark)}/quotations-{uuid4().hex}", parts=4)
    return done.select("doc_id", F.explode("quotation").alias("q")).select("doc_id", F.col("q.quote_type").alias("type"), F.col("q.speaker").alias("speaker"))


@query("quote_preview", f"SELECT doc_id, 1 AS quotations FROM {_QUOTED} ORDER BY doc_id LIMIT 20")
def quote_preview(spark, d):
    """The first page of documents that have quotations."""
    page, _, _ = quotations.preview(_quoted(spark, d), "doc_id", "text", 20)
    return page.select("doc_id", F.size("quotation").alias("quotations"))


@query("quote_heuristic")
def quote_heuristic(spark, d):
    """Quotations in the documents as they are, by the short rules."""
    return quotes.quote_rows(quotes.find_quotes(load(spark, d, "documents").select("doc_id", "text"), "text"))


@query("quote_types", r"""SELECT doc_id, type, count(*) AS n FROM (SELECT doc_id, unnest([CASE WHEN i % 3 = 0 THEN 'QVS' WHEN i % 3 = 1 THEN 'SVQ' ELSE 'AccordingTo' END, 'Heuristic']) AS type FROM (SELECT doc_id, doc_id % 3 AS i FROM documents)) GROUP BY ALL""")
def quote_types(spark, d):
    """A sentence of each type built around every document's first word, and a quotation without a speaker."""
    word = F.regexp_extract(F.concat("text", F.lit(" none")), r"(?U)(\w+)", 1)
    kinds = [F.concat(F.lit('"Go '), word, F.lit('," said Anna Berg. ')), F.concat(F.lit('Mr Holt warned: "Not '), word, F.lit('." ')), F.concat(F.lit('According to Anna Berg, "it is '), word, F.lit('". '))]
    at = F.element_at(F.array(*kinds), (F.col("doc_id") % 3 + 1).cast("int"))
    made = load(spark, d, "documents").select("doc_id", F.concat(at, F.lit('Then came 12345678901234567890123456789012345678901234567890123456789012345678901234567890123456789 the word "'), word, F.lit('x" alone.')).alias("text"))
    return quotes.quote_rows(quotes.find_quotes(made, "text")).groupBy("doc_id", F.col("QUOTE_quote_type").alias("type")).agg(F.count("*").alias("n"))


# Topics: the label of a vector is its main topic, with the rest left to others

def _coverage(spark, d):
    vectors = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), "label")
    shares = ((F.col("label").cast("bigint"), 0.5), ((F.col("label") + 1) % 10, 0.3), (F.lit(-1), 0.2))
    return vectors.select("doc", F.explode(F.array(*(F.struct(t.cast("bigint").alias("topic_id"), F.lit(c).alias("coverage")) for t, c in shares))).alias("x")).select("doc", "x.*")


_COVER = "(SELECT vec_id AS doc, label AS topic_id, 0.5 AS coverage FROM embeddings UNION ALL SELECT vec_id, (label + 1) % 10, 0.3 FROM embeddings UNION ALL SELECT vec_id, -1, 0.2 FROM embeddings)"
_MERGED = "CASE topic_id WHEN 1 THEN 0 WHEN 3 THEN 2 ELSE topic_id END"


@query("topic_project", f"SELECT doc, {_MERGED} AS topic_id, round(cast(sum(coverage) AS double), 6) AS coverage FROM {_COVER} GROUP BY 1, 2")
def topic_project(spark, d):
    into = topics.cut_merges(list(range(10)), [(0, 1), (2, 3), (4, 5)], 8)
    return topics.project(_coverage(spark, d), into).withColumn("coverage", F.round("coverage", 6))


@query("topic_model")
def topic_model(spark, d):
    """Topics of the vectors by density, each vector in several with a share of each."""
    return density.cluster(load(spark, d, "embeddings"), "vec_id", "embedding", least=5)


def _vector_topics(spark, d):
    """The direction of each label's vectors."""
    return topic_tree.centroids(load(spark, d, "embeddings"), "label", "embedding")


@query("topic_merge_tree")
def topic_merge_tree(spark, d):
    return topic_tree.merge_tree(*_vector_topics(spark, d))


@query("topic_project_tree")
def topic_project_tree(spark, d):
    """Coverage when the tree of all topics is cut to four."""
    found, width = _vector_topics(spark, d)
    found = written(found)
    return topic_tree.project(_coverage(spark, d), topic_tree.cut(found, topic_tree.merge_tree(found, width), 4)).withColumn("coverage", F.round("coverage", 6))


_LABELLED = f"(SELECT label AS topic_id, unnest({_WORDS}) AS term FROM documents JOIN embeddings ON doc_id = vec_id)"


@query("topic_terms", f"""WITH c AS (SELECT topic_id, term, count(*) AS occurrences FROM {_LABELLED} GROUP BY ALL),
z AS (SELECT topic_id, sum(occurrences) AS size FROM c GROUP BY ALL), e AS (SELECT term, sum(occurrences) AS every FROM c GROUP BY ALL),
s AS (SELECT topic_id, term, occurrences, round(occurrences / size * ln(1 + (SELECT avg(size) FROM z) / every), 12) AS score FROM c JOIN z USING (topic_id) JOIN e USING (term))
SELECT topic_id, place, term, occurrences, score FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, term) AS place FROM s) WHERE place <= 10""")
def topic_terms(spark, d):
    """The ten terms that set each topic apart; a document's topic is the label of its vector."""
    labelled = load(spark, d, "documents").join(load(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    return topic_tree.terms(labelled.select(F.col("label").alias("topic_id"), frequency.words(F.col("text")).alias("words")), 10)


@query("topic_coverage", f"SELECT doc_id // 5 AS doc, topic_id, round(sum(length(text) * coverage) / any_value(total), 6) AS coverage FROM (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id // 5) AS total FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)) JOIN {_COVER} ON doc = doc_id GROUP BY 1, 2")
def topic_coverage(spark, d):
    """Every five documents are the segments of one; those without a vector are left out, so that none counts as an outlier."""
    shares = _coverage(spark, d).select(F.col("doc").alias("segment"), "topic_id", F.col("coverage").alias("membership"))
    parts = load(spark, d, "documents").join(shares.select(F.col("segment").alias("doc_id")).distinct(), "doc_id", "left_semi")
    segments = parts.select(F.floor(F.col("doc_id") / 5).cast("bigint").alias("doc"), F.col("doc_id").alias("segment"), F.length("text").alias("characters"))
    return topic_tree.coverage(segments, shares).withColumn("coverage", F.round("coverage", 6))


@query("topic_top_n", f"SELECT doc, topic_id, r AS rank FROM (SELECT *, rank() OVER (PARTITION BY doc ORDER BY coverage DESC) AS r FROM {_COVER} WHERE topic_id >= 0) WHERE r <= 1")
def topic_top_n(spark, d):
    return topics.top_n(_coverage(spark, d), 1).select("doc", "topic_id", F.col("rank").cast("bigint").alias("rank"))


@query("topic_activations", f"SELECT 'all' AS corpus, topic_id, r AS minimum_n, count(*) AS documents FROM (SELECT *, rank() OVER (PARTITION BY doc ORDER BY coverage DESC) AS r FROM {_COVER} WHERE topic_id >= 0) GROUP BY ALL")
def topic_activations(spark, d):
    return topics.activations(_coverage(spark, d), F.lit("all")).select("corpus", "topic_id", F.col("minimum_n").cast("bigint").alias("minimum_n"), "documents")


@query("topic_colors", "SELECT label AS topic_id, CASE vec_id % 3 WHEN 0 THEN '(missing)' WHEN 1 THEN 'a' ELSE 'b' END AS value, count(*) AS documents FROM embeddings GROUP BY ALL")
def topic_colors(spark, d):
    kind = F.when(F.col("vec_id") % 3 == 1, "a").when(F.col("vec_id") % 3 == 2, "b")
    return topics.colors(_coverage(spark, d), load(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), kind.alias("kind")), "kind")


@query("topic_examples", f"SELECT topic_id, doc, place FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY coverage DESC, doc) AS place FROM {_COVER} WHERE topic_id >= 0) WHERE place <= 3")
def topic_examples(spark, d):
    return topics.examples(_coverage(spark, d), 3).select("topic_id", "doc", F.col("place").cast("bigint").alias("place"))


@query("topic_segment_lengths", f"SELECT quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.9) AS p90, quantile_disc(n, 0.95) AS p95, max(n) AS p100 FROM (SELECT len({_WORDS}) AS n FROM documents)")
def topic_segment_lengths(spark, d):
    df = load(spark, d, "documents").select(F.size(frequency.words(F.col("text"))).cast("bigint").alias("n"))
    return df.agg(*topics.segment_lengths("n"))


@query("topic_vectorizer_choice", r"SELECT n / c AS share, n / c >= 0.2 AS dictionary FROM (SELECT cast(sum(len(regexp_extract_all(text, '[\p{Han}\p{Hiragana}\p{Katakana}]'))) AS double) AS n, sum(len(regexp_extract_all(text, '\p{L}'))) AS c FROM (SELECT text FROM documents UNION ALL SELECT repeat('漢字かなカナ', 5) FROM documents))")
def topic_vectorizer_choice(spark, d):
    """Documents, and for each of them thirty characters of a script without spaces."""
    docs = load(spark, d, "documents").select("text")
    return topics.unspaced_share(docs.union(docs.select(F.repeat(F.lit("漢字かなカナ"), 5))), "text")


@query("topic_add_topics", "SELECT conv_id AS doc, len(role) AS topic_id, string_agg(text, chr(10) ORDER BY turn) AS text, cast(sum(length(text)) AS bigint) AS characters, count(*) AS segments FROM conversations GROUP BY 1, 2")
def topic_add_topics(spark, d):
    parts = load(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("position"), F.length("role").cast("bigint").alias("topic_id"), "text")
    return topics.add_topics(parts).drop("share")


@query("topic_add_documents", f"SELECT doc, string_agg(topic_id || ':' || coverage, ',' ORDER BY topic_id) AS coverage FROM {_COVER} GROUP BY doc")
def topic_add_documents(spark, d):
    wide = topics.with_coverage_array(_coverage(spark, d))
    return wide.select("doc", F.array_join(F.transform("coverage", lambda c: F.concat_ws(":", c["topic_id"], c["coverage"])), ",").alias("coverage"))


@query("topic_fingerprint")
def topic_fingerprint(spark, d):
    return topics.fingerprint(load(spark, d, "documents"), "doc_id", "text")


@query("f_topic_coverage", f"SELECT doc FROM {_COVER} WHERE topic_id = 3 GROUP BY doc HAVING sum(coverage) >= 0.4")
def f_topic_coverage(spark, d):
    wide = topics.with_coverage_array(_coverage(spark, d))
    return filters.filter_rows(wide, [Condition("coverage", "gte", 0.4, topic_id=3)]).select("doc")


# Annotation and agreement

@query("annot_label", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment END AS label FROM customer")
def annot_label(spark, d):
    return load(spark, d, "customer").select("c_custkey", annotations.label(F.concat(F.lit(" "), "c_mktsegment"), ["BUILDING", "MACHINERY"]).alias("label"))


@query("annot_run", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'kept' WHEN c_mktsegment <> 'BUILDING' THEN lower(c_mktsegment) END AS label FROM customer")
def annot_run(spark, d):
    """Labels of distinct texts, one of which failed and stays null, to the rows that have none yet."""
    customers = load(spark, d, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "kept").alias("label"))
    texts = customers.select(F.col("c_mktsegment").alias("text")).distinct()
    labels = texts.select("text", F.when(F.col("text") != "BUILDING", F.lower("text")).alias("label"))
    return annotations.fill_missing(customers, "label", "c_mktsegment", labels).select("c_custkey", "label")


@query("annot_examples", "SELECT c_custkey, c_mktsegment, place FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS place FROM customer) WHERE place <= 4")
def annot_examples(spark, d):
    return annotations.examples(load(spark, d, "customer"), "c_mktsegment", "c_custkey", 4).select("c_custkey", "c_mktsegment", "place")


@query("annot_row_filter", "SELECT doc_id FROM labels WHERE quality <> toxic")
def annot_row_filter(spark, d):
    return annotations.row_filter(load(spark, d, "labels"), "quality", ["toxic"], "differs").select("doc_id")


@query("annot_codebook_fit", "SELECT (SELECT count(*) FROM documents) AS filled, (SELECT count(*) FROM documents WHERE lang NOT IN ('en', 'fr')) AS non_codes, string_agg(lang, ', ' ORDER BY n DESC, lang) AS top_non_codes FROM (SELECT lang, count(*) AS n FROM documents WHERE lang NOT IN ('en', 'fr') GROUP BY lang ORDER BY n DESC, lang LIMIT 3)")
def annot_codebook_fit(spark, d):
    return annotations.codebook_fit(load(spark, d, "documents"), "lang", ["en", "fr"])


@query("agree_confusion", "SELECT cast(quality AS varchar) AS a, cast(toxic AS varchar) AS b, count(*) AS n FROM labels GROUP BY ALL")
def agree_confusion(spark, d):
    return agreement.confusion(load(spark, d, "labels"), "quality", "toxic")


def _coders(spark, d):
    return load(spark, d, "documents").select((F.col("doc_id") % 4).cast("string").alias("a"), (F.col("n_chars") % 4).cast("string").alias("b"), F.when(F.col("doc_id") % 5 > 0, (F.col("doc_id") % 3).cast("string")).alias("c"))


_PAIRS = "(SELECT doc_id % 4 AS a, n_chars % 4 AS b, count(*) AS n FROM documents GROUP BY ALL)"


def _agree(distance: str) -> str:
    return f"""
WITH p AS {_PAIRS}, t AS (SELECT cast(sum(n) AS double) AS n FROM p), a AS (SELECT a AS x, sum(n) AS m FROM p GROUP BY a), b AS (SELECT b AS y, sum(n) AS m FROM p GROUP BY b),
v AS (SELECT x, sum(n) AS m FROM (SELECT a AS x, n FROM p UNION ALL SELECT b, n FROM p) GROUP BY x),
o AS (SELECT sum(n * {distance.format("a", "b")}) AS d, sum(n) FILTER (a = b) AS same FROM p),
e AS (SELECT sum(a.m * b.m * {distance.format("a.x", "b.y")}) AS e FROM a, b), q AS (SELECT sum(v.m * w.m * {distance.format("v.x", "w.x")}) AS q FROM v, v AS w)
SELECT round(same * 100.0 / t.n, 6) AS percent, round(1 - (o.d / t.n) / (e.e / (t.n * t.n)), 6) AS kappa, round(1 - (o.d / t.n) / (q.q / (2 * t.n * (2 * t.n - 1))), 6) AS alpha FROM t, o, e, q"""


_NOMINAL, _SQUARED = _agree("cast({0} <> {1} AS double)"), _agree("(({0} - {1}) / 3.0) * (({0} - {1}) / 3.0)")


def _agreed(spark, d, scale=None):
    return agreement.agreement(agreement.confusion(_coders(spark, d), "a", "b"), scale)


for _name, _column, _scale, _oracle in (
    ("agree_percent", "percent", None, _NOMINAL),
    ("agree_kappa", "kappa", None, _NOMINAL),
    ("agree_alpha", "alpha", None, _NOMINAL),
    ("agree_kappa_weighted", "kappa", ["0", "1", "2", "3"], _SQUARED),
    ("agree_alpha_ordinal", "alpha", ["0", "1", "2", "3"], _SQUARED),
):
    QUERIES[_name] = lambda spark, d, c=_column, s=_scale: _agreed(spark, d, s).select(c)
    ORACLE_SQL[_name] = f"SELECT {_column} FROM ({_oracle})"


@query(
    "agree_multi",
    """
WITH u AS (SELECT doc_id, unnest(range(1, len(v) + 1)) AS i, v, len(v) AS k FROM (SELECT doc_id, list_filter([doc_id % 4, n_chars % 4, CASE WHEN doc_id % 5 > 0 THEN doc_id % 3 END], lambda x: x IS NOT NULL) AS v FROM documents) WHERE len(v) > 1),
f AS (SELECT doc_id, i, v[i] AS x, k FROM u), t AS (SELECT count(*) AS n FROM f),
d AS (SELECT sum(1.0 / (a.k - 1)) AS d FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.i <> b.i WHERE a.x <> b.x),
m AS (SELECT x, count(*) AS m FROM f GROUP BY x), e AS (SELECT sum(a.m * b.m) AS e FROM m a, m b WHERE a.x <> b.x)
SELECT n AS n_values, round(1 - (n - 1) * d / e, 6) AS alpha FROM t, d, e""",
)
def agree_multi(spark, d):
    return agreement.multi_alpha(_coders(spark, d), ["a", "b", "c"])
