"""Registered queries of sources and sinks: each writes a table to a folder and reads it again."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions.shared import shared_folder
from lexigrid.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def place(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def query(name: str, oracle: str):
    def keep(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name], ORACLE_SQL[name] = function, oracle
        return function

    return keep


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    """Parts with a nested column and with commas and quotes in a text."""
    part = spark.read.parquet(f"{d}/part.parquet")
    return part.select("p_partkey", F.concat_ws(', "', "p_name", "p_brand").alias("title"), F.array("p_brand", "p_type").alias("tags"))


@query("scan_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_csv(spark, d):
    path = place(spark, "scan_csv")
    tables.write_delimited(spark.read.parquet(f"{d}/nation.parquet"), path)
    return tables.read_delimited(spark, path)


@query("scan_csv_raw", "SELECT cast(n_nationkey AS varchar) AS n_nationkey, n_name, cast(n_regionkey AS varchar) AS n_regionkey FROM nation")
def scan_csv_raw(spark, d):
    path = place(spark, "scan_csv_raw")
    tables.write_delimited(spark.read.parquet(f"{d}/nation.parquet"), path)
    return tables.read_delimited(spark, path, infer=False)


@query("sink_csv", "SELECT cast(p_partkey AS varchar) AS p_partkey, p_name || ', \"' || p_brand AS title, '[\"' || p_brand || '\",\"' || p_type || '\"]' AS tags FROM part")
def sink_csv(spark, d):
    path = place(spark, "sink_csv")
    tables.write_delimited(_tagged(spark, d), path)
    return tables.read_delimited(spark, path, infer=False)


@query("sink_json", "SELECT cast(p_partkey AS bigint) AS p_partkey, p_name || ', \"' || p_brand AS title, [p_brand, p_type] AS tags FROM part")
def sink_json(spark, d):
    path = place(spark, "sink_json")
    tables.write_json(_tagged(spark, d), path)
    return spark.read.json(path)


@query("sink_parquet", "SELECT p_partkey, p_name || ', \"' || p_brand AS title, [p_brand, p_type] AS tags FROM part")
def sink_parquet(spark, d):
    path = place(spark, "sink_parquet")
    tables.write_parquet(_tagged(spark, d), path)
    return spark.read.parquet(path)


@query("scan_text_lines", "SELECT text FROM (SELECT unnest(string_split(replace(text, chr(13), ''), chr(10))) AS text FROM benchmark WHERE text <> '') WHERE text <> ''")
def scan_text_lines(spark, d):
    path = place(spark, "scan_text_lines")
    text = F.replace("text", F.lit("\r"), F.lit(""))
    spark.read.parquet(f"{d}/benchmark.parquet").where("text <> ''").select(text.alias("text")).write.text(path)
    return tables.read_lines(spark, path).where("text <> ''")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as JSON documents, one on a line, their turns two levels down."""
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    one = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", F.struct("role").alias("by")))).alias("turns"))
    return one.select(F.to_json(F.struct("conv_id", F.lit("chat").alias("kind"), F.struct("turns").alias("log"))).alias("value"))


@query("scan_documents", "SELECT 'nation ' || n_nationkey AS document, 'txt' AS extension FROM nation")
def scan_documents(spark, d):
    """A folder of text files, one for each row."""
    path = place(spark, "scan_documents")
    nation = spark.read.parquet(f"{d}/nation.parquet")
    nation.select("n_nationkey", F.concat(F.lit("nation "), "n_nationkey").alias("value")).write.partitionBy("n_nationkey").option("lineSep", " ").text(path)
    return tables.read_documents(spark, path).select(F.trim("document").alias("document"), "extension")


@query("scan_json", "SELECT conv_id, 'chat' AS kind, turn, text, '{\"role\": \"' || role || '\"}' AS \"by\" FROM conversations")
def scan_json(spark, d):
    path = place(spark, "scan_json")
    _turns(spark, d).write.text(path)
    found, _ = tables.read_json_records(spark, path)
    return found.select("conv_id", "kind", "turn", "text", "by")


@query("json_flatten_rules", "SELECT n_nationkey + 0.5 AS mixed, CASE WHEN n_nationkey % 2 = 0 THEN cast(n_nationkey AS varchar) ELSE n_name END AS either, '9223372036854775808' AS big, [n_name, 'x'] IS NOT NULL AS flag, '[\"' || n_name || '\", null]' AS list FROM nation")
def json_flatten_rules(spark, d):
    """Numbers with whole ones among them, numbers and text, too large numbers, flags and nested values."""
    path = place(spark, "json_flatten_rules")
    nation = spark.read.parquet(f"{d}/nation.parquet")
    line = """'{"mixed": ' || (n_nationkey + 0.5) || ', "either": ' || if(n_nationkey % 2 = 0, string(n_nationkey), '"' || n_name || '"') || ', "big": 9223372036854775808, "flag": true, "list": ["' || n_name || '", null]}'"""
    nation.select(F.expr(line).alias("value")).union(spark.createDataFrame([('{"mixed": 1}',)], "value string")).write.text(path)
    found, _ = tables.read_json_records(spark, path, "")
    return found.where("big is not null").select("mixed", "either", "big", "flag", "list")


@query("scan_json_batch", "SELECT conv_id, turn, text, '{\"role\": \"' || role || '\"}' AS \"by\", 1 AS skipped FROM conversations")
def scan_json_batch(spark, d):
    """Many files and one that is no JSON."""
    path = place(spark, "scan_json_batch")
    _turns(spark, d).repartition(6).write.text(path)
    spark.createDataFrame([("{not json",)], "value string").coalesce(1).write.mode("append").text(path)
    found, skipped = tables.read_json_records(spark, path)
    return found.select("conv_id", "turn", "text", "by").crossJoin(skipped.agg(F.count("*").cast("int").alias("skipped")))
