"""All registered queries outside the corpus-preparation subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexigrid.plans import analyses, files, tables

QUERIES = tables.QUERIES | files.QUERIES | analyses.QUERIES
ORACLE_SQL = tables.ORACLE_SQL | files.ORACLE_SQL | analyses.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword in context with its density: scan, search, arrays and aggregation at once."""
    return QUERIES["kwic_density"](spark, sf_dir)
