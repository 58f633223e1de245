"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it names none, a local session gets a temporary one; a cluster is
    refused, as its machines share no temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("name a folder that the cluster shares in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="lexigrid-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a table in the shared folder.

    For loops: a checkpoint keeps the estimated size of its plan, which every
    join multiplies, so after some rounds planning takes longer than the work;
    a table has the size of its files.
    """
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/table-{uuid4().hex}"
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)
