"""Places of rows in an order, without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.functions.shared import durable


def numbered(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """df with the place of each row, from 0, in the order of the keys.

    Rows are dealt to ranges of keys, which are cut once; a range's rows are
    numbered in a task of its own, from the sum of the sizes of those before it.
    Keys that are alike stand in any order. df is written once, so give it no
    more columns than the numbers are joined back by.
    """
    ranges = durable(df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()))
    sizes = ranges.groupBy("__range").agg(F.count("*").alias("n"))  # as many rows as ranges
    before = sizes.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*keys))
    return ranges.join(F.broadcast(before), "__range").withColumn(name, (F.col("__before") + place - 1).cast("bigint")).drop("__range", "__before")
