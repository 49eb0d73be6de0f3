"""Ranks within keys whose rows no single task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.sources.scratch import written


def ranked_all(rows: DataFrame, keys: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """Add the rank from 1 of every row among those of its keys.

    Rows are range-partitioned by keys and order, so that a key with very many rows spreads over many tasks. A row's
    rank is its place in its partition and the number of its key's rows in the partitions before; of each key and
    partition one row is gathered for that.
    """
    sort = [*[F.col(k) for k in keys], *order]
    placed = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id())
    placed = written(placed, "placed")
    parts = placed.groupBy(*keys, "__part").agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(*keys, "__part", (before - F.col("__first") + 1).alias("__start"))
    return placed.join(starts, [*keys, "__part"]).withColumn(out, F.col("__row") + F.col("__start")).drop("__part", "__row", "__start")
