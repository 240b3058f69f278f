"""Gapless numbers over a total order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyad.sources.scratch import materialize


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Adds gapless ids from 0 in this order: numbers in range partitions, after a count of each, so that no task sees all rows."""
    spark = df.sparkSession
    sorted_ = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()), "numbered")
    counts = sorted_.groupBy("__p").count().collect()
    start, total = {}, 0
    for p, n in sorted(map(tuple, counts)):
        start[p], total = total, total + n
    offsets = spark.createDataFrame(list(start.items()), "__p int, __start bigint")
    within = Window.partitionBy("__p").orderBy(*order)
    return sorted_.join(F.broadcast(offsets), "__p").withColumn(name, F.col("__start") + F.row_number().over(within) - 1).drop("__p", "__start")
