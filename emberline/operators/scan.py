"""Distributed running totals over a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.session import cut


def running_total(df: DataFrame, order: list[str], value: str, into: str = "before", parts: int | None = None) -> DataFrame:
    """df with the sum of `value` over all rows that come before, in the order of the columns `order`.

    Rows are range-partitioned by that order (written once, as the sampled boundaries must not change between passes);
    the totals of the partitions, one row each, are summed up among themselves and added to the running sum inside
    each partition. No task sees more than one partition. `order` must identify rows for the result to be defined;
    NULL values count 0.
    """
    spark = df.sparkSession
    parts = parts or max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    amount: Column = F.coalesce(F.col(value).cast("long"), F.lit(0))
    totals = placed.groupBy("__part").agg(F.sum(amount).alias("__sum"))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # at most `parts` rows
    offsets = totals.select("__part", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn(into, F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return out.join(F.broadcast(offsets), "__part").withColumn(into, F.col(into) + F.col("__offset")).drop("__part", "__offset")
