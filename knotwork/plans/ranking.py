"""Global positions without a single-task window.

A window without partition columns sends all rows to one task. Here rows are range-partitioned by the order,
numbered inside their range, and shifted by the number of rows in the ranges before: one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.plans.storage import cut


def positions(df: DataFrame, by: list[str | Column], name: str = "pos", first: int = 0) -> DataFrame:
    """``df`` with the position of each row in the total order ``by`` (which should leave no ties)."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *by).withColumn("_range", F.spark_partition_id()), "ranges")
    before = ranged.groupBy("_range").count()
    ahead = before.select("_range", (F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*by)) - 1
    return ranged.withColumn("_inside", inside).join(F.broadcast(ahead), "_range").withColumn(name, (F.col("_inside") + F.col("_ahead") + first).cast("long")).drop("_range", "_inside", "_ahead")
