"""Lines of files with their numbers, however Spark splits the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text), lines from 0.

    A split knows its file and where it starts in it; inside a split rows keep their order. Counting the splits'
    lines gives each split its first number: one row a split.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("text"), F.monotonically_increasing_id().alias("k"))
    own = Window.partitionBy("file", "start").orderBy("k")
    inside = raw.withColumn("inside", F.row_number().over(own) - 1)
    sizes = raw.groupBy("file", "start").agg(F.count("*").alias("n"))
    ahead = sizes.select("file", "start", (F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("ahead"))
    return inside.join(F.broadcast(ahead), ["file", "start"]).select("file", (F.col("inside") + F.col("ahead")).cast("long").alias("line"), "text")


def one_file(lines: DataFrame, by: list[str], path: str) -> None:
    """Write the column ``text`` in the order ``by`` as one text file in the folder ``path``."""
    lines.orderBy(*by).select("text").coalesce(1).write.mode("overwrite").text(path)
