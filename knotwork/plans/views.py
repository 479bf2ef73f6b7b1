"""Graphs that the test tables hold, as edge tables (src, dst, w)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART_BASE = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers to parts by number of lines."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + PART_BASE).alias("dst"))
    return lines.groupBy("src", "dst").agg(F.count("*").alias("w"))


def _together(spark: SparkSession, sf_dir: str, col: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col(col).alias("src"))
    return lines.join(lines.withColumnRenamed("src", "dst"), "l_orderkey").where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))


def co_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share an order."""
    return _together(spark, sf_dir, "l_suppkey")


def co_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that share an order."""
    return _together(spark, sf_dir, "l_partkey")


def nation_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of customers to nations of suppliers by lines, no loops."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("k"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    both = lines.join(orders, "l_orderkey").join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("src")), "c_custkey")
    both = both.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("dst")), "l_suppkey")
    return both.where("src <> dst").groupBy("src", "dst").agg(F.sum("k").alias("w"))


def foremost_trade(spark: SparkSession, sf_dir: str, most: int = 3) -> DataFrame:
    """A report on the nations' trade: the ``most`` heaviest arcs of each source."""
    e = nation_trade(spark, sf_dir)
    own = Window.partitionBy("src").orderBy(F.desc("w"), "dst")
    return e.withColumn("_k", F.row_number().over(own)).where(F.col("_k") <= most).drop("_k")


def user_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges (src, event_type, n, follower, count, latest): count is purchases, follower any signup."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("src"), "event_type").agg(F.count("*").alias("n"), F.bool_or(F.col("event_type") == "signup").alias("follower"), F.count_if(F.col("event_type") == "purchase").alias("count"), F.max("ts").alias("latest"))


def user_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From one event's user to the next's, over all events in order; loops dropped.

    The order is cut by day: inside a day a window finds the event before, and the first event of a day follows
    the last one of the day before it that has events, which is one row a day.
    """
    e = table(spark, sf_dir, "events").select("ts", "event_id", F.col("user_id").alias("dst"), F.to_date("ts").alias("day"))
    own = Window.partitionBy("day").orderBy("ts", "event_id")
    inside = e.withColumn("src", F.lag("dst").over(own)).withColumn("k", F.row_number().over(own))
    last = e.groupBy("day").agg(F.max_by("dst", F.struct("ts", "event_id")).alias("last"))
    before = last.select("day", F.lag("last").over(Window.orderBy("day")).alias("before"))
    joined = inside.join(F.broadcast(before), "day").select(F.when(F.col("k") == 1, F.col("before")).otherwise(F.col("src")).alias("src"), "dst")
    return joined.where("src IS NOT NULL AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))


def customer_supplier_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to suppliers, a row for each line."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("dst"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("src"))
    return lines.join(orders, "l_orderkey").select("src", "dst")


SQL = {
    "g1": f"SELECT l_suppkey AS src, l_partkey + {PART_BASE} AS dst, count(*) AS w FROM lineitem GROUP BY 1, 2",
    "g2": "SELECT a.l_suppkey AS src, b.l_suppkey AS dst, count(*) AS w FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey GROUP BY 1, 2",
    "g7": "SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*) AS w FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY 1, 2",
    "g0": """SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2""",
    "g4": """SELECT user_id AS src, event_type, count(*) AS n, bool_or(event_type = 'signup') AS follower,
        count(*) FILTER (WHERE event_type = 'purchase') AS count, max(ts) AS latest FROM events GROUP BY 1, 2""",
    "g5": "SELECT src, dst, count(*) AS w FROM (SELECT lag(user_id) OVER (ORDER BY ts, event_id) AS src, user_id AS dst FROM events) WHERE src <> dst GROUP BY 1, 2",
    "g6": "SELECT o_custkey AS src, l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
}
SQL["g3"] = f"SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS k FROM ({SQL['g0']})) WHERE k <= 3"
