"""Order statistics and harmonic statistics of small samples, as search benchmarks report them.

The three definitions of quartiles differ from SQL's percentile; each is worked on the sorted array of one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sorted(x: DataFrame, col: str) -> DataFrame:
    return x.where(F.col(col).isNotNull()).agg(F.sort_array(F.collect_list(F.col(col).cast("double"))).alias("x")).select("x", F.size("x").alias("n"))


def _at(k: Column) -> Column:
    """The element of 0-based place k; NULL past the end."""
    return F.try_element_at("x", (k + 1).cast("int"))


def quartiles_pairs(x: DataFrame, col: str) -> DataFrame:
    """(q1, median, q3), each the mean of two order statistics."""
    n = F.col("n")
    a, b = F.floor((n - 1) / 4), F.floor(n / 4)
    return _sorted(x, col).select(((_at(a) + _at(b)) / 2).alias("q1"), ((_at(F.floor((n - 1) / 2)) + _at(F.floor(n / 2))) / 2).alias("median"), ((_at(n - 1 - a) + _at(n - 1 - b)) / 2).alias("q3"))


def quartiles_interpolated(x: DataFrame, col: str) -> DataFrame:
    """(q1, median, q3) at (n+1)/4, (n+1)/2 and 3(n+1)/4 as 0-based places, mixed with the next element."""
    n = F.col("n") + 1

    def mixed(t: Column, low: float, high: float) -> Column:
        k = F.floor(t)
        return F.when(t == k, _at(k)).otherwise(low * _at(k) + high * _at(k + 1))

    return _sorted(x, col).select(mixed(n / 4, 0.75, 0.25).alias("q1"), mixed(n / 2, 0.5, 0.5).alias("median"), mixed(3 * n / 4, 0.25, 0.75).alias("q3"))


def quartiles_means(x: DataFrame, col: str) -> DataFrame:
    """(q1, median, q3): (x[n/4 - 1] + x[n/4]) / 2 and so on."""
    n = F.col("n")

    def mean(k: Column) -> Column:
        return (_at(F.greatest(k - 1, F.lit(0))) + _at(k)) / 2

    return _sorted(x, col).select(mean(F.floor(n / 4)).alias("q1"), mean(F.floor(n / 2)).alias("median"), mean(F.floor(3 * n / 4)).alias("q3"))


def harmonic(x: DataFrame, col: str) -> DataFrame:
    """(hmean, hstd): n / sum(1/x), with 1/0 taken as 0, and its deviation."""
    inverse = F.when(F.col(col) != 0, F.lit(1.0) / F.col(col)).otherwise(0.0)
    s = x.where(F.col(col).isNotNull()).agg(F.count("*").alias("n"), F.sum(inverse).alias("s"), F.sum(inverse * inverse).alias("q"))
    hm = F.col("n") / F.when(F.col("s") != 0, F.col("s"))
    spread = F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0))
    return s.select(hm.alias("hmean"), F.when(F.col("n") > 1, F.sqrt(spread) / (F.col("n") - 1) * hm * hm).alias("hstd"))


def summary(x: DataFrame, col: str) -> DataFrame:
    return x.agg(F.min(col).alias("min"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("stddev"), F.max(col).alias("max"))


def stacked_layers(x: DataFrame, baseline: str = "wiggle") -> DataFrame:
    """(t, layer, low, high) of stacked areas (t, layer, value), layers in order of name.

    The baseline is zero, half the sum below it (symmetric), or the one that moves least (wiggle): minus the mean of
    the running sums, layer by layer.
    """
    layers = x.select("layer").distinct().withColumn("k", F.row_number().over(Window.orderBy("layer")))
    n = layers.agg(F.count("*").alias("n"))
    placed = x.join(F.broadcast(layers), "layer").crossJoin(F.broadcast(n))
    base = {"zero": F.lit(0.0), "symmetric": -F.sum("value") / 2, "wiggle": -F.sum((F.col("n") - F.col("k") + 1) * F.col("value")) / (F.max("n") + 1)}[baseline]
    start = placed.groupBy("t").agg(base.alias("base"))
    run = F.sum("value").over(Window.partitionBy("t").orderBy("layer"))
    both = placed.withColumn("run", run).join(start, "t")
    return both.select("t", "layer", (F.col("base") + F.col("run") - F.col("value")).alias("low"), (F.col("base") + F.col("run")).alias("high"))
