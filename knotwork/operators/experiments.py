"""Sweeps of partitioners over parameters and graphs: one row a setting."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import generators, partition
from knotwork.plans.storage import cut


def _measured(e: DataFrame, parts: DataFrame, k: int, **setting) -> DataFrame:
    parts = cut(parts, "parts")
    row = partition.edge_cut(e, parts, k).crossJoin(partition.balance(parts))
    return row.select(*[F.lit(v).alias(n) for n, v in setting.items()], F.lit(k).alias("k"), "lambda", F.col("n_balance").alias("balance"))


def testbed(e: DataFrame, ks: Sequence[int], gammas: Sequence[float], trials: int = 3, **options) -> DataFrame:
    """(gamma, k, lambda, balance): means over seeded orders of the exact stream."""
    e = cut(e.select("src", "dst"), "edges")
    rows = [_measured(e, partition.stream_partition(e, k, gamma=g, seed=t + 1, **options), k, gamma=g, trial=t) for g in gammas for k in ks for t in range(trials)]
    return fold(DataFrame.unionByName, rows).groupBy("gamma", "k").agg(F.avg("lambda").alias("lambda"), F.avg("balance").alias("balance"))


def lambda_over_densities(spark: SparkSession, n: int, densities: Sequence[float], k: int, seed: int = 1) -> DataFrame:
    """(density, k, lambda) of the stream on random graphs that grow denser, those of ``generators.erdos_renyi``. An
    edge is a function of its pair, so the graphs are not stored but drawn where their edges are counted."""

    def draw(a: Column, b: Column) -> Column:
        return generators.pair_draw(seed, a, b)

    degrees, rows = partition.pair_degrees(spark, n, draw, densities), []
    for p, own in zip(densities, degrees.T, strict=True):
        nnz, kept = int(own.sum()), partition.stream_over_pairs(spark, n, draw, p, own, k, seed=seed)[1]
        rows.append((float(p), k, (nnz - 2 * kept) / nnz if nnz else None))
    return spark.createDataFrame(rows, "density double, k int, lambda double")


def lambda_over_factors(spark: SparkSession, scale: int, factors: Sequence[int], k: int, seed: int = 1) -> DataFrame:
    """(factor, k, lambda) of the stream on Kronecker graphs of more and more edges."""
    rows = []
    for f in factors:
        made = generators.kronecker(spark, scale, f, seed=seed).where("src <> dst")
        e = cut(made.unionByName(made.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
        rows.append(_measured(e, partition.stream_partition(e, k, seed=seed), k, factor=f).select("factor", "k", "lambda"))
    return fold(DataFrame.unionByName, rows)
