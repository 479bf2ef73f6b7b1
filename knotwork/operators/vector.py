"""Vectors as (idx, val): dense ones store every index, sparse ones some."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.functions.random import integer, order
from knotwork.operators.matrix import Binary, Unary, combine
from knotwork.plans.ranking import positions


def iota(spark: SparkSession, size: int, first: int = 0) -> DataFrame:
    return spark.range(size).select(F.col("id").alias("idx"), (F.col("id") + first).alias("val"))


def concatenate(parts: Sequence[DataFrame], sizes: Sequence[int]) -> DataFrame:
    """Vectors one after the other; sizes are their lengths."""
    out, at = None, 0
    for p, n in zip(parts, sizes, strict=True):
        moved = p.select((F.col("idx") + at).alias("idx"), "val")
        out, at = moved if out is None else out.unionByName(moved), at + n
    return out


def reduce(v: DataFrame, adding: Callable[[Column], Column] = F.sum, f: Unary | None = None, identity=0) -> DataFrame:
    return v.agg(F.coalesce(adding(f(F.col("val")) if f else F.col("val")), F.lit(identity)).alias("val"))


def count(v: DataFrame, predicate: Unary) -> DataFrame:
    return v.agg(F.count_if(predicate(F.col("val"))).alias("n"))


def find(v: DataFrame, predicate: Unary) -> DataFrame:
    return v.where(predicate(F.col("val")))


def find_indices(v: DataFrame, predicate: Unary) -> DataFrame:
    """Indices where the predicate holds, as a dense vector in order."""
    return positions(find(v, predicate).select(F.col("idx").alias("val")), ["val"]).select(F.col("pos").alias("idx"), "val")


def set_element(v: DataFrame, idx: int, value) -> DataFrame:
    """An upsert of one place."""
    one = v.sparkSession.range(1).select(F.lit(idx).cast("long").alias("idx"), F.lit(value).alias("val"))
    return v.where(F.col("idx") != idx).unionByName(one)


def delete_element(v: DataFrame, idx: int) -> DataFrame:
    return v.where(F.col("idx") != idx)


def get_element(v: DataFrame, idx: int) -> DataFrame:
    """(val, found) of one place."""
    return v.where(F.col("idx") == idx).agg(F.max("val").alias("val"), (F.count("*") > 0).alias("found"))


def set_from(v: DataFrame, other: DataFrame) -> DataFrame:
    """v with the stored places of the other put over it."""
    both = v.join(other.select("idx", F.col("val").alias("_w"), F.lit(True).alias("_h")), "idx", "left")
    return both.select("idx", F.when(F.col("_h"), F.col("_w")).otherwise(F.col("val")).alias("val"))


def apply(v: DataFrame, f: Unary) -> DataFrame:
    return v.select("idx", f(F.col("val")).alias("val"))


def apply_index(v: DataFrame, f: Binary) -> DataFrame:
    """f of the value and its index."""
    return v.select("idx", f(F.col("val"), F.col("idx")).alias("val"))


def apply_masked(v: DataFrame, f: Unary, mask: DataFrame) -> DataFrame:
    both = v.join(mask.select("idx", F.lit(True).alias("_h")).distinct(), "idx", "left")
    return both.select("idx", F.when(F.col("_h"), f(F.col("val"))).otherwise(F.col("val")).alias("val"))


def apply_elements(v: DataFrame, w: DataFrame, op: Binary, **switches) -> DataFrame:
    """Element-wise with the switches of ``matrix.combine``."""
    return combine(["idx"], v, w, op, **switches)


def update(v: DataFrame, w: DataFrame, op: Binary, do: Binary | None = None, apply_nulls: bool = False, null=0) -> DataFrame:
    """v op w in place: places that w lacks are left, or worked with ``null``; ``do`` chooses where to act."""
    both = v.join(w.select("idx", F.col("val").alias("_w"), F.lit(True).alias("_h")), "idx", "left")
    y = F.when(F.col("_h"), F.col("_w")).otherwise(F.lit(null))
    act = (F.col("_h").isNotNull() if not apply_nulls else F.lit(True)) & (F.coalesce(do(F.col("val"), y), F.lit(False)) if do else F.lit(True))
    return both.select("idx", F.when(act, op(F.col("val"), y)).otherwise(F.col("val")).alias("val"))


def add(v: DataFrame, w: DataFrame) -> DataFrame:
    return v.unionByName(w).groupBy("idx").agg(F.sum("val").alias("val"))


def subtract(v: DataFrame, w: DataFrame) -> DataFrame:
    return add(v, apply(w, lambda c: -c))


def equal(v: DataFrame, w: DataFrame, eps: float = 0.01) -> bool:
    apart = v.join(w.withColumnRenamed("val", "_w"), "idx", "outer")
    return apart.where(F.col("val").isNull() | F.col("_w").isNull() | (F.abs(F.col("val") - F.col("_w")) > eps)).isEmpty()


def sort(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The values in order, and the permutation that brings them there."""
    placed = positions(v, ["val", "idx"])
    return placed.select(F.col("pos").alias("idx"), "val"), placed.select(F.col("pos").alias("idx"), F.col("idx").alias("val"))


def random_permutation(spark: SparkSession, size: int, seed: int) -> DataFrame:
    ids = spark.range(size).select(F.col("id").alias("val"))
    return positions(ids.select("val", order(seed, "val")[0].alias("_o")), ["_o", "val"]).select(F.col("pos").alias("idx"), "val")


def gather(v: DataFrame, ri: DataFrame) -> DataFrame:
    """v(ri): ri is (pos, idx); absent places stay absent."""
    return v.join(ri, "idx").select(F.col("pos").alias("idx"), "val")


def select_candidates(spark: SparkSession, n: int, size: int, seed: int) -> DataFrame:
    """n random vertex ids below size."""
    return spark.range(n).select(F.col("id").alias("idx"), integer(size, seed, "id").alias("val"))


def value_is_index(v: DataFrame) -> DataFrame:
    return v.select("idx", F.col("idx").alias("val"))


def nnz(v: DataFrame) -> DataFrame:
    return v.agg(F.count("*").alias("nnz"))


def empty(v: DataFrame) -> DataFrame:
    return v.where(F.lit(False))


def bulk_set(indices: DataFrame) -> DataFrame:
    """A sparse vector of the given indices (idx), each its own value."""
    return indices.select("idx").distinct().select("idx", F.col("idx").alias("val"))


def times_dense(v: DataFrame, w: DataFrame, exclude: bool = False, zero=0) -> DataFrame:
    """Sparse v .* dense w: where w is not zero the product, or with exclude v where w is zero (or absent)."""
    both = v.join(w.select("idx", F.col("val").alias("_w")), "idx", "left")
    at_zero = F.coalesce(F.col("_w") == F.lit(zero), F.lit(True))
    if exclude:
        return both.where(at_zero).select("idx", "val")
    return both.where(~at_zero).select("idx", (F.col("val") * F.col("_w")).alias("val"))


def running(v: DataFrame, by: str | None = None) -> DataFrame:
    """Cumulative sums by index, within a group column if given."""
    w = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return v.withColumn("total", F.sum("val").over(w))
