"""Sparse matrices as (row, col, val): products over semirings, element-wise work, indexing, assignment.

An absent entry is the additive identity. Every function is one declarative plan; joins and partial aggregates
are left to Catalyst. Dimensions are arguments only where absent entries have to appear.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.semirings import OR_AND, PLUS_TIMES, Semiring

Unary, Binary = Callable[[Column], Column], Callable[[Column, Column], Column]


def sparse(rows: DataFrame, duplicates: Callable[[Column], Column] | None = F.sum, value=None) -> DataFrame:
    """A matrix from triples; ``duplicates`` adds entries of one place (None: they are known to be unique)."""
    m = rows.withColumn("val", F.lit(value)) if value is not None else rows
    m = m.select("row", "col", "val").where("row >= 0 AND col >= 0")
    return m if duplicates is None else m.groupBy("row", "col").agg(duplicates(F.col("val")).alias("val"))


def find(a: DataFrame, values: bool = True) -> DataFrame:
    return a.select("row", "col", "val") if values else a.select("row", "col")


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def multiply(a: DataFrame, b: DataFrame, semiring: Semiring = PLUS_TIMES) -> DataFrame:
    """A times B. Places to which nothing contributes are absent."""
    left = a.select("row", F.col("col").alias("k"), F.col("val").alias("x"))
    right = b.select(F.col("row").alias("k"), "col", F.col("val").alias("y"))
    terms = left.join(right, "k").select("row", "col", semiring.multiply(F.col("x"), F.col("y")).alias("val"))
    return terms.where("val IS NOT NULL").groupBy("row", "col").agg(semiring.add(F.col("val")).alias("val"))


def square(a: DataFrame, semiring: Semiring = PLUS_TIMES) -> DataFrame:
    return multiply(a, a, semiring)


def triple_product(r: DataFrame, a: DataFrame, p: DataFrame, r_transposed: bool = False) -> DataFrame:
    """R A P, with R given as its transpose if so said (the Galerkin product)."""
    return multiply(multiply(transpose(r) if r_transposed else r, a), p)


def accumulate(into: DataFrame, a: DataFrame, b: DataFrame, b_transposed: bool = False) -> DataFrame:
    """into + A B, or into + A B'."""
    return add(into, multiply(a, transpose(b) if b_transposed else b))


def powers(a: DataFrame, most: int, step=lambda df: df) -> list[DataFrame]:
    """Boolean A^2, A^4, ... up to the power ``most``; ``step`` may cut the lineage."""
    out, k, m = [], 1, a.select("row", "col", F.lit(True).alias("val")).distinct()
    while 2 * k <= most:
        k, m = 2 * k, step(multiply(m, m, OR_AND))
        out.append(m)
    return out


def times_vector(a: DataFrame, x: DataFrame, semiring: Semiring = PLUS_TIMES) -> DataFrame:
    """y_i = add over j of multiply(a_ij, x_j), over stored x only; y_i is absent if nothing contributes."""
    terms = a.join(x.select(F.col("idx").alias("col"), F.col("val").alias("x")), "col")
    terms = terms.select(F.col("row").alias("idx"), semiring.multiply(F.col("val"), F.col("x")).alias("val"))
    return terms.where("val IS NOT NULL").groupBy("idx").agg(semiring.add(F.col("val")).alias("val"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return merge([a, b])


def merge(parts: Sequence[DataFrame], adding: Callable[[Column], Column] = F.sum) -> DataFrame:
    """Several matrices in one, entries of one place added."""
    every = fold(lambda x, y: x.unionByName(y), [p.select("row", "col", "val") for p in parts])
    return every.groupBy("row", "col").agg(adding(F.col("val")).alias("val"))


def times_elements(a: DataFrame, b: DataFrame, exclude: bool = False) -> DataFrame:
    """A .* B where both are stored, or A where B is not."""
    if exclude:
        return a.join(b.select("row", "col"), ["row", "col"], "left_anti")
    both = a.join(b.withColumnRenamed("val", "other"), ["row", "col"])
    return both.select("row", "col", (F.col("val") * F.col("other")).alias("val"))


def combine(keys: list[str], v: DataFrame, w: DataFrame, op: Binary, do: Binary | None = None, allow_v_nulls: bool = False, allow_w_nulls: bool = False, allow_intersect: bool = True, v_null=0, w_null=0) -> DataFrame:
    """The element-wise operation with all its switches, for matrices and vectors.

    Emitted are places that both store (if allow_intersect), that only v stores (if allow_w_nulls, with w_null
    for w) and that only w stores (if allow_v_nulls), each if ``do`` accepts the two values.
    """
    how = {(False, False): "inner", (True, False): "right", (False, True): "left", (True, True): "outer"}[allow_v_nulls, allow_w_nulls]
    left = v.select(*keys, F.col("val").alias("_v"), F.lit(True).alias("_hv"))
    right = w.select(*keys, F.col("val").alias("_w"), F.lit(True).alias("_hw"))
    both = left.join(right, keys, how)
    hv, hw = F.col("_hv").isNotNull(), F.col("_hw").isNotNull()
    if not allow_intersect:
        both = both.where(~(hv & hw))
    x = F.when(hv, F.col("_v")).otherwise(F.lit(v_null))
    y = F.when(hw, F.col("_w")).otherwise(F.lit(w_null))
    if do is not None:
        both = both.where(F.coalesce(do(x, y), F.lit(False)))
    return both.select(*keys, op(x, y).alias("val"))


def apply_elements(a: DataFrame, b: DataFrame, op: Binary, **switches) -> DataFrame:
    return combine(["row", "col"], a, b, op, **switches)


def apply_where_absent(a: DataFrame, b: DataFrame, op: Binary, not_b: bool, default=0) -> DataFrame:
    """op over the common places, or over A with a default where B is absent."""
    if not not_b:
        return combine(["row", "col"], a, b, op)
    left = a.join(b.select("row", "col"), ["row", "col"], "left_anti")
    return left.select("row", "col", op(F.col("val"), F.lit(default)).alias("val"))


def apply(a: DataFrame, f: Unary) -> DataFrame:
    return a.select("row", "col", f(F.col("val")).alias("val"))


def prune(a: DataFrame, drop: Unary) -> DataFrame:
    """Without the entries that ``drop`` accepts."""
    return a.where(~F.coalesce(drop(F.col("val")), F.lit(False)))


def prune_places(a: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Without the entries whose row is in ``rows`` (idx) and whose column is in ``cols`` (idx)."""
    r = rows.select(F.col("idx").alias("row")).distinct().withColumn("_r", F.lit(True))
    c = cols.select(F.col("idx").alias("col")).distinct().withColumn("_c", F.lit(True))
    return a.join(r, "row", "left").join(c, "col", "left").where("_r IS NULL OR _c IS NULL").select("row", "col", "val")


def apply_along(a: DataFrame, x: DataFrame, op: Binary, by: str = "row") -> DataFrame:
    """a_ij = op(a_ij, x_i), or x_j with by="col"."""
    return a.join(x.select(F.col("idx").alias(by), F.col("val").alias("_x")), by).select("row", "col", op(F.col("val"), F.col("_x")).alias("val"))


def reduce(a: DataFrame, by: str = "row", adding: Callable[[Column], Column] = F.sum, f: Unary | None = None, size: int | None = None, identity=0) -> DataFrame:
    """Fold along rows or columns, of f of the entries; dense over ``size`` places with the identity, if given."""
    value = f(F.col("val")) if f else F.col("val")
    out = a.groupBy(F.col(by).alias("idx")).agg(adding(value).alias("val"))
    if size is None:
        return out
    space = a.sparkSession.range(size).withColumnRenamed("id", "idx")
    return space.join(out, "idx", "left").select("idx", F.coalesce("val", F.lit(identity)).alias("val"))


def index(a: DataFrame, ri: DataFrame | None = None, ci: DataFrame | None = None) -> DataFrame:
    """A(ri, ci): entry (p, q) is A(ri[p], ci[q]); ri and ci are (pos, idx) and may repeat; None is all."""
    if ri is not None:
        a = a.join(ri.select(F.col("idx").alias("row"), F.col("pos").alias("_p")), "row").select(F.col("_p").alias("row"), "col", "val")
    if ci is not None:
        a = a.join(ci.select(F.col("idx").alias("col"), F.col("pos").alias("_q")), "col").select("row", F.col("_q").alias("col"), "val")
    return a


def assign(a: DataFrame, ri: DataFrame, ci: DataFrame, b: DataFrame) -> DataFrame:
    """A with A(ri, ci) = B: what stood there goes, B's entries come in their places."""
    placed = b.join(ri.select(F.col("pos").alias("row"), F.col("idx").alias("_r")), "row").join(ci.select(F.col("pos").alias("col"), F.col("idx").alias("_c")), "col")
    return prune_places(a, ri, ci).unionByName(placed.select(F.col("_r").alias("row"), F.col("_c").alias("col"), "val"))


def equal(a: DataFrame, b: DataFrame, eps: float = 0.01) -> bool:
    """Same places, and values within eps."""
    apart = a.join(b.withColumnRenamed("val", "other"), ["row", "col"], "outer")
    return apart.where(F.col("val").isNull() | F.col("other").isNull() | (F.abs(F.col("val") - F.col("other")) > eps)).isEmpty()


def without_loops(a: DataFrame) -> DataFrame:
    return a.where("row <> col")


def load_imbalance(a: DataFrame, parts: int, by: Column | None = None) -> DataFrame:
    """parts * most entries of a part / entries; 1 for an empty matrix. The part is row mod parts unless said."""
    part = F.pmod(F.col("row"), F.lit(parts)) if by is None else by
    sizes = a.groupBy(part.alias("part")).count()
    return sizes.agg(F.coalesce(F.max("count") * parts / F.sum("count"), F.lit(1.0)).alias("imbalance"))


def nnz(a: DataFrame) -> DataFrame:
    return a.agg(F.count("*").alias("nnz"))


def cast(a: DataFrame, value: str, index_type: str = "long") -> DataFrame:
    return a.select(F.col("row").cast(index_type), F.col("col").cast(index_type), F.col("val").cast(value))


def owners(a: DataFrame, rows: int, cols: int, grid: int) -> DataFrame:
    """The block of a grid x grid division that owns each entry, and its place inside."""
    rb, cb = max(1, rows // grid), max(1, cols // grid)
    r, c = F.least(F.floor(F.col("row") / rb), F.lit(grid - 1)), F.least(F.floor(F.col("col") / cb), F.lit(grid - 1))
    return a.select("row", "col", "val", r.alias("owner_row"), c.alias("owner_col"), (F.col("row") - r * rb).alias("local_row"), (F.col("col") - c * cb).alias("local_col"))


def split_columns(a: DataFrame, cols: int) -> tuple[DataFrame, DataFrame]:
    """The left and the right half; the right one's columns start at 0."""
    half = cols // 2
    return a.where(F.col("col") < half), a.where(F.col("col") >= half).select("row", (F.col("col") - half).alias("col"), "val")


def merge_columns(left: DataFrame, right: DataFrame, left_cols: int) -> DataFrame:
    return left.unionByName(right.select("row", (F.col("col") + left_cols).alias("col"), "val"))


def densify(a: DataFrame, rows: int, cols: int, most: int = 10_000_000) -> DataFrame:
    """All places, zeros too; refused beyond ``most`` places."""
    if rows * cols > most:
        raise ValueError(f"a dense matrix of {rows} x {cols} is beyond {most} places")
    spark = a.sparkSession
    space = spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("row"), (F.col("id") % cols).alias("col"))
    return space.join(a, ["row", "col"], "left").select("row", "col", F.coalesce("val", F.lit(0)).alias("val"))


def sparsify(dense: DataFrame) -> DataFrame:
    """Stored entries of a dense matrix: all but zeros; NaN is stored."""
    return dense.where((F.col("val") != 0) | F.isnan(F.col("val").cast("double")))


def update_dense(dense: DataFrame, a: DataFrame, op: Binary) -> DataFrame:
    """d_ij = op(d_ij, a_ij) where a is stored."""
    both = dense.join(a.withColumnRenamed("val", "_a"), ["row", "col"], "left")
    return both.select("row", "col", F.when(F.col("_a").isNotNull(), op(F.col("val"), F.col("_a"))).otherwise(F.col("val")).alias("val"))


def scale(a: DataFrame, dense: DataFrame) -> DataFrame:
    """a_ij times d_ij."""
    return times_elements(a, dense)


def expand_symmetry(a: DataFrame, kind: str = "symmetric") -> DataFrame:
    """Mirrored entries of a file that stores one triangle: symmetric, or skew with changed sign."""
    sign = {"symmetric": 1, "skew-symmetric": -1}[kind]
    return a.unionByName(transpose(a.where("row <> col")).withColumn("val", F.col("val") * sign))


def rows_as_lists(a: DataFrame) -> DataFrame:
    """Compressed rows: (row, cols, vals) in order of column."""
    held = a.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "val"))).alias("e"))
    return held.select("row", F.col("e.col").alias("cols"), F.col("e.val").alias("vals"))


def lists_as_rows(compressed: DataFrame) -> DataFrame:
    return compressed.select("row", F.explode(F.arrays_zip("cols", "vals")).alias("e")).select("row", F.col("e.cols").alias("col"), F.col("e.vals").alias("val"))


def check_valid(a: DataFrame, rows: int, cols: int) -> DataFrame:
    """Counts of entries, of places out of range and of places stored more than once."""
    places = a.groupBy("row", "col").count()
    return places.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("entries"), F.count_if((F.col("row") < 0) | (F.col("row") >= rows) | (F.col("col") < 0) | (F.col("col") >= cols)).alias("out_of_range"), F.count_if(F.col("count") > 1).alias("repeated"))


def binned(a: DataFrame, size: int) -> DataFrame:
    """Entries by blocks of size x size: what a density plot shows."""
    return a.groupBy(F.floor(F.col("row") / size).alias("row_bin"), F.floor(F.col("col") / size).alias("col_bin")).agg(F.count("*").alias("n"))
