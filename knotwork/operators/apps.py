"""Applications of sparse algebra: ranking, independent sets, clustering, betweenness, similarity."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.random import uniform
from knotwork.operators.matrix import add, multiply, times_vector, transpose
from knotwork.operators.representation import reverse, vertices, weighted
from knotwork.plans.storage import cut


def column_stochastic(e: DataFrame) -> DataFrame:
    """(row, col, val): the share of src's weight that goes to dst, at (dst, src)."""
    total = weighted(e).groupBy("src").agg(F.sum("w").alias("t"))
    return weighted(e).join(total, "src").groupBy(F.col("dst").alias("row"), F.col("src").alias("col")).agg(F.sum(F.col("w") / F.col("t")).alias("val"))


def pagerank(e: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-10) -> DataFrame:
    """(v, rank): x = d W x + (1 - d) / n from 1/n on; what leaves a vertex without edges is lost."""
    every = cut(vertices(e), "vertices")
    n = every.count()
    w = cut(column_stochastic(e).withColumn("val", F.lit(damping) * F.col("val")), "weights")
    base = every.select(F.col("v").alias("idx"), F.lit((1 - damping) / max(1, n)).alias("val"))
    x = every.select(F.col("v").alias("idx"), F.lit(1.0 / max(1, n)).alias("val"))
    for k in range(rounds):
        new = times_vector(w, x).unionByName(base).groupBy("idx").agg(F.sum("val").alias("val"))
        if tolerance is None and k % 5 != 4:  # nothing to look at: several rounds are one job
            x = new
            continue
        new, old = cut(new, "ranks"), x.withColumnRenamed("val", "old")
        if tolerance is not None and (new.join(old, "idx").agg(F.max(F.abs(F.col("val") - F.col("old")))).first()[0] or 0) <= tolerance:
            x = new
            break
        x = new
    return x.select(F.col("idx").alias("v"), F.col("val").alias("rank"))


def affine_rounds(w: DataFrame, x: DataFrame, offset: DataFrame, rounds: int) -> DataFrame:
    """x = W x + E, a fixed number of times; x and E are (idx, val)."""
    for k in range(rounds):
        x = times_vector(w, x).unionByName(offset).groupBy("idx").agg(F.sum("val").alias("val"))
        if k % 5 == 4:
            x = cut(x, "affine")
    return x


def independent_set(e: DataFrame, seed: int = 1, v: DataFrame | None = None, keep: Column | None = None) -> DataFrame:
    """(v) of a maximal independent set by Luby's rounds: who draws less than all open neighbours joins."""
    steps = (e if keep is None else e.where(keep)).where("src <> dst").select("src", "dst")
    left_e = cut(steps.unionByName(reverse(steps)).distinct(), "edges")
    left = cut((vertices(e) if v is None else v.select("v").distinct()), "open")
    members, k = None, 0
    while not left.isEmpty():
        draw = left.select("v", uniform(seed, F.lit(k), "v").alias("r"))
        near = left_e.join(draw.select(F.col("v").alias("dst"), "r", F.col("v").alias("_id")), "dst").groupBy(F.col("src").alias("v")).agg(F.min(F.struct("r", "_id")).alias("m"))
        joined = cut(draw.join(near, "v", "left").where(F.col("m").isNull() | (F.struct(F.col("r"), F.col("v").alias("_id")) < F.col("m"))).select("v"), "joined")
        members = joined if members is None else members.unionByName(joined)
        gone = joined.unionByName(left_e.join(joined.withColumnRenamed("v", "src"), "src", "left_semi").select(F.col("dst").alias("v"))).distinct()
        left = cut(left.join(gone, "v", "left_anti"), "open")
        left_e = cut(left_e.join(left.withColumnRenamed("v", "src"), "src", "left_semi").join(left.withColumnRenamed("v", "dst"), "dst", "left_semi").select("src", "dst"), "edges")
        k += 1
    return members if members is not None else left


def inflate(a: DataFrame, power: float) -> DataFrame:
    """Entries to the power, columns made to sum to 1."""
    raised = a.select("row", "col", F.pow("val", F.lit(power)).alias("val"))
    total = raised.groupBy("col").agg(F.sum("val").alias("t"))
    return raised.join(total, "col").select("row", "col", (F.col("val") / F.col("t")).alias("val"))


def chaos(a: DataFrame) -> DataFrame:
    """The most that a column's largest entry exceeds its sum of squares."""
    per = a.groupBy("col").agg((F.max("val") - F.sum(F.col("val") * F.col("val"))).alias("c"))
    return per.agg(F.coalesce(F.max("c"), F.lit(0.0)).alias("chaos"))


def markov_clusters(a: DataFrame, power: float = 2.0, limit: float = 1e-4, eps: float = 1e-3, normalize: bool = False, most_rounds: int = 100) -> DataFrame:
    """The matrix at which squaring, inflating and pruning settle."""
    m = inflate(a, 1.0) if normalize else a
    for _ in range(most_rounds):
        m = cut(inflate(multiply(m, m), power), "mcl")
        done = chaos(m).first()[0] <= eps
        m = m.where(F.col("val") >= limit)
        if done:
            break
    return m


def clusters_of(m: DataFrame, v: DataFrame) -> DataFrame:
    """(v, component) of the clusters of a settled matrix."""
    from knotwork.operators.components import weak_components

    return weak_components(m.select(F.col("row").alias("src"), F.col("col").alias("dst")), v)


def _batches(sources: DataFrame, batch: int) -> Iterator[DataFrame]:
    """The vertices ``sources`` (v) in parts of about ``batch``, by a hash of the vertex, as (s)."""
    sources = cut(sources.select(F.col("v").cast("long").alias("s")).distinct(), "sources")
    parts = -(-sources.count() // batch)
    for k in range(parts):
        yield sources.where(F.pmod(F.xxhash64("s"), F.lit(parts)) == k)


def _path_counts(steps: DataFrame, own: DataFrame) -> list[DataFrame]:
    """Level by level (s, v, sigma): the numbers of shortest paths from each vertex ``own`` (s)."""
    levels = [cut(own.select("s", F.col("s").alias("v"), F.lit(1.0).alias("sigma")), "level")]
    seen = levels[0].select("s", "v")
    while True:
        front = levels[-1].join(steps.withColumnRenamed("src", "v"), "v").groupBy("s", F.col("dst").alias("v")).agg(F.sum("sigma").alias("sigma"))
        front = cut(front.join(seen, ["s", "v"], "left_anti"), "level")
        if front.isEmpty():
            return levels
        levels.append(front)
        seen = seen.unionByName(front.select("s", "v"))


def betweenness(e: DataFrame, sources: DataFrame | None = None, batch: int = 64) -> DataFrame:
    """(v, score): dependencies of all ``sources`` (v) on each vertex over shortest paths of steps.

    Forward, level by level, the numbers of paths from all sources of a batch; backward their dependencies. A
    batch holds a row for each source and vertex, so memory follows the batch and not the number of sources.
    """
    steps = cut(e.where("src <> dst").select("src", "dst").distinct(), "steps")
    every = vertices(e)
    total = None
    for own in _batches(every if sources is None else sources, batch):
        levels = _path_counts(steps, own)
        below, scores = None, None
        for level in range(len(levels) - 1, 0, -1):
            here = levels[level].withColumn("delta", F.lit(0.0)) if below is None else levels[level].join(below, ["s", "v"], "left").select("s", "v", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta"))
            here = cut(here, "delta")
            part = here.select("v", "delta")
            scores = part if scores is None else scores.unionByName(part)
            back = here.select("s", F.col("v").alias("dst"), ((1 + F.col("delta")) / F.col("sigma")).alias("share")).join(steps, "dst")
            up = back.groupBy("s", F.col("src").alias("v")).agg(F.sum("share").alias("share")).join(levels[level - 1], ["s", "v"])
            below = up.select("s", "v", (F.col("share") * F.col("sigma")).alias("delta"))
        if scores is not None:
            part = cut(scores.groupBy("v").agg(F.sum("delta").alias("score")), "scores")
            total = part if total is None else total.unionByName(part)
    if total is None:
        return every.select("v", F.lit(0.0).alias("score"))
    summed = total.groupBy("v").agg(F.sum("score").alias("score"))
    return every.join(summed, "v", "left").select("v", F.coalesce("score", F.lit(0.0)).alias("score"))


def node_betweenness(e: DataFrame) -> DataFrame:
    """(v, score): share of the ordered pairs of vertices whose shortest paths pass through each vertex."""
    n = vertices(e).count()
    return betweenness(e).select("v", (F.col("score") / max(1, n * (n - 1))).alias("score"))


def edge_betweenness(e: DataFrame, batch: int = 64) -> DataFrame:
    """(src, dst, score): share of the ordered pairs' shortest paths over each edge, split evenly among equal ones.

    Sources go in batches, as in ``betweenness``.
    """
    steps = cut(e.where("src <> dst").select("src", "dst").distinct(), "steps")
    every = cut(vertices(e), "vertices")
    n, total = every.count(), None
    for own in _batches(every, batch):
        levels = _path_counts(steps, own)
        below, flows = None, None
        for level in range(len(levels) - 1, 0, -1):
            here = levels[level].withColumn("delta", F.lit(0.0)) if below is None else levels[level].join(below, ["s", "v"], "left").select("s", "v", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta"))
            share = here.select("s", F.col("v").alias("dst"), ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
            over = cut(share.join(steps, "dst").join(levels[level - 1].withColumnRenamed("v", "src"), ["s", "src"]).select("s", "src", "dst", (F.col("share") * F.col("sigma")).alias("flow")), "flow")
            flows = over if flows is None else flows.unionByName(over)
            below = over.groupBy("s", F.col("src").alias("v")).agg(F.sum("flow").alias("delta"))
        if flows is not None:
            part = cut(flows.groupBy("src", "dst").agg(F.sum("flow").alias("flow")), "flows")
            total = part if total is None else total.unionByName(part)
    if total is None:
        return steps.withColumn("score", F.lit(0.0))
    summed = total.groupBy("src", "dst").agg((F.sum("flow") / (n * (n - 1))).alias("score"))
    return steps.join(summed, ["src", "dst"], "left").select("src", "dst", F.coalesce("score", F.lit(0.0)).alias("score"))


def eigenvector_centrality(e: DataFrame, rounds: int = 400, tolerance: float = 1e-9, steps: int = 8) -> DataFrame:
    """(v, x): the positive eigenvector of the largest eigenvalue, of length 1, by power iteration on A + I.

    ``steps`` multiplications are one job, between two looks at the change.
    """
    every = cut(vertices(e), "vertices")
    entries = weighted(e).select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("w").cast("double").alias("val"))
    diagonal = every.select(F.col("v").alias("row"), F.col("v").alias("col"), F.lit(1.0).alias("val"))
    a = cut(add(entries, diagonal), "shifted")
    x = every.select(F.col("v").alias("idx"), F.lit(1.0).alias("val"))
    for _ in range(0, rounds, steps):
        y = x
        for _ in range(steps):
            y = times_vector(a, y)
        y = cut(y, "power")
        size = y.agg(F.sqrt(F.sum(F.col("val") * F.col("val")))).first()[0] or 1.0
        new = y.select("idx", (F.col("val") / F.lit(size)).alias("val"))
        apart = new.join(x.withColumnRenamed("val", "old"), "idx").agg(F.max(F.abs(F.col("val") - F.col("old")))).first()[0]
        x = new
        if (apart or 0) <= tolerance:
            break
    return x.select(F.col("idx").alias("v"), F.col("val").alias("x"))


#: Pairs of vertices up to which two graphs' likeness is computed: it is a dense matrix.
MOST_PAIRS = 4_000_000


def vertex_similarity(a: DataFrame, b: DataFrame, tolerance: float = 1e-3, most_rounds: int = 100, most: int = MOST_PAIRS) -> DataFrame:
    """(row, col, val): likeness of the vertices of b (rows) and a (columns), S = B S A' + B' S A, two steps a round.

    Beyond ``most`` pairs of vertices it refuses.
    """
    a, b = cut(a, "matrix"), cut(b, "matrix")
    rows, cols = (m.select(F.explode(F.array("row", "col")).alias(c)).distinct() for m, c in ((b, "row"), (a, "col")))
    if (pairs := rows.count() * cols.count()) > most:
        raise ValueError(f"{pairs} pairs of vertices are beyond {most}")
    s = cut(rows.crossJoin(cols).withColumn("val", F.lit(1.0)), "similar")
    at, bt = transpose(a), transpose(b)
    for _ in range(most_rounds):
        new = s
        for _ in range(2):
            new = cut(multiply(multiply(b, new), at).unionByName(multiply(multiply(bt, new), a)).groupBy("row", "col").agg(F.sum("val").alias("val")), "similar")
        size = new.agg(F.sqrt(F.sum(F.col("val") * F.col("val")))).first()[0] or 1.0
        new = new.select("row", "col", (F.col("val") / F.lit(size)).alias("val"))
        apart = new.join(s.withColumnRenamed("val", "o"), ["row", "col"], "left").agg(F.sqrt(F.sum(F.pow(F.col("val") - F.coalesce("o", F.lit(0.0)), F.lit(2))))).first()[0]
        s = new
        if (apart or 0) < tolerance:
            break
    return s


def top_edges(e: DataFrame, k: int) -> DataFrame:
    """The k heaviest edges out of each vertex, ties to the lesser dst."""
    w = Window.partitionBy("src").orderBy(F.desc("w"), "dst")
    return e.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")
