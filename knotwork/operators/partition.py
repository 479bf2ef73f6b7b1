"""Graph partitioning: simple rules, one-pass and restreamed greedy partitioners, and their reports.

Parts are (v, part), numbered from 0. The greedy rule gives a vertex the part of greatest score: its neighbours
there less a cost of the part's size. Two ways to run it: ``stream_partition`` folds over the vertices in order,
exactly, in one task and so only up to a stated number of vertices; ``restream`` works on the whole cluster in
rounds, in which a share of the vertices move at once and see the sizes of the round before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions.random import integer, order
from knotwork.operators.representation import vertices
from knotwork.plans.ranking import positions
from knotwork.plans.storage import cut, cut_by
from knotwork.shipping import ship

MOST_STREAMED = 2_000_000


def fennel_alpha(nnz: int, n: int, gamma: float) -> float:
    return math.sqrt(2) * nnz / max(1, n) ** gamma


def bisection_alpha(edges: int, n: int, gamma: float) -> float:
    return edges * 2 ** (gamma - 1) / max(1, n) ** gamma


# Simple rules.


def by_modulus(v: DataFrame, k: int) -> DataFrame:
    return v.select("v", F.pmod("v", F.lit(k)).cast("int").alias("part"))


def by_hash(v: DataFrame, k: int, seed: int = 1) -> DataFrame:
    return v.select("v", integer(k, seed, "v").cast("int").alias("part"))


def by_chunks(v: DataFrame, k: int) -> DataFrame:
    """k runs of the vertices in order, as even as can be."""
    n = v.count()
    return positions(v.select("v"), ["v"]).select("v", F.floor(F.col("pos") * k / max(1, n)).cast("int").alias("part"))


def balanced(v: DataFrame, k: int, seed: int | None = None) -> DataFrame:
    """Round robin over the vertices in order, or in a seeded random order."""
    if seed is None:
        return positions(v.select("v"), ["v"]).select("v", (F.col("pos") % k).cast("int").alias("part"))
    named = v.select("v", order(seed, "v")[0].alias("_o"))
    return positions(named, ["_o", "v"]).select("v", (F.col("pos") % k).cast("int").alias("part"))


def by_range(v: DataFrame, n: int, k: int, first: int = 0) -> DataFrame:
    """Equal chunks of floor(n / k) ids; the rest has a part of its own (-1)."""
    size = max(1, n // k)
    p = F.floor((F.col("v") - first) / size)
    return v.select("v", F.when(p < k, p).otherwise(-1).cast("int").alias("part"))


# The exact fold.


def _adjacency(e: DataFrame, v: DataFrame | None) -> DataFrame:
    lists = e.groupBy(F.col("src").alias("v")).agg(F.collect_list("dst").alias("nbrs"))
    every = vertices(e) if v is None else v
    return every.join(lists, "v", "left").select("v", F.coalesce("nbrs", F.array().cast("array<long>")).alias("nbrs"))


def greedy_fold(ids: np.ndarray, nbrs: list[np.ndarray], k: int, alpha: float, gamma: float, *, passes: int = 1, rate: float = 1.0, cost: str = "delta", delta: float = 10.0, ties: str = "low", truncate: bool = False, cutoff: int | None = None, start: np.ndarray | None = None, seed: int = 1, isolated: str = "random", rule: str = "fennel") -> np.ndarray:
    """The parts of the vertices ``ids`` (in stream order) with neighbour lists ``nbrs``.

    rule fennel: count - degree - alpha * ((s + delta)^gamma - s^gamma), or with cost derivative count - alpha *
    gamma / 2 * s^(gamma - 1); ldg: (1 - s / C) * (count + 1), C a tenth over an even share. A vertex still counts
    in its old part while it chooses. Vertices of ``cutoff`` neighbours or more wait and are dealt at the end.
    """
    place = {int(x): i for i, x in enumerate(ids)}
    near = [np.array([place[int(x)] for x in own if int(x) in place], np.int64) for own in nbrs]
    return _fold_near(near, k, alpha, gamma, passes=passes, rate=rate, cost=cost, delta=delta, ties=ties, truncate=truncate, cutoff=cutoff, start=start, draw=np.random.default_rng(seed), isolated=isolated, rule=rule)


def _fold_near(near: list[np.ndarray], k: int, alpha: float, gamma: float, *, draw: np.random.Generator, passes: int = 1, rate: float = 1.0, cost: str = "delta", delta: float = 10.0, ties: str = "low", truncate: bool = False, cutoff: int | None = None, start: np.ndarray | None = None, isolated: str = "random", rule: str = "fennel", ahead: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """``greedy_fold`` over neighbours by place. ``ahead``: a stream goes on, and these are the sizes so far, the
    neighbours of each vertex in the parts so far, and the numbers of all its neighbours."""
    part = np.full(len(near), -1) if start is None else start.copy()
    sizes = np.bincount(part[part >= 0], minlength=k).astype(float)
    sizes, before, every = (sizes, None, [len(own) for own in near]) if ahead is None else (ahead[0].astype(float), *ahead[1:])
    room = 1.1 * len(near) / k
    parked = [cutoff is not None and len(own) >= cutoff for own in near]
    for _ in range(passes):
        for i, own in enumerate(near):
            if parked[i]:
                continue
            if not every[i]:
                if part[i] < 0 or isolated == "random":
                    to = int(draw.integers(k))
                else:
                    continue
            else:
                of = part[own]
                count = np.bincount(of[of >= 0], minlength=k)[:k]
                if before is not None:
                    count = count + before[i]
                if rule == "ldg":
                    score = (1 - sizes / room) * (count + 1)
                elif cost == "delta":
                    score = count - every[i] - alpha * ((sizes + delta) ** gamma - sizes**gamma)
                else:
                    score = count - alpha * (gamma / 2) * sizes ** (gamma - 1)
                if truncate:
                    score = np.trunc(score)
                to = int(np.argmax(score)) if ties == "low" else k - 1 - int(np.argmax(score[::-1]))
            sizes[to] += 1
            if part[i] >= 0:
                sizes[part[i]] -= 1
            part[i] = to
        alpha *= rate
    for i in np.flatnonzero(parked):
        part[i] = int(draw.integers(k))
    return part


def stream_partition(e: DataFrame, k: int, *, v: DataFrame | None = None, alpha: float | None = None, gamma: float = 1.5, seed: int = 1, shuffled: bool = True, most: int = MOST_STREAMED, **options) -> DataFrame:
    """(v, part) of the exact fold over the vertices in seeded random order, or in order of id."""
    adj = _adjacency(e, v)
    n, nnz = adj.agg(F.count("*"), F.coalesce(F.sum(F.size("nbrs")), F.lit(0))).first()
    if n > most:
        raise ValueError(f"{n} vertices are beyond {most} for an exact stream; use restream")
    a = fennel_alpha(nnz, n, gamma) if alpha is None else alpha
    keyed = adj.select("v", "nbrs", (order(seed, "v")[0] if shuffled else F.col("v")).alias("o"))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["o", "v"])
        part = greedy_fold(rows["v"].to_numpy(), rows["nbrs"].tolist(), k, a, gamma, seed=seed, **options)
        return pd.DataFrame({"v": rows["v"].to_numpy(), "part": part.astype("int32")})

    ship(e.sparkSession)
    return keyed.groupBy(F.lit(0).alias("g")).applyInPandas(lambda rows: fold(rows), "v long, part int")


def pair_degrees(spark: SparkSession, n: int, draw: Callable[[Column, Column], Column], densities: Sequence[float]) -> np.ndarray:
    """For each vertex below n and each density the number of its neighbours: those u with draw(v, u) below it."""
    v, u = _dealt(spark, spark.range(n).select(F.col("id").alias("v"))), spark.range(n).select(F.col("id").alias("u"))
    drawn = v.crossJoin(F.broadcast(u)).where("v <> u").select("v", draw(F.col("v"), F.col("u")).alias("x"))
    counted = drawn.groupBy("v").agg(*[F.count_if(F.col("x") < p).alias(f"d{i}") for i, p in enumerate(densities)]).collect()
    out = np.zeros((n, len(densities)), np.int64)
    for row in counted:
        out[row[0]] = row[1:]
    return out


def _dealt(spark: SparkSession, df: DataFrame) -> DataFrame:
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))


def stream_over_pairs(spark: SparkSession, n: int, draw: Callable[[Column, Column], Column], p: float, degrees: np.ndarray, k: int, *, gamma: float = 1.5, seed: int = 1, held: int = 1_000_000) -> tuple[np.ndarray, int]:
    """The exact fold of ``stream_partition`` over a graph whose edges are the pairs with draw(v, u) < p: the parts by
    id, and the number of pairs inside a part. No edge is stored. The stream is cut into runs that hold about ``held``
    edges: the cluster counts a run's neighbours in the parts so far, one task folds over the run."""
    if n > MOST_STREAMED:
        raise ValueError(f"{n} vertices are beyond {MOST_STREAMED} for an exact stream")
    ship(spark)
    keys = spark.range(n).select(F.col("id").alias("v")).select("v", order(seed, "v")[0].alias("o")).collect()
    ids = np.array([v for v, _ in sorted(keys, key=lambda x: (x["o"], x["v"]))], np.int64)
    alpha, part, sizes, kept = fennel_alpha(int(degrees.sum()), n, gamma), np.full(n, -1, np.int32), np.zeros(k, np.int64), 0
    joined = draw(F.col("v"), F.col("u")) < p
    size = max(1, math.isqrt(int(2 * held / max(p, 1e-9))))
    for lo in range(0, n, size):
        own = ids[lo : lo + size]
        run = _dealt(spark, spark.createDataFrame(pa.table({"v": own, "i": np.arange(len(own), dtype=np.int32)})))
        before = np.zeros((len(own), k), np.int64)
        if lo:
            ahead = spark.createDataFrame(pa.table({"u": ids[:lo], "part": part[ids[:lo]]}))
            counted = run.crossJoin(F.broadcast(ahead)).where(joined).groupBy("i").agg(*[F.count_if(F.col("part") == q).alias(f"n{q}") for q in range(k)])
            for row in counted.collect():
                before[row[0]] = row[1:]
        other = spark.createDataFrame(pa.table({"u": own, "j": np.arange(len(own), dtype=np.int32)}))
        inside = run.crossJoin(F.broadcast(other)).where((F.col("j") < F.col("i")) & joined).select("i", "j")
        some = inside.unionByName(spark.range(1).select(F.lit(-1).alias("i"), F.lit(-1).alias("j")))  # a run without edges too is folded
        fold = _run_fold(len(own), k, alpha, gamma, (sizes, before, degrees[own]), seed, int((degrees[ids[:lo]] == 0).sum()))
        for row in some.groupBy(F.lit(0).alias("g")).applyInPandas(fold, "i int, part int, kept long").collect():
            part[own[row["i"]]] = row["part"]
            kept += row["kept"]
        sizes = np.bincount(part[part >= 0], minlength=k)
    return part, kept


def _run_fold(n: int, k: int, alpha: float, gamma: float, ahead: tuple[np.ndarray, np.ndarray, np.ndarray], seed: int, drawn: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
        by = np.argsort(i, kind="stable")
        near = np.split(j[by], np.searchsorted(i[by], np.arange(n + 1)))[1:-1]
        r = np.random.default_rng(seed)
        for _ in range(drawn):  # vertices without neighbours in the runs before
            r.integers(k)
        part = _fold_near(near, k, alpha, gamma, draw=r, ahead=ahead)
        kept = [int((part[own] == part[v]).sum() + ahead[1][v, part[v]]) for v, own in enumerate(near)]
        return pd.DataFrame({"i": np.arange(n, dtype="int32"), "part": part.astype("int32"), "kept": kept})

    return fold


def ldg_bisection(e: DataFrame, **options) -> DataFrame:
    """Linear deterministic greedy into two parts; ties go to the second."""
    return stream_partition(e, 2, alpha=0.0, rule="ldg", ties="high", **options)


# Rounds on the cluster.


def restream(e: DataFrame, k: int, *, v: DataFrame | None = None, alpha: float | None = None, gamma: float = 1.5, passes: int = 10, rate: float = 1.7, batches: int = 4, cutoff: int | None = None, seed: int = 1, start: DataFrame | None = None, stop_balance: float | None = None) -> Iterator[tuple[int, DataFrame]]:
    """Pass 0 is random (or ``start``); each later pass tempers alpha by ``rate``. Yields (pass, parts).

    In each of ``batches`` rounds of a pass the vertices of one hash class move together: score = count -
    alpha * gamma / 2 * size^(gamma - 1), with the sizes after the round before; ties go to the lowest part.
    Counts come from one join with the current parts; the k costs are a literal of the plan.
    """
    e = cut(e.select("src", "dst"), "edges")
    moving = F.pmod(F.xxhash64(F.lit(seed), "src"), F.lit(batches))
    # A round reads the edges of its own class only, which lie by the vertex whose neighbours are counted.
    classes = [cut_by(e.where(moving == b).repartition("src"), "class", "src") for b in range(batches)]
    every = cut(vertices(e) if v is None else v.select("v").distinct(), "vertices")
    n, nnz = every.count(), e.count()
    a = fennel_alpha(nnz, n, gamma) if alpha is None else alpha
    parts = cut(by_hash(every, k, seed) if start is None else start, "parts")
    yield 0, parts
    degree = e.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("deg"))
    for step in range(1, passes + 1):
        a *= rate
        for b in range(batches):
            sizes = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
            costs = [(p, a * gamma / 2 * sizes.get(p, 0) ** (gamma - 1)) for p in range(k)]
            cost = F.split(F.lit(",".join(repr(c) for _, c in costs)), ",").cast("array<double>")  # one literal
            cheap = min(costs, key=lambda x: (x[1], x[0]))
            near = classes[b].join(parts.withColumnsRenamed({"v": "dst"}), "dst").groupBy(F.col("src").alias("v"), "part").count()
            scored = near.where(F.col("part").between(0, k - 1)).select("v", (F.col("count") - F.element_at(cost, F.col("part") + 1)).alias("score"), "part")
            best = scored.groupBy("v").agg(F.max(F.struct("score", (-F.col("part")).alias("low"))).alias("b"))
            to = F.when((F.lit(-cheap[1]) > F.col("b.score")) | ((F.lit(-cheap[1]) == F.col("b.score")) & (F.lit(-cheap[0]) > F.col("b.low"))), F.lit(cheap[0])).otherwise(-F.col("b.low"))
            moved = best.select("v", to.cast("int").alias("to"))
            if cutoff is not None:
                moved = moved.join(degree.where(F.col("deg") < cutoff), "v", "left_semi")
            parts = cut(parts.join(moved, "v", "left").select("v", F.coalesce("to", "part").alias("part")), "parts")
        yield step, parts
        if stop_balance is not None:
            row = balance(parts).first()
            if row["n_balance"] is not None and row["n_balance"] <= stop_balance:
                return


def restreamed(e: DataFrame, k: int, **options) -> DataFrame:
    """The parts after the last pass."""
    parts = None
    for _, parts in restream(e, k, **options):
        pass
    return parts


# Reports.


def _ends(e: DataFrame, parts: DataFrame) -> DataFrame:
    p = parts.select("v", "part")
    return e.join(p.withColumnsRenamed({"v": "src", "part": "ps"}), "src", "left").join(p.withColumnsRenamed({"v": "dst", "part": "pd"}), "dst", "left")


def edge_cut(e: DataFrame, parts: DataFrame, k: int, low_degree: int | None = None) -> DataFrame:
    """One row (nnz, cut, lambda, of_random): directed entries whose ends differ; unassigned ends differ from all.

    With ``low_degree`` only entries between vertices of fewer neighbours count.
    """
    if low_degree is not None:
        low = e.groupBy("src").count().where(F.col("count") < low_degree).select(F.col("src").alias("x"))
        e = e.join(low.withColumnRenamed("x", "src"), "src", "left_semi").join(low.withColumnRenamed("x", "dst"), "dst", "left_semi")
    apart = F.coalesce(F.col("ps") != F.col("pd"), F.lit(True))
    s = _ends(e, parts).agg(F.count("*").alias("nnz"), F.count_if(apart).alias("cut"))
    share = F.col("cut") / F.when(F.col("nnz") > 0, F.col("nnz"))
    return s.select("nnz", "cut", share.alias("lambda"), (share / ((k - 1) / k)).alias("of_random"))


def cuts_per_part(e: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, nnz, cut) by the part of the source."""
    return _ends(e, parts).groupBy(F.col("ps").alias("part")).agg(F.count("*").alias("nnz"), F.count_if(F.coalesce(F.col("ps") != F.col("pd"), F.lit(True))).alias("cut"))


def sizes(parts: DataFrame, e: DataFrame | None = None) -> DataFrame:
    """(part, n) and with edges also nnz, the sum of the degrees."""
    n = parts.groupBy("part").agg(F.count("*").alias("n"))
    if e is None:
        return n
    d = e.join(parts.withColumnsRenamed({"v": "src"}), "src").groupBy("part").agg(F.count("*").alias("nnz"))
    return n.join(d, "part", "left").select("part", "n", F.coalesce("nnz", F.lit(0)).alias("nnz"))


def balance(parts: DataFrame, e: DataFrame | None = None) -> DataFrame:
    """Most over least vertices of a part, and entries."""
    s = sizes(parts, e)
    out = [(F.max("n") / F.min("n")).alias("n_balance")]
    if e is not None:
        out.append((F.max("nnz") / F.when(F.min("nnz") > 0, F.min("nnz"))).alias("nnz_balance"))
    return s.agg(*out)


def counts_of_assignment(v: DataFrame, parts: DataFrame) -> DataFrame:
    """One row (unassigned, repeated): vertices without a part, and with more than one."""
    per = v.select("v").join(parts, "v", "left").groupBy("v").agg(F.count("part").alias("n"))
    return per.agg(F.count_if(F.col("n") == 0).alias("unassigned"), F.count_if(F.col("n") > 1).alias("repeated"))


def report(e: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, n, inside, density, average_degree): entries inside a part, over its pairs and its vertices."""
    inside = _ends(e, parts).where("ps = pd").groupBy(F.col("ps").alias("part")).agg(F.count("*").alias("inside"))
    s = sizes(parts).join(inside, "part", "left").select("part", "n", F.coalesce("inside", F.lit(0)).alias("inside"))
    return s.select("part", "n", "inside", (F.col("inside") / (F.col("n") * F.col("n"))).alias("density"), (F.col("inside") / F.col("n")).alias("average_degree"))


def chunk_cut_percent(e: DataFrame, n: int, k: int, first: int = 0) -> DataFrame:
    """100 * entries outside the k diagonal blocks of floor(n / k) ids / entries; the remainder is always cut."""
    size = max(1, n // k)
    ps, pd_ = F.floor((F.col("src") - first) / size), F.floor((F.col("dst") - first) / size)
    return e.agg((100.0 * F.count_if((ps != pd_) | (ps >= k)) / F.count("*")).alias("cut_percent"))


def judge_chunks(e: DataFrame, n: int, k: int, first: int = 0) -> DataFrame:
    """One row (balance, cut): most over least entries of k chunks of rows, and the share cut."""
    size = max(1, n // k)
    p = F.least(F.floor((F.col("src") - first) / size), F.lit(k - 1))
    loads = e.groupBy(p.alias("p")).count().agg((F.max("count") / F.min("count")).alias("balance"))
    return loads.crossJoin(chunk_cut_percent(e, n, k, first)).select("balance", (F.col("cut_percent") / 100).alias("cut"))


def permutation(parts: DataFrame) -> DataFrame:
    """(v, new): the members of part 0, then 1, ..., each in order of id."""
    return positions(parts, ["part", "v"], "new").select("v", "part", "new")


def part_ranges(placed: DataFrame) -> DataFrame:
    """(part, lo, hi) of a permutation."""
    return placed.groupBy("part").agg(F.min("new").alias("lo"), F.max("new").alias("hi"))


def block_to_cyclic(new: Column, n: int, owners: int) -> Column:
    """The cyclic id of a block id: (new mod b) * owners + floor(new / b), b = n / owners."""
    b = max(1, n // owners)
    return (new % b) * owners + F.floor(new / b)


def relabel(e: DataFrame, names: DataFrame) -> DataFrame:
    """Both ends of each edge through (v, new)."""
    m = names.select("v", "new")
    both = e.join(m.withColumnsRenamed({"v": "src", "new": "_s"}), "src").join(m.withColumnsRenamed({"v": "dst", "new": "_d"}), "dst")
    return both.select(F.col("_s").alias("src"), F.col("_d").alias("dst"), *[c for c in e.columns if c not in ("src", "dst")])


def slot(v: Column, owners: int, local: int) -> Column:
    """owner * local + place, for owner v mod owners and place v div owners."""
    return (v % owners) * local + F.floor(v / owners)


def redistribute(e: DataFrame, parts: DataFrame, cutoff: int, k: int) -> DataFrame:
    """Edges with their home: rows of fewer than ``cutoff`` entries go whole to their part, those of larger rows
    to the part of their other end, so that no part holds a hub alone."""
    d = e.groupBy("src").agg(F.count("*").alias("deg"))
    both = _ends(e, parts).join(d, "src")
    return both.select("src", "dst", F.coalesce(F.when(F.col("deg") >= cutoff, F.col("pd")).otherwise(F.col("ps")), F.pmod("src", F.lit(k)).cast("int")).alias("home"))


def label_propagation(e: DataFrame, k: int, rounds: int = 5, seed: int = 1) -> DataFrame:
    """A baseline: each vertex takes the commonest part among its neighbours (the lowest of equal ones)."""
    parts = cut(by_hash(vertices(e), k, seed), "parts")
    for _ in range(rounds):
        near = e.join(parts.withColumnsRenamed({"v": "dst"}), "dst").groupBy(F.col("src").alias("v"), "part").count()
        best = near.groupBy("v").agg(F.max(F.struct("count", (-F.col("part")).alias("low"))).alias("b"))
        parts = cut(parts.join(best, "v", "left").select("v", F.coalesce(-F.col("b.low"), "part").cast("int").alias("part")), "parts")
    return parts
