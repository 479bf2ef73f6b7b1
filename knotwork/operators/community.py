"""Modularity and communities of undirected graphs (both directions stored)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.operators.representation import weighted
from knotwork.operators.spectral import MOST, _on_matrix
from knotwork.plans.storage import cut
from knotwork.shipping import ship


def modularity(e: DataFrame, parts: DataFrame) -> DataFrame:
    """Q = sum over modules of (share of the edges inside) - (share of the ends)^2."""
    p = parts.select("v", F.col("part").alias("p"))
    both = weighted(e).join(p.withColumnsRenamed({"v": "src", "p": "ps"}), "src").join(p.withColumnsRenamed({"v": "dst", "p": "pd"}), "dst")
    per = both.groupBy(F.col("ps").alias("m")).agg(F.sum(F.when(F.col("ps") == F.col("pd"), F.col("w")).otherwise(0)).alias("inside"), F.sum("w").alias("ends"))
    total = per.agg(F.sum("ends").alias("total"))
    return per.crossJoin(F.broadcast(total)).agg(F.sum(F.col("inside") / F.col("total") - F.pow(F.col("ends") / F.col("total"), F.lit(2))).alias("modularity"))


def greedy_merges(a: np.ndarray) -> tuple[list[list[list[int]]], list[float]]:
    """Merging of modules by the greatest gain 2 (e_ij - a_i a_j), all along: the modules and Q of each step."""
    total = a.sum()
    e = a / total
    modules, history, qs = [[i] for i in range(len(a))], [], []

    def q() -> float:
        return float(np.trace(e) - (e.sum(1) ** 2).sum())

    history.append([list(m) for m in modules])
    qs.append(q())
    while len(modules) > 1:
        ends = e.sum(1)
        gain = 2 * (e - np.outer(ends, ends))
        gain[np.tril_indices(len(gain))] = -np.inf
        joined = np.triu(e, 1) > 0
        gain = np.where(joined, gain, -np.inf) if joined.any() else gain
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        modules[i] = sorted(modules[i] + modules[j])
        del modules[j]
        e[i] += e[j]
        e = np.delete(e, j, 0)
        e[:, i] += e[:, j]
        e = np.delete(e, j, 1)
        history.append([list(m) for m in modules])
        qs.append(q())
    return history, qs


def newman_fast(e: DataFrame) -> DataFrame:
    """(v, part) at the step of greatest modularity of the greedy merging."""
    def run(ids: np.ndarray, a: np.ndarray) -> pd.DataFrame:
        history, qs = greedy_merges(a)
        best = history[int(np.argmax(qs))]
        return pd.DataFrame([(int(ids[i]), k) for k, m in enumerate(best) for i in m], columns=["v", "part"])

    return _on_matrix(e, run, "v long, part int", min(MOST, 600))


def merge_history(e: DataFrame) -> DataFrame:
    """(step, modules, q) of the greedy merging."""
    def run(ids: np.ndarray, a: np.ndarray) -> pd.DataFrame:
        history, qs = greedy_merges(a)
        return pd.DataFrame({"step": range(len(qs)), "modules": [len(h) for h in history], "q": qs})

    return _on_matrix(e, run, "step int, modules int, q double", min(MOST, 600))


def _connected(a: np.ndarray) -> bool:
    seen, front = {0}, [0]
    while front:
        for j in np.flatnonzero(a[front.pop()]).tolist():
            if j not in seen:
                seen.add(j)
                front.append(j)
    return len(seen) == len(a)


def newman_eigenvector(e: DataFrame) -> DataFrame:
    """(v, part) by splitting along the leading eigenvector of the modularity matrix, again and again.

    A module stays whole if the greatest eigenvalue is 1e-5 or less, or a half would not be connected; vertices
    of a zero entry go with the positive half.
    """
    def run(ids: np.ndarray, a: np.ndarray) -> pd.DataFrame:
        k, m = a.sum(0), a.sum()
        b = a - np.outer(k, k) / m
        open_, done = [np.arange(len(ids))], []
        while open_:
            g = open_.pop()
            own = b[np.ix_(g, g)] - np.diag(b[np.ix_(g, g)].sum(1))
            value, vector = np.linalg.eigh((own + own.T) / 2)
            x = vector[:, -1]
            x = -x if x[np.argmax(np.abs(x))] < 0 else x
            one, two = g[x >= -1e-12], g[x < -1e-12]
            if value[-1] <= 1e-5 or not len(two) or not len(one) or not _connected(a[np.ix_(one, one)]) or not _connected(a[np.ix_(two, two)]):
                done.append(g)
            else:
                open_ += [one, two]
        done.sort(key=lambda g: int(g.min()))
        return pd.DataFrame([(int(ids[i]), p) for p, g in enumerate(done) for i in g], columns=["v", "part"])

    return _on_matrix(e, run, "v long, part int")


def _edge_flows(a: np.ndarray) -> np.ndarray:
    """Shortest-path flow over each entry of a small graph, from every vertex in turn."""
    n = len(a)
    near = [np.flatnonzero(a[v]).tolist() for v in range(n)]
    flow = np.zeros((n, n))
    for s in range(n):
        level, paths, order = {s: 0}, {s: 1.0}, [s]
        for v in order:
            for u in near[v]:
                if u not in level:
                    level[u], paths[u] = level[v] + 1, 0.0
                    order.append(u)
                if level[u] == level[v] + 1:
                    paths[u] += paths[v]
        owed = dict.fromkeys(order, 0.0)
        for u in reversed(order):
            for v in near[u]:
                if level[v] == level[u] - 1:
                    share = (1 + owed[u]) * paths[v] / paths[u]
                    flow[v, u] += share
                    owed[v] += share
    return flow


def _labels(a: np.ndarray) -> np.ndarray:
    """The least vertex of each vertex's component."""
    out = np.full(len(a), -1)
    for s in range(len(a)):
        if out[s] < 0:
            front = [s]
            while front:
                v = front.pop()
                if out[v] < 0:
                    out[v] = s
                    front += np.flatnonzero((a[v] > 0) & (out < 0)).tolist()
    return out


def girvan_newman(e: DataFrame, modules: int) -> DataFrame:
    """(v, part): the edges of greatest betweenness go, one pair at a time, until there are ``modules`` components;
    part is the component's smallest vertex, ties go to the first pair in order."""
    def run(ids: np.ndarray, a: np.ndarray) -> pd.DataFrame:
        a = ((a + a.T) > 0).astype(float)
        np.fill_diagonal(a, 0)
        while len(np.unique(named := _labels(a))) < modules and a.any():
            flow = np.round(_edge_flows(a), 9)
            i, j = np.unravel_index(int(np.maximum(flow, flow.T).argmax()), a.shape)
            a[i, j] = a[j, i] = 0
        return pd.DataFrame({"v": ids, "part": ids[named]})

    return _on_matrix(e, run, "v long, part long", 600)


def louvain_moves(a: np.ndarray, take: str = "max", rounds: int = 100) -> np.ndarray:
    """The first phase of Louvain, vertices in order: a vertex moves to the neighbour's module of greatest gain,
    if that is positive. With take "min" it looks at the least gain instead, so that a neighbour of its own module
    (gain 0) keeps it where it is."""
    n, total, k = len(a), a.sum(), a.sum(1)
    module = np.arange(n)
    for _ in range(rounds):
        moved = False
        for v in range(n):
            gains = {}
            for u in np.flatnonzero(a[v]).tolist():
                to = module[u]
                if u == v or to in gains:
                    continue
                if to == module[v]:
                    gains[to] = 0.0
                    continue
                there = (module == to).nonzero()[0]
                here = np.setdiff1d((module == module[v]).nonzero()[0], [v])
                gains[to] = float((a[v, there].sum() - a[v, here].sum()) * 2 / total - 2 * k[v] * (k[there].sum() - k[here].sum()) / total**2)
            if gains:
                pick = (max if take == "max" else min)(gains.items(), key=lambda x: (x[1], -x[0]) if take == "max" else (x[1], x[0]))
                if pick[1] > 1e-12:
                    module[v], moved = pick[0], True
        if not moved:
            break
    return np.unique(module, return_inverse=True)[1]


def louvain(e: DataFrame, take: str = "max") -> DataFrame:
    return _on_matrix(e, lambda ids, a: pd.DataFrame({"v": ids, "part": louvain_moves(a, take).astype("int32")}), "v long, part int", 2000)


def louvain_rounds(e: DataFrame, rounds: int | None = 10, seed: int = 1, most: int = 2_000_000) -> DataFrame:
    """(v, part) by Louvain moves on the cluster: in a round half of the vertices look at their neighbours'
    modules as they stood before it, and move where the gain is greatest and positive. Ends when no vertex of
    either half would move, or after ``rounds``; with None it goes on until then, and fails after 500.

    Up to ``most`` vertices the driver holds the modules and a round is one job over packed rows of edges; beyond
    that the modules are a table and a round joins it. Both make the same moves."""
    e = cut(weighted(e).where("src <> dst").groupBy("src", "dst").agg(F.sum("w").cast("double").alias("w")), "edges")
    total = e.agg(F.sum("w")).first()[0] or 1.0
    k = cut(e.groupBy(F.col("src").alias("v")).agg(F.sum("w").alias("k")), "ends")
    if k.count() <= most:
        return _rounds_over_rows(e, k, total, rounds, seed)
    parts = k.select("v", F.col("v").alias("part"))
    for step in range(500 if rounds is None else rounds):
        sums = parts.join(k, "v").groupBy("part").agg(F.sum("k").alias("total"))
        near = e.join(parts.withColumnsRenamed({"v": "dst"}), "dst").groupBy(F.col("src").alias("v"), "part").agg(F.sum("w").alias("into"))
        own = parts.join(k, "v").join(sums, "part").select("v", F.col("part").alias("home"), "k", F.col("total").alias("home_total"))
        both = near.join(own, "v").join(sums, "part")
        inside = near.withColumnsRenamed({"part": "home", "into": "stay"})
        both = both.join(inside, ["v", "home"], "left").where("part <> home")
        gain = (F.col("into") - F.coalesce("stay", F.lit(0.0))) * 2 / total - 2 * F.col("k") * (F.col("total") - (F.col("home_total") - F.col("k"))) / total**2
        best = both.select("v", F.struct(gain.alias("g"), (-F.col("part")).alias("p")).alias("b")).groupBy("v").agg(F.max("b").alias("b")).where("b.g > 1e-12")
        new = cut(parts.join(best, "v", "left").select("v", F.when(_moving(seed, step), -F.col("b.p")).alias("to"), "part", F.col("b").isNotNull().alias("would")), "parts")
        parts = new.select("v", F.coalesce("to", "part").alias("part"))
        if new.where("would").isEmpty():
            break
    else:
        if rounds is None:
            raise RuntimeError("the modules did not settle")
    return parts


def _moving(seed: int, step: int) -> Column:
    """Whether a vertex is of the half that moves in this round."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "v"), F.lit(2)) == 0


def _rounds_over_rows(e: DataFrame, k: DataFrame, total: float, rounds: int | None, seed: int) -> DataFrame:
    spark = e.sparkSession
    ship(spark)
    ends = k.toArrow().sort_by("v")
    ids, part = ends["v"].to_numpy(), np.arange(len(ends), dtype=np.int32)
    named, degree = spark.sparkContext.broadcast(ids), spark.sparkContext.broadcast(ends["k"].to_numpy())
    tasks = max(spark.sparkContext.defaultParallelism, e.count() // 1_000_000)
    rows = cut(e.select("src", "dst", "w").repartition(tasks, "src").mapInArrow(_packed(named), "s binary, d binary, w binary"), "rows")
    schema = f"v {e.schema['src'].dataType.simpleString()}, i int, part int"
    for step in range(500 if rounds is None else rounds):
        now = spark.sparkContext.broadcast(part)
        best = rows.mapInArrow(_best_moves(named, degree, now, total), schema).select("i", "part", _moving(seed, step).alias("moves")).toArrow()
        now.destroy()
        if not len(best):
            break
        i, to, moves = (best[c].to_numpy() for c in ("i", "part", "moves"))
        part = part.copy()
        part[i[moves]] = to[moves]
    else:
        if rounds is None:
            raise RuntimeError("the modules did not settle")
    named.destroy()
    degree.destroy()
    return spark.createDataFrame(pa.table({"v": ends["v"], "part": ends["v"].take(pa.array(part))}))


def _packed(named: Broadcast, size: int = 1 << 19) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges by source, as positions of the ends among the vertices in order: about ``size`` in a row, those of a
    source together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = named.value
        read = [[np.searchsorted(ids, x.column(i).to_numpy(zero_copy_only=False)).astype(np.int32) for i in (0, 1)] + [x.column(2).to_numpy()] for x in batches if x.num_rows]
        if not read:
            return
        s, d, w = (np.concatenate(c) for c in zip(*read))
        by = np.argsort(s, kind="stable")
        s, d, w, lo = s[by], d[by], w[by], 0
        while lo < len(s):
            hi = int(np.searchsorted(s, s[min(lo + size, len(s)) - 1], "right"))
            yield pa.RecordBatch.from_arrays([pa.array([x[lo:hi].tobytes()], pa.binary()) for x in (s, d, w)], names=["s", "d", "w"])
            lo = hi

    return run


def _best_moves(named: Broadcast, degree: Broadcast, now: Broadcast, total: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(v, i, part) of the vertices that gain by a move: the position among all and the module of the greatest gain,
    of equal ones the least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, k, part = named.value, degree.value, now.value
        n, sums = len(part), np.bincount(part, k, len(part))
        for batch in batches:
            for packed in zip(*(c.to_pylist() for c in batch.columns)):
                s, d, w = (np.frombuffer(x, t) for x, t in zip(packed, ("i4", "i4", "f8")))
                key = s.astype(np.int64) * n + part[d]
                by = np.argsort(key)
                key = key[by]
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                into, v, to = np.add.reduceat(w[by], first), (key[first] // n).astype(np.int32), (key[first] % n).astype(np.int32)
                own, low = to == part[v], int(s[0])
                stay = np.zeros(int(s[-1]) - low + 1)
                stay[v[own] - low] = into[own]
                v, to, into = v[~own], to[~own], into[~own]
                gain = (into - stay[v - low]) * 2 / total - 2 * k[v] * (sums[to] - (sums[part[v]] - k[v])) / total**2
                some = gain > 1e-12
                v, to, gain = v[some], to[some], gain[some]
                by = np.lexsort((-to, gain, v))
                last = by[np.r_[v[by][1:] != v[by][:-1], True]] if len(by) else by
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[v[last]], v[last], to[last])], names=["v", "i", "part"])

    return run
