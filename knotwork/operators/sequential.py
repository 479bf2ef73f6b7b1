"""Generators and rewirings in which each step looks at all before it.

They run as one grouped pandas function and so in one task; each refuses more than MOST vertices, or swaps.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators.representation import reverse, undirected_pairs
from knotwork.plans.ranking import positions
from knotwork.plans.storage import cut
from knotwork.shipping import ship

MOST = 2_000_000
Edges = list[tuple[int, int]]


def _grown(spark: SparkSession, n: int, make: Callable[[np.random.Generator], Edges], seed: int, directed: bool = False) -> DataFrame:
    if n > MOST:
        raise ValueError(f"{n} vertices are beyond {MOST}")
    ship(spark)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        e = make(np.random.default_rng(seed))
        if not directed:
            e = e + [(b, a) for a, b in e if a != b]
        out = pd.DataFrame(e, columns=["src", "dst"], dtype="int64")
        out["w"] = 1
        return out

    return spark.range(1).groupBy("id").applyInPandas(lambda rows: run(rows), "src long, dst long, w int")


def preferential_attachment(spark: SparkSession, n: int, m: int, seed: int = 1) -> DataFrame:
    """Each new vertex joins m different earlier ones, by degree."""

    def make(r: np.random.Generator) -> Edges:
        e, ends = [(a, b) for a in range(m + 1) for b in range(a)], []
        for a, b in e:
            ends += [a, b]
        for v in range(m + 1, n):
            chosen: set[int] = set()
            while len(chosen) < m:
                chosen.add(ends[int(r.integers(len(ends)))])
            for u in sorted(chosen):
                e.append((v, u))
                ends += [v, u]
        return e

    return _grown(spark, n, make, seed)


def price_model(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """Citations: each new vertex cites one earlier one with probability by its citations plus one."""

    def make(r: np.random.Generator) -> Edges:
        e, pool = [], [0]
        for v in range(1, n):
            u = pool[int(r.integers(len(pool)))]
            e.append((v, u))
            pool += [u, v]
        return e

    return _grown(spark, n, make, seed, directed=True)


def master_equation_growth(spark: SparkSession, n: int, m: int, a: float, seed: int = 1) -> DataFrame:
    """m links of each new vertex to earlier ones with probability by in-degree plus a."""

    def make(r: np.random.Generator) -> Edges:
        e, into = [], np.zeros(n)
        for v in range(1, n):
            p = into[:v] + a
            for u in r.choice(v, size=min(m, v), replace=False, p=p / p.sum()).tolist():
                e.append((v, u))
                into[u] += 1
        return e

    return _grown(spark, n, make, seed, directed=True)


def trade_off_tree(spark: SparkSession, n: int, alpha: float, seed: int = 1) -> DataFrame:
    """Points in the unit square: each joins the one of least alpha * distance + hops to the first."""

    def make(r: np.random.Generator) -> Edges:
        at, hops, e = r.random((n, 2)), np.zeros(n), []
        for v in range(1, n):
            u = int(np.argmin(alpha * np.hypot(*(at[:v] - at[v]).T) + hops[:v]))
            hops[v] = hops[u] + 1
            e.append((v, u))
        return e

    return _grown(spark, n, make, seed)


def forest_fire(spark: SparkSession, n: int, p: float, r_back: float, seed: int = 1) -> DataFrame:
    """Each new vertex links to one earlier and burns on along its links, forward with p and backward with p * r."""

    def make(r: np.random.Generator) -> Edges:
        out: list[list[int]] = [[] for _ in range(n)]
        into: list[list[int]] = [[] for _ in range(n)]
        for v in range(1, n):
            seen, front = {v}, [int(r.integers(v))]
            while front:
                u = front.pop()
                if u in seen:
                    continue
                seen.add(u)
                out[v].append(u)
                into[u].append(v)
                for links, share in ((out[u], p), (into[u], p * r_back)):
                    open_ = [x for x in links if x not in seen]
                    k = min(len(open_), int(r.geometric(1 - share)) - 1) if share < 1 else len(open_)
                    front += [open_[i] for i in r.permutation(len(open_))[:k].tolist()]
        return [(v, u) for v in range(n) for u in out[v]]

    return _grown(spark, n, make, seed, directed=True)


def spatial_distribution(spark: SparkSession, n: int, beta: float, seed: int = 1) -> DataFrame:
    """Points join the network, nearest to the first ones first, at least distance plus beta * way to the root."""

    def make(r: np.random.Generator) -> Edges:
        at = r.random((n, 2))
        at = at[np.argsort(np.hypot(*at.T))]
        way, e = np.zeros(n), []
        for v in range(1, n):
            d = np.hypot(*(at[:v] - at[v]).T)
            u = int(np.argmin(d + beta * (way[:v] + d)))
            way[v] = way[u] + d[u]
            e.append((v, u))
        return e

    return _grown(spark, n, make, seed)


def hierarchy_with_shortcuts(spark: SparkSession, n: int, branching: int, extra: int, lam: float, xi: float, seed: int = 1) -> DataFrame:
    """A tree with ``extra`` more links, likelier between vertices near each other (xi) and high up (lam)."""

    def make(r: np.random.Generator) -> Edges:
        up = [0] + [(v - 1) // branching for v in range(1, n)]
        level = [0] * n
        for v in range(1, n):
            level[v] = level[up[v]] + 1
        e = {(v, up[v]) for v in range(1, n)}
        tries = 0
        while len(e) < n - 1 + extra and tries < 1000 * (extra + 1):
            tries += 1
            a, b = (int(x) for x in r.integers(n, size=2))
            if a == b or (a, b) in e or (b, a) in e:
                continue
            i, j, da, db = a, b, 0, 0
            while i != j:
                if level[i] >= level[j]:
                    i, da = up[i], da + 1
                else:
                    j, db = up[j], db + 1
            x = math.sqrt(max(0, da * da + db * db - 2))
            if r.random() < math.exp(-level[i] / lam) * math.exp(-x / xi):
                e.add((a, b))
        return sorted(e)

    return _grown(spark, n, make, seed)


def havel_hakimi(degrees: list[int]) -> Edges:
    """A simple graph of a degree sequence: the greatest degree joins the next greatest ones."""
    left = [[d, v] for v, d in enumerate(degrees)]
    e: Edges = []
    while True:
        left.sort(key=lambda x: (-x[0], x[1]))
        d, v = left[0]
        if d == 0:
            return e
        if d >= len(left) or left[d][0] == 0:
            raise ValueError("the sequence is not graphic")
        left[0][0] = 0
        for x in left[1 : d + 1]:
            x[0] -= 1
            e.append((v, x[1]))


def from_degree_sequence(spark: SparkSession, degrees: list[int]) -> DataFrame:
    return _grown(spark, len(degrees), lambda r: havel_hakimi(degrees), 0)


def largest_s(degrees: list[int]) -> Edges:
    """A connected simple graph of the sequence with a large sum of products of joined degrees: pairs are tried
    from the largest product down, and taken while both have room and the rest can still be joined up.

    Pairs are not listed: those of one product come from the classes of equal degree, and only vertices that still
    have room are looked at."""
    n = len(degrees)
    by = sorted(range(n), key=lambda v: (-degrees[v], v))
    room = list(degrees)
    near: list[set[int]] = [set() for _ in range(n)]

    def join(a: int, b: int) -> None:
        for x, y in ((a, b), (b, a)):
            room[x] -= 1
            near[x].add(y)

    first = 0
    for k in range(1, n):  # a tree first: each vertex on the greatest that has room
        while first < k and room[by[first]] <= 0:
            first += 1
        if first == k:
            raise ValueError("the sequence has no connected graph")
        join(by[k], by[first])
    open_: dict[int, list[int]] = {}
    for v in range(n):
        if room[v] > 0:
            open_.setdefault(degrees[v], []).append(v)
    products: dict[int, list[tuple[int, int]]] = {}
    for x in open_:
        for y in open_:
            if x >= y:
                products.setdefault(x * y, []).append((x, y))
    for product in sorted(products, reverse=True):
        classes = [(x, y) for x, y in products[product] if open_[x] and open_[y]]
        if not classes:
            continue
        other = dict(classes)
        full = {y: _Open(open_[y]) for y in other.values()}
        for a in heapq.merge(*(open_[x] for x in other)):
            y = other[degrees[a]]
            at = full[y].find(bisect.bisect_right(open_[y], a) if y == degrees[a] else 0)
            while room[a] > 0 and at < len(open_[y]):
                b = open_[y][at]
                if room[b] <= 0:
                    full[y].close(at)
                elif b not in near[a]:
                    join(a, b)
                at = full[y].find(at + 1)
        for x in {x for pair in classes for x in pair}:
            open_[x] = [v for v in open_[x] if room[v] > 0]
    return sorted((a, b) for a in range(n) for b in near[a] if a < b)


class _Open:
    """The places of a list that are not closed: ``find`` gives the first from a place on, in nearly constant time."""

    def __init__(self, own: list[int]) -> None:
        self.to = list(range(len(own) + 1))

    def find(self, at: int) -> int:
        top = at
        while top < len(self.to) - 1 and self.to[top] != top:
            top = self.to[top]
        while at < top:
            at, self.to[at] = self.to[at], top
        return top

    def close(self, at: int) -> None:
        self.to[at] = at + 1


def largest_s_graph(spark: SparkSession, degrees: list[int]) -> DataFrame:
    return _grown(spark, len(degrees), lambda r: largest_s(degrees), 0)


def uniform_regular(spark: SparkSession, n: int, degree: int, seed: int = 1) -> DataFrame:
    """A random regular graph without loops or parallel edges, by stub pairing with repairs."""

    def make(r: np.random.Generator) -> Edges:
        for _ in range(200):
            stubs = np.repeat(np.arange(n), degree)
            r.shuffle(stubs)
            pairs = [[int(a), int(b)] for a, b in stubs.reshape(-1, 2)]
            held: dict[tuple[int, int], int] = {}
            for a, b in pairs:
                held[min(a, b), max(a, b)] = held.get((min(a, b), max(a, b)), 0) + 1
            for _ in range(20 * len(pairs)):  # bad pairs swap an end with a random one, until none is left
                bad = [k for k, (a, b) in enumerate(pairs) if a == b or held[min(a, b), max(a, b)] > 1]
                if not bad:
                    return sorted(e for e, c in held.items() if c)
                for k in bad:
                    j = int(r.integers(len(pairs)))
                    for a, b in (pairs[k], pairs[j]) if j != k else ():
                        held[min(a, b), max(a, b)] -= 1
                    if j != k:
                        pairs[k][1], pairs[j][1] = pairs[j][1], pairs[k][1]
                        for a, b in (pairs[k], pairs[j]):
                            held[min(a, b), max(a, b)] = held.get((min(a, b), max(a, b)), 0) + 1
                        held = {e: c for e, c in held.items() if c} if len(held) > 3 * len(pairs) else held
        raise ValueError("no regular graph was found")

    if n * degree % 2:
        raise ValueError("an odd number of stubs")
    return _grown(spark, n, make, seed)


def rewired(e: DataFrame, k: int, seed: int = 1, toward: int = 0) -> DataFrame:
    """k swaps that keep all degrees of an undirected graph; toward 1 or -1 takes only swaps that raise, or lower,
    the sum of products of joined degrees, and so the assortativity.

    The draws are known before the edges are: places in the order of the edges. So one task folds over the draws with
    the drawn edges and those among their ends, which grow with k; the other edges stay where they are."""
    if k > MOST:
        raise ValueError(f"{k} swaps are beyond {MOST}")
    spark = e.sparkSession
    ship(spark)
    placed = cut(positions(undirected_pairs(e), ["src", "dst"]), "placed")
    degree = cut(placed.select(F.explode(F.array("src", "dst")).alias("v")).groupBy("v").agg(F.count("*").alias("d")), "degrees")
    n, r = placed.count(), np.random.default_rng(seed)
    now: dict[int, tuple[int, int]] = {}
    tries = 0
    done = 0
    while done < k and tries < 200 * k + 1000 and n > 1:
        draws = [(*(int(x) for x in r.choice(n, 2, replace=False)), bool(r.random() < 0.5)) for _ in range(min(2 * k + 1000, 200 * k + 1000 - tries))]
        tries += len(draws)
        drawn = {i for draw in draws for i in draw[:2]}
        own = placed.join(spark.createDataFrame([(i,) for i in sorted(drawn)], "pos long"), "pos").select(F.explode(F.array("src", "dst")).alias("v"))
        moved = spark.createDataFrame([(v,) for i in sorted(drawn & now.keys()) for v in now[i]], "v long")
        ends = cut(degree.join(own.unionByName(moved).distinct(), "v"), "ends")
        among = placed.join(ends.withColumnsRenamed({"v": "src", "d": "ds"}), "src").join(ends.withColumnsRenamed({"v": "dst", "d": "dd"}), "dst")
        fold = _swaps(draws, now, {row["v"]: row["d"] for row in ends.collect()} if toward else {}, k - done, toward)
        rows = among.groupBy(F.lit(0).alias("g")).applyInPandas(fold, "pos long, src long, dst long, done long").collect()
        now |= {row["pos"]: (row["src"], row["dst"]) for row in rows}
        done += max((row["done"] for row in rows), default=0)
    changed = spark.createDataFrame([(i, *x) for i, x in sorted(now.items())], "pos long, src long, dst long")
    out = placed.join(changed, "pos", "left_anti").select("src", "dst").unionByName(changed.select("src", "dst")).withColumn("w", F.lit(1))
    return out.unionByName(reverse(out))


def _swaps(draws: list[tuple[int, int, bool]], now: dict[int, tuple[int, int]], d: dict[int, int], k: int, toward: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A function from edges (pos, src, dst) to the changed ones, after ``now`` and at most k swaps of ``draws``."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = dict(zip(rows["pos"].tolist(), zip(rows["src"].tolist(), rows["dst"].tolist(), strict=True), strict=True)) | now
        held, new, done = set(own.values()), {}, 0
        for i, j, turn in draws:
            if done == k:
                break
            (a, b), (x, y) = own[i], own[j]
            if turn:
                x, y = y, x
            if len({a, b, x, y}) < 4:
                continue
            one, two = (min(a, y), max(a, y)), (min(x, b), max(x, b))
            if one in held or two in held:
                continue
            if toward and (d[a] * d[y] + d[x] * d[b] - d[a] * d[b] - d[x] * d[y]) * toward <= 0:
                continue
            held -= {own[i], own[j]}
            held |= {one, two}
            own[i] = new[i] = one
            own[j] = new[j] = two
            done += 1
        return pd.DataFrame([(i, *x, done) for i, x in new.items()], columns=["pos", "src", "dst", "done"], dtype="int64")

    return run
