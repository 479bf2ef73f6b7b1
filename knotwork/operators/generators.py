"""Graph generators whose edges are pure functions of a seed and a row number: any partitioning, one answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions.random import integer, order, uniform
from knotwork.operators.representation import reverse
from knotwork.plans.ranking import positions


def _bits(scale: int, per_level) -> tuple[Column, Column]:
    """Both ends of an edge from its bits, level 1 the lowest."""
    i, j = F.lit(0).cast("long"), F.lit(0).cast("long")
    for level in range(scale):
        a, b = per_level(level)
        i, j = i + a.cast("long") * (1 << level), j + b.cast("long") * (1 << level)
    return i, j


def kronecker(spark: SparkSession, scale: int, edge_factor: int = 16, a: float = 0.57, b: float = 0.19, c: float = 0.19, seed: int = 1, relabel: bool = True) -> DataFrame:
    """(src, dst) of edge_factor * 2^scale edges: at each level the row bit, then the column bit given it."""
    edges = edge_factor << scale

    def level(k: int) -> tuple[Column, Column]:
        row = uniform(seed, F.lit(2 * k), "id") > a + b
        col = uniform(seed, F.lit(2 * k + 1), "id") > F.when(row, F.lit(c / (1 - a - b))).otherwise(F.lit(a / (a + b)))
        return row, col

    i, j = _bits(scale, level)
    e = spark.range(edges).select(i.alias("src"), j.alias("dst"))
    return e.select(*(scrambled(F.col(x), scale, seed).alias(x) for x in ("src", "dst"))) if relabel else e


def rmat(spark: SparkSession, scale: int, edge_factor: int = 16, a: float = 0.55, b: float = 0.1, c: float = 0.1, seed: int = 1, relabel: bool = True) -> DataFrame:
    """(src, dst) by quadrants, whose shares wander by five per cent from level to level."""
    d = 1 - a - b - c
    state = F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"), F.lit(d).alias("d"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))

    def step(s: Column, k: Column) -> Column:
        r = uniform(seed, k, F.lit(0), "id")
        to_j = ((r > s["a"]) & (r <= s["a"] + s["b"])) | (r > s["a"] + s["b"] + s["c"])
        to_i = r > s["a"] + s["b"]
        moved = [s[x] * (0.95 + uniform(seed, k, F.lit(n + 1), "id") / 10) for n, x in enumerate("abcd")]
        total = moved[0] + moved[1] + moved[2] + moved[3]
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        return F.struct(*[(m / total).alias(x) for m, x in zip(moved, "abcd", strict=True)], (s["i"] + F.when(to_i, bit).otherwise(F.lit(0).cast("long"))).alias("i"), (s["j"] + F.when(to_j, bit).otherwise(F.lit(0).cast("long"))).alias("j"))

    walked = spark.range(edge_factor << scale).select(F.aggregate(F.sequence(F.lit(scale - 1), F.lit(0), F.lit(-1)), state, step).alias("s"))
    e = walked.select(F.col("s.i").alias("src"), F.col("s.j").alias("dst"))
    return e.select(*(scrambled(F.col(x), scale, seed).alias(x) for x in ("src", "dst"))) if relabel else e


def scrambled(v: Column, scale: int, seed: int) -> Column:
    """A bijection of the ids below 2^scale: multiply by odd numbers and fold the high bits down, twice."""
    mask = F.lit((1 << scale) - 1).cast("long")
    out, half = v, max(1, scale // 2)
    for k in range(2):
        odd = ((seed * 2654435761 + k * 40503 + 12345) & ((1 << min(scale, 20)) - 1)) | 1
        out = (out * F.lit(odd).cast("long") + F.lit(seed + k).cast("long")).bitwiseAND(mask)
        out = out.bitwiseXOR(F.shiftrightunsigned(out, half))
    return out


def permuted_labels(e: DataFrame, seed: int) -> DataFrame:
    """Both ends through a seeded random permutation of the vertices that occur."""
    v = e.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
    ids = positions(v, ["v"], "old")
    new = positions(v.select("v", order(seed, "v")[0].alias("_o")), ["_o", "v"], "place").select("v", "place")
    to = ids.select(F.col("old").alias("place"), F.col("v").alias("named")).join(new, "place").select("v", "named")
    both = e.join(to.withColumnsRenamed({"v": "src", "named": "_s"}), "src").join(to.withColumnsRenamed({"v": "dst", "named": "_d"}), "dst")
    return both.select(F.col("_s").alias("src"), F.col("_d").alias("dst"), *[c for c in e.columns if c not in ("src", "dst")])


def shuffled(e: DataFrame, seed: int) -> DataFrame:
    """The edges in a seeded random order."""
    return e.orderBy(*order(seed, *e.columns))


def _pairs(spark: SparkSession, n: int, directed: bool) -> DataFrame:
    """Ordered pairs without loops, or src < dst, made row by row from the source: no product of tables."""
    rows = spark.range(n).select(F.col("id").alias("src"))
    first = F.lit(0).cast("long") if directed else F.col("src") + 1
    wide = rows.where(first <= n - 1).select("src", F.explode(F.sequence(first, F.lit(n - 1).cast("long"))).alias("dst"))
    return wide.where("src <> dst")


def pair_draw(seed: int, a: Column, b: Column) -> Column:
    """What ``erdos_renyi`` draws for an undirected pair: it is an edge if this is below p."""
    return uniform(seed, F.least(a, b), F.greatest(a, b))


def erdos_renyi(spark: SparkSession, n: int, p: float = 0.5, directed: bool = False, seed: int = 1) -> DataFrame:
    """(src, dst, w): every pair with probability p; undirected edges come both ways."""
    e = _pairs(spark, n, directed).where(uniform(seed, "src", "dst") < p).withColumn("w", F.lit(1))
    return e if directed else e.unionByName(reverse(e))


def random_edges(spark: SparkSession, n: int, m: int, seed: int = 1) -> DataFrame:
    """(src, dst, w) of m different undirected edges, both ways."""
    e = _pairs(spark, n, False).orderBy(*order(seed, "src", "dst")).limit(m).withColumn("w", F.lit(1))
    return e.unionByName(reverse(e))


def modular(spark: SparkSession, n: int, modules: int, p: float, within: float, seed: int = 1) -> DataFrame:
    """Planted modules (v mod modules) of density p over all, a share ``within`` of the edges inside them."""
    pairs = n * (n - 1) / 2
    inside = sum((s := n // modules + (k < n % modules)) * (s - 1) / 2 for k in range(modules))
    p_in, p_out = min(1.0, within * p * pairs / max(1.0, inside)), min(1.0, (1 - within) * p * pairs / max(1.0, pairs - inside))
    same = F.col("src") % modules == F.col("dst") % modules
    e = _pairs(spark, n, False).where(uniform(seed, "src", "dst") < F.when(same, p_in).otherwise(p_out)).withColumn("w", F.lit(1))
    return e.unionByName(reverse(e))


def nested_hierarchies(spark: SparkSession, n: int, levels: int, groups: int, mean_degree: float, ratio: float, seed: int = 1) -> DataFrame:
    """Groups in groups: a pair's probability falls by ``ratio`` with each level that it does not share."""
    def group(v: Column, level: int) -> Column:
        return F.floor(v * (groups**level) / n)

    shared = F.lit(0)
    for level in range(1, levels + 1):
        shared = shared + (group(F.col("src"), level) == group(F.col("dst"), level)).cast("int")
    weight = F.pow(F.lit(ratio), F.lit(levels) - shared)
    pairs = _pairs(spark, n, False).select("src", "dst", weight.alias("p"))
    total = pairs.agg(F.sum("p")).first()[0] or 1.0
    e = pairs.where(uniform(seed, "src", "dst") < F.col("p") * (mean_degree * n / 2 / total)).select("src", "dst", F.lit(1).alias("w"))
    return e.unionByName(reverse(e))


def growth_tree(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """A tree in which each new vertex hangs on a uniformly drawn earlier one."""
    e = spark.range(1, n).select(F.col("id").alias("src"), integer(F.col("id"), seed, "id").alias("dst"), F.lit(1).alias("w"))
    return e.unionByName(reverse(e))


def stub_matching(degrees: DataFrame, seed: int = 1) -> DataFrame:
    """(src, dst, w) of a degree sequence (v, d): stubs in a random order are joined two by two; loops and
    parallel edges may come out, and an odd stub is left."""
    stubs = degrees.where("d > 0").select("v", F.explode(F.sequence(F.lit(1), F.col("d").cast("int"))).alias("k"))
    placed = positions(stubs.select("v", "k", order(seed, "v", "k")[0].alias("_o")), ["_o", "v", "k"])
    pair = placed.groupBy(F.floor(F.col("pos") / 2).alias("pair")).agg(F.min(F.struct("pos", "v")).alias("a"), F.max(F.struct("pos", "v")).alias("b"), F.count("*").alias("n"))
    e = pair.where("n = 2").select(F.col("a.v").alias("src"), F.col("b.v").alias("dst"), F.lit(1).alias("w"))
    return e.unionByName(reverse(e))


def drawn_degrees(spark: SparkSession, n: int, kind: str, mean: float, seed: int = 1) -> DataFrame:
    """(v, d): degrees drawn uniform, normal, binomial (as its normal limit) or exponential about a mean."""
    u, w = uniform(seed, F.lit(0), "id"), uniform(seed, F.lit(1), "id")
    normal = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * 3.141592653589793 * w)
    value = {"uniform": u * 2 * mean, "normal": mean + normal * mean / 4, "binomial": mean + normal * (mean * (1 - mean / n)) ** 0.5, "exponential": -mean * F.log(1 - u)}[kind]
    return spark.range(n).select(F.col("id").alias("v"), F.greatest(F.round(value), F.lit(0.0)).cast("int").alias("d"))


def ring_lattice(spark: SparkSession, n: int, k: int) -> DataFrame:
    """The k-regular ring: k/2 neighbours on each side, and the opposite vertex where k is odd."""
    if k >= n or k % 2 and n % 2:
        raise ValueError("no such regular ring")
    near = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(max(1, k // 2)))).alias("s"))
    e = near.select("src", ((F.col("src") + F.col("s")) % n).alias("dst")) if k > 1 else None
    if k % 2:
        across = spark.range(n // 2).select(F.col("id").alias("src"), (F.col("id") + n // 2).alias("dst"))
        e = across if e is None else e.unionByName(across)
    return e.unionByName(reverse(e)).distinct().withColumn("w", F.lit(1))


def _both(e: DataFrame) -> DataFrame:
    return e.unionByName(reverse(e)).distinct().withColumn("w", F.lit(1))


def canonical(spark: SparkSession, n: int, kind: str, branching: int = 2) -> DataFrame:
    """Nets by name, vertices from 0: line, circle, star, clique, btree, tree, htree, trilattice, sqlattice, hexlattice."""
    v = spark.range(n).select(F.col("id").alias("src"))
    s = F.col("src")
    side = max(1, int(round(n**0.5)))

    def steps(*targets: tuple[Column, Column]) -> DataFrame:
        out = None
        for to, ok in targets:
            part = v.where(ok).select("src", to.cast("long").alias("dst"))
            out = part if out is None else out.unionByName(part)
        return out.where((F.col("dst") >= 0) & (F.col("dst") < n))

    right, down = (s % side != side - 1), (s + side < n)
    row = F.floor(s / side)
    if kind == "line":
        return _both(steps((s + 1, s < n - 1)))
    if kind == "circle":
        return _both(steps(((s + 1) % n, F.lit(n > 1))))
    if kind == "star":
        return _both(v.where("src > 0").select(F.lit(0).cast("long").alias("src"), F.col("src").alias("dst")))
    if kind == "clique":  # each row has its pairs both ways: nothing to shuffle
        return _pairs(spark, n, True).withColumn("w", F.lit(1))
    if kind in ("btree", "tree"):
        b = 2 if kind == "btree" else branching
        return _both(v.where("src > 0").select("src", F.floor((s - 1) / b).alias("dst")))
    if kind == "htree":
        tree = v.where("src > 0").select("src", F.floor((s - 1) / branching).alias("dst"))
        edges, first, width = tree, 0, 1
        while first < n:  # siblings of a level are joined in a row
            last = min(first + width, n)
            edges = edges.unionByName(v.where((s >= first) & (s < last - 1)).select("src", (s + 1).alias("dst")))
            first, width = last, width * branching
        return _both(edges)
    if kind == "sqlattice":
        return _both(steps((s + 1, right), (s + side, down)))
    if kind == "trilattice":
        return _both(steps((s + 1, right), (s + side, down), (s + side + 1, right & down)))
    if kind == "hexlattice":
        return _both(steps((s + 1, right), (s + side, down & ((row + s % side) % 2 == 0))))
    raise ValueError(f"no net of kind {kind}")


def root_samples(spark: SparkSession, n: int, seed: int, count: Sequence[int] | int = 64) -> DataFrame:
    """(i, x): reproducible numbers in [0, 1)."""
    return spark.range(count).select(F.col("id").alias("i"), uniform(seed, "id").alias("x"), integer(n, seed, "id").alias("v"))
