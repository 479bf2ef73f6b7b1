"""Message passing on labelled graphs, its error measures, and what prepares and tests its data.

nodes: (graph_id, node_id, labels ARRAY<DOUBLE>, target, mask); edges: (graph_id, src, dst).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions.random import order, uniform
from knotwork.operators.components import weak_components
from knotwork.operators.matrix import times_vector
from knotwork.operators.representation import reverse, undirected_pairs
from knotwork.plans.storage import cut
from knotwork.shipping import ship


def fixpoint(m: DataFrame, offset: DataFrame, stop: float = 1e-6, most_rounds: int = 100) -> DataFrame:
    """y = M y + E from E on, until the sum of changes over the sum of values falls below ``stop``; (idx, val)."""
    y = cut(offset.select("idx", "val"), "state")
    for _ in range(most_rounds):
        sent = times_vector(m, y).unionByName(offset.select("idx", "val")).groupBy("idx").agg(F.sum("val").alias("val"))
        new = cut(sent.join(y.withColumnRenamed("val", "old"), "idx", "left").select("idx", "val", F.coalesce("old", F.lit(0.0)).alias("old")), "state")
        apart, size = new.agg(F.sum(F.abs(F.col("val") - F.col("old"))), F.sum(F.abs("val"))).first()
        y = new.select("idx", "val")
        if not size or apart / size < stop:
            break
    return y


def mean_aggregation(e: DataFrame, share: float = 0.9) -> DataFrame:
    """(row, col, val): what a vertex takes from each neighbour, ``share`` divided by the sender's out-degree."""
    out = e.groupBy("src").agg(F.count("*").alias("n"))
    return e.join(out, "src").groupBy(F.col("dst").alias("row"), F.col("src").alias("col")).agg(F.sum(F.lit(share) / F.col("n")).alias("val"))


def neural_rounds(nodes: DataFrame, edges: DataFrame, layers: list[tuple[np.ndarray, np.ndarray]], width: int, stop: float = 1e-4, most_rounds: int = 30) -> DataFrame:
    """(node_id, x ARRAY<DOUBLE>): x_v = sum over u -> v of net(labels_v, labels_u, x_u), until it settles.

    layers are (weights, bias), tanh between and after; the messages are made by Arrow batches of edges, and added
    by component with partial aggregation before the shuffle.
    """
    ship(nodes.sparkSession)
    labels = nodes.select("node_id", "labels")
    base = edges.select("src", "dst").join(labels.withColumnsRenamed({"node_id": "dst", "labels": "ld"}), "dst").join(labels.withColumnsRenamed({"node_id": "src", "labels": "ls"}), "src")
    base = cut(base, "edges")
    state = cut(nodes.select("node_id", F.array_repeat(F.lit(0.0), width).alias("x")), "state")

    def message(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            h = np.concatenate([np.stack(b[c].to_list()) for c in ("ld", "ls", "x")], 1)
            for w, bias in layers:
                h = np.tanh(h @ w + bias)
            yield pd.DataFrame({"node_id": b["dst"], "m": list(h)})

    for _ in range(most_rounds):
        sent = base.join(state.withColumnRenamed("node_id", "src"), "src").select("dst", "ld", "ls", "x").mapInPandas(lambda it: message(it), "node_id long, m array<double>")
        parts = sent.groupBy("node_id").agg(F.array(*[F.sum(F.col("m")[k]) for k in range(width)]).alias("m"))
        new = cut(state.join(parts, "node_id", "left").select("node_id", F.coalesce("m", F.array_repeat(F.lit(0.0), width)).alias("x"), F.col("x").alias("old")), "state")
        change = F.aggregate(F.zip_with("x", "old", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v)
        size = F.aggregate("x", F.lit(0.0), lambda s, v: s + F.abs(v))
        apart, total = new.agg(F.sum(change), F.sum(size)).first()
        state = new.select("node_id", "x")
        if not total or apart / total < stop:
            break
    return state


# Errors: rows (out, target, mask).


def squared_error(rows: DataFrame) -> DataFrame:
    return rows.agg((F.sum(F.pow(F.col("out") - F.col("target"), F.lit(2)) * F.col("mask")) / 2).alias("error"))


def quadratic_error(rows: DataFrame) -> DataFrame:
    return rows.agg((F.sum(F.col("out") * F.col("mask") * F.col("out")) / 2).alias("error"))


def product_error(rows: DataFrame, state: str = "state") -> DataFrame:
    """Squared error of the output times the first component of the state."""
    return rows.agg((F.sum(F.pow(F.col("out") * F.col(state) - F.col("target"), F.lit(2)) * F.col("mask")) / 2).alias("error"))


def pair_closeness_error(rows: DataFrame) -> DataFrame:
    """Sum over pairs of nodes of a graph of 1 / ((difference of outputs)^2 + 0.001); rows (graph_id, node_id, out)."""
    a = rows.select("graph_id", "node_id", "out")
    both = a.join(a.withColumnsRenamed({"node_id": "other", "out": "far"}), "graph_id").where("node_id < other")
    return both.agg(F.sum(F.lit(1.0) / (F.pow(F.col("out") - F.col("far"), F.lit(2)) + 0.001)).alias("error"))


def ranking_error(rows: DataFrame, alpha: float = 70.0) -> DataFrame:
    """Mean over pairs of supervised nodes of log(1 + exp(-alpha * (difference of outputs in the right order)))."""
    a = rows.where("mask <> 0").select("graph_id", "node_id", "out", "target")
    both = a.join(a.withColumnsRenamed({"node_id": "other", "out": "far", "target": "aim"}), "graph_id").where("target > aim")
    x = -alpha * (F.col("out") - F.col("far"))
    return both.agg(F.avg(F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))).alias("error"))


def reconstruction_error(rows: DataFrame, eps: float = 1e-3) -> DataFrame:
    """Sum of (squared distance of output and input + eps)^target / 2; rows (out ARRAY, inp ARRAY, target)."""
    apart = F.aggregate(F.zip_with("out", "inp", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return rows.agg((F.sum(F.pow(apart + eps, F.col("target"))) / 2).alias("error"))


def confusion(rows: DataFrame) -> DataFrame:
    """(predicted, actual, n) by sign of output and target."""
    return rows.where("mask <> 0").groupBy((F.col("out") > 0).alias("predicted"), (F.col("target") > 0).alias("actual")).agg(F.count("*").alias("n"))


def accuracy(rows: DataFrame) -> DataFrame:
    return rows.where("mask <> 0").agg(F.avg(((F.col("out") > 0) == (F.col("target") > 0)).cast("double")).alias("accuracy"))


def within_tolerance(rows: DataFrame, tolerance: float) -> DataFrame:
    return rows.where("mask <> 0").agg(F.avg((F.abs(F.col("out") - F.col("target")) <= tolerance).cast("double")).alias("share"))


def graph_accuracy(rows: DataFrame) -> DataFrame:
    """(graph_id, correct): whether all supervised nodes of a graph are right."""
    return rows.where("mask <> 0").groupBy("graph_id").agg(F.bool_and((F.col("out") > 0) == (F.col("target") > 0)).alias("correct"))


# Data.


def normalized(train: DataFrame, other: DataFrame, width: int) -> DataFrame:
    """``other`` with labels put between -1 and 1 by the least and greatest values of ``train``."""
    span = train.agg(*[f(F.col("labels")[k]).alias(f"{n}{k}") for k in range(width) for n, f in (("lo", F.min), ("hi", F.max))])
    new = F.array(*[F.when(F.col(f"hi{k}") > F.col(f"lo{k}"), 2 * (F.col("labels")[k] - F.col(f"lo{k}")) / (F.col(f"hi{k}") - F.col(f"lo{k}")) - 1).otherwise(0.0) for k in range(width)])
    return other.crossJoin(F.broadcast(span)).withColumn("labels", new).select(*other.columns)


def class_weights(nodes: DataFrame) -> DataFrame:
    """``nodes`` with mask scaled so that both classes weigh the same."""
    counts = nodes.where("mask <> 0").agg(F.count_if(F.col("target") > 0).alias("p"), F.count_if(F.col("target") <= 0).alias("q"))
    small = F.least("p", "q")
    scale = F.when(F.col("target") > 0, small / F.when(F.col("p") > 0, F.col("p"))).otherwise(small / F.when(F.col("q") > 0, F.col("q")))
    return nodes.crossJoin(F.broadcast(counts)).withColumn("mask", F.col("mask") * F.coalesce(scale, F.lit(1.0))).select(*nodes.columns)


def principal_components(train: DataFrame, other: DataFrame, width: int, keep: int) -> DataFrame:
    """``other`` with labels on the ``keep`` main axes of the standardised labels of ``train``: moments come from one
    aggregate of width^2 columns, the axes from the driver."""
    sums = [F.avg(F.col("labels")[i]).alias(f"m{i}") for i in range(width)] + [F.avg(F.col("labels")[i] * F.col("labels")[j]).alias(f"s{i}_{j}") for i in range(width) for j in range(i, width)]
    row = train.agg(*sums).first()
    mean = np.array([row[f"m{i}"] for i in range(width)])
    cov = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(width)] for i in range(width)]) - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-24))
    value, vector = np.linalg.eigh(cov / np.outer(sd, sd))
    axes = vector[:, np.argsort(-value, kind="stable")[:keep]]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1, 1)
    new = F.array(*[sum(((F.col("labels")[i] - float(mean[i])) / float(sd[i]) * float(axes[i, k]) for i in range(width)), F.lit(0.0)) for k in range(keep)])
    return other.withColumn("labels", new)


def block_expanded(a: DataFrame, block: DataFrame, size: int) -> DataFrame:
    """Each entry of a (row, col, val) becomes a block of size x size (i, j, x), scaled."""
    return a.crossJoin(F.broadcast(block)).select((F.col("row") * size + F.col("i")).alias("row"), (F.col("col") * size + F.col("j")).alias("col"), (F.col("val") * F.col("x")).alias("val"))


def edge_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, labels): the labels of both ends after one another."""
    n = nodes.select("node_id", "labels")
    both = edges.join(n.withColumnsRenamed({"node_id": "src", "labels": "a"}), "src").join(n.withColumnsRenamed({"node_id": "dst", "labels": "b"}), "dst")
    return both.select("src", "dst", F.concat("a", "b").alias("labels"))


def connected(e: DataFrame, v: DataFrame) -> DataFrame:
    """``e`` (both directions) with one more edge from each component's least vertex to the next component's."""
    from pyspark.sql import Window

    first = weak_components(e, v).select("component").distinct()
    nxt = first.select(F.col("component").alias("src"), F.lead("component").over(Window.orderBy("component")).alias("dst")).where("dst IS NOT NULL")
    return e.select("src", "dst").unionByName(nxt).unionByName(reverse(nxt))


def cliques(e: DataFrame, n: int) -> DataFrame:
    """(c ARRAY) of the cliques of n vertices, each once in order of id: one join for each further vertex."""
    pairs = undirected_pairs(e)
    found = pairs.select(F.array("src", "dst").alias("c"))
    for _ in range(n - 2):
        grown = found.join(pairs, F.element_at("c", -1) == F.col("src")).select(F.col("c"), F.col("dst").alias("x"))
        for k in range(1, 64):
            if k >= n:
                break
            grown = grown.join(pairs.select(F.col("src").alias(f"_a{k}"), F.col("dst").alias(f"_b{k}")), (F.try_element_at("c", F.lit(k)) == F.col(f"_a{k}")) & (F.col("x") == F.col(f"_b{k}")), "left").where(F.col(f"_a{k}").isNotNull() | F.try_element_at("c", F.lit(k)).isNull()).drop(f"_a{k}", f"_b{k}")
        found = grown.select(F.concat("c", F.array("x")).alias("c")).distinct()
    return found


def labelled_subgraphs(e: DataFrame, labels: DataFrame, pattern: list[tuple[int, int]], wanted: list[int]) -> DataFrame:
    """(v0, v1, ...) of all places where the pattern, with the wanted labels (v, label), is an induced subgraph."""
    edges = e.select("src", "dst").distinct()
    have = set(pattern)
    found: DataFrame | None = None
    for k, want in enumerate(wanted):
        own = labels.where(F.col("label") == want).select(F.col("v").alias(f"v{k}"))
        if found is None:
            found = own
            continue
        linked = [j for j in range(k) if (j, k) in have or (k, j) in have]
        if not linked:
            raise ValueError("each vertex of a pattern must be joined to one before it")
        first = linked[0]
        step = edges if (first, k) in have else reverse(edges)
        found = found.join(step.select(F.col("src").alias(f"v{first}"), F.col("dst").alias(f"v{k}")), f"v{first}").join(own, f"v{k}", "left_semi")
        found = found.where(" AND ".join(f"v{j} <> v{k}" for j in range(k)))
        for j in range(k):
            for a, b in ((j, k), (k, j)):
                if (a, b) == ((first, k) if (first, k) in have else (k, first)):
                    continue
                pair = edges.select(F.col("src").alias(f"v{a}"), F.col("dst").alias(f"v{b}"))
                found = found.join(pair, [f"v{a}", f"v{b}"], "left_semi" if (a, b) in have else "left_anti")
    return found.select(*[f"v{k}" for k in range(len(wanted))])


def labelled_graphs(spark: SparkSession, graphs: int, size: int, p: float, rule, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Random graphs with one 0/1 label for each node, and targets by ``rule``(labels, sum over neighbours, degree)."""
    nodes = spark.range(graphs * size).select(F.floor(F.col("id") / size).alias("graph_id"), F.col("id").alias("node_id"), (uniform(seed, F.lit(0), "id") < 0.5).cast("double").alias("l"))
    ahead = nodes.select("graph_id", F.col("node_id").alias("src"), F.explode(F.sequence(F.col("node_id"), (F.col("graph_id") + 1) * size - 1)).alias("dst"))
    half = ahead.where((F.col("src") < F.col("dst")) & (uniform(seed, F.lit(1), "src", "dst") < p))
    edges = half.unionByName(half.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = edges.join(nodes.select(F.col("node_id").alias("dst"), "l"), "dst").groupBy(F.col("src").alias("node_id")).agg(F.sum("l").alias("s"), F.count("*").alias("n"))
    out = nodes.join(near, "node_id", "left").select("graph_id", "node_id", F.array("l").alias("labels"), F.when(rule(F.col("l"), F.coalesce("s", F.lit(0.0)), F.coalesce("n", F.lit(0))), 1.0).otherwise(-1.0).alias("target"), F.lit(1.0).alias("mask"))
    return out, edges


def _chosen(nodes: DataFrame, count: int, seed: int) -> DataFrame:
    """(graph_id, node_id, k): ``count`` nodes of each graph in a seeded random order; a graph's nodes meet in one window."""
    from pyspark.sql import Window

    own = Window.partitionBy("graph_id").orderBy(*order(seed, "node_id"))
    return nodes.select("graph_id", "node_id", (F.row_number().over(own) - 1).alias("k")).where(F.col("k") < count)


def planted_cliques(spark: SparkSession, graphs: int, size: int, p: float, clique: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Random graphs, in each of which ``clique`` nodes are joined to each other; the targets of these are 1, of others -1."""
    nodes, edges = labelled_graphs(spark, graphs, size, p, even_degree_rule, seed)
    members = _chosen(nodes, clique, seed + 1)
    pairs = members.select("graph_id", F.col("node_id").alias("src")).join(members.select("graph_id", F.col("node_id").alias("dst")), "graph_id").where("src <> dst")
    planted = nodes.drop("target").join(members.select("node_id", "k"), "node_id", "left")
    return planted.select("graph_id", "node_id", "labels", F.when(F.col("k").isNotNull(), 1.0).otherwise(-1.0).alias("target"), "mask"), edges.unionByName(pairs).distinct()


def planted_subgraphs(spark: SparkSession, graphs: int, size: int, p: float, pattern: list[tuple[int, int]], wanted: list[float], seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Random graphs, in each of which nodes with the ``wanted`` labels are joined as the pattern says, both ways and in no
    other way; the targets of these are 1, of others -1."""
    nodes, edges = labelled_graphs(spark, graphs, size, p, even_degree_rule, seed)
    places = cut(_chosen(nodes, len(wanted), seed + 1), "places")
    at = [places.where(F.col("k") == k).select("graph_id", F.col("node_id").alias(f"v{k}")) for k in range(len(wanted))]
    both = sorted({pair for a, b in pattern for pair in ((a, b), (b, a))})
    made = None
    for a, b in both:
        one = at[a].join(at[b], "graph_id").select("graph_id", F.col(f"v{a}").alias("src"), F.col(f"v{b}").alias("dst"))
        made = one if made is None else made.unionByName(one)
    ids = places.select("node_id")
    inside = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select("src", "dst")
    kept = edges.join(inside, ["src", "dst"], "left_anti").select("graph_id", "src", "dst")
    label = F.element_at(F.array(*(F.lit(float(x)) for x in wanted)), F.col("k") + 1)
    planted = nodes.drop("target").join(places.select("node_id", "k"), "node_id", "left")
    named = planted.select("graph_id", "node_id", F.when(F.col("k").isNotNull(), F.array(label)).otherwise(F.col("labels")).alias("labels"), F.when(F.col("k").isNotNull(), 1.0).otherwise(-1.0).alias("target"), "mask")
    return named, kept if made is None else kept.unionByName(made)


def parity_rule(label: Column, near: Column, n: Column) -> Column:
    return (label + near) % 2 == 1


def neighbour_rule(label: Column, near: Column, n: Column) -> Column:
    return near * 2 > n


def even_degree_rule(label: Column, near: Column, n: Column) -> Column:
    return n % 2 == 0
