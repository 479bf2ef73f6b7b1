"""Shortest paths and what is measured on all of them.

One source relaxes edges round by round, and only vertices whose distance fell relax again. All-pairs measures
keep a row for each pair, so they are refused beyond a stated number of vertices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.operators.representation import vertices, weighted
from knotwork.plans.storage import cut

MOST_PAIRS = 4_000_000


def shortest_paths(e: DataFrame, source: int, most_rounds: int = 10_000) -> DataFrame:
    """(v, dist, prev) of what the source reaches; weights of 0 or less are no edges; of equal ways the least prev."""
    steps = weighted(e).where("w > 0").groupBy("src", "dst").agg(F.min("w").cast("double").alias("w"))
    start = e.sparkSession.range(1).select(F.lit(source).cast("long").alias("v"), F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("prev"))
    known, front = cut(start, "dist"), cut(start.select("v", "dist"), "front")
    for _ in range(most_rounds):
        sent = steps.join(front.withColumnsRenamed({"v": "src"}), "src").select(F.col("dst").alias("v"), (F.col("dist") + F.col("w")).alias("d"), F.col("src").alias("p"))
        best = sent.groupBy("v").agg(F.min(F.struct("d", "p")).alias("b"))
        both = known.join(best, "v", "outer")
        better = F.col("b").isNotNull() & (F.col("dist").isNull() | (F.col("b.d") < F.col("dist")))
        new = cut(both.select("v", F.when(better, F.col("b.d")).otherwise(F.col("dist")).alias("dist"), F.when(better, F.col("b.p")).otherwise(F.col("prev")).alias("prev"), better.alias("moved")), "dist")
        known, front = new.select("v", "dist", "prev"), new.where("moved").select("v", "dist")
        if front.isEmpty():
            return known
    raise RuntimeError("distances did not settle")


def path_to(tree: DataFrame, target: int, most_steps: int = 10_000) -> list[int]:
    """The vertices of the way to ``target``, first to last; empty if it is not reached. One lookup a step."""
    way, at = [], target
    for _ in range(most_steps):
        row = tree.where(F.col("v") == at).select("prev").first()
        if row is None:
            return []
        way.append(at)
        if row[0] is None:
            return way[::-1]
        at = row[0]
    raise RuntimeError("the way does not end")


def staged_costs(e: DataFrame, target: int, steps: int) -> DataFrame:
    """(v, cost, next): the least cost to ``target`` in at most ``steps`` steps, by dynamic programming."""
    arcs = weighted(e).groupBy("src", "dst").agg(F.min("w").cast("double").alias("w"))
    cost = cut(e.sparkSession.range(1).select(F.lit(target).cast("long").alias("v"), F.lit(0.0).alias("cost"), F.lit(None).cast("long").alias("next")), "cost")
    for _ in range(steps):
        reach = arcs.join(cost.select(F.col("v").alias("dst"), "cost"), "dst").select(F.col("src").alias("v"), (F.col("cost") + F.col("w")).alias("cost"), F.col("dst").alias("next"))
        cost = cut(cost.unionByName(reach).groupBy("v").agg(F.min(F.struct("cost", "next")).alias("b")).select("v", "b.cost", "b.next"), "cost")
    return cost


def all_pairs(e: DataFrame, v: DataFrame | None = None, most: int = MOST_PAIRS) -> DataFrame:
    """(a, b, d) of all reachable pairs, a to itself at 0."""
    every = vertices(e) if v is None else v
    n = every.count()
    if n * n > most:
        raise ValueError(f"{n} vertices make more than {most} pairs")
    steps = weighted(e).where("w > 0").groupBy("src", "dst").agg(F.min("w").cast("double").alias("w"))
    known = cut(every.select(F.col("v").alias("a"), F.col("v").alias("b"), F.lit(0.0).alias("d")), "pairs")
    front = known
    while True:
        sent = front.join(steps.withColumnRenamed("src", "b"), "b").groupBy("a", F.col("dst").alias("b")).agg(F.min(F.col("d") + F.col("w")).alias("n"))
        both = known.join(sent, ["a", "b"], "outer")
        better = F.col("n").isNotNull() & (F.col("d").isNull() | (F.col("n") < F.col("d")))
        new = cut(both.select("a", "b", F.when(better, F.col("n")).otherwise(F.col("d")).alias("d"), better.alias("moved")), "pairs")
        known, front = new.select("a", "b", "d"), new.where("moved").select("a", "b", "d")
        if front.isEmpty():
            return known


def _spread(pairs: DataFrame, v: DataFrame) -> DataFrame:
    """(v, far, total, reached) of each vertex; infinite where some vertex is out of reach."""
    n = v.agg(F.count("*").alias("n"))
    s = pairs.groupBy(F.col("a").alias("v")).agg(F.max("d").alias("far"), F.sum("d").alias("total"), F.count("*").alias("reached")).crossJoin(F.broadcast(n))
    inf = F.lit(float("inf"))
    return s.select("v", F.when(F.col("reached") < F.col("n"), inf).otherwise(F.col("far")).alias("far"), F.when(F.col("reached") < F.col("n"), inf).otherwise(F.col("total")).alias("total"), "reached")


def eccentricity(pairs: DataFrame, v: DataFrame) -> DataFrame:
    return _spread(pairs, v).select("v", F.col("far").alias("eccentricity"))


def diameter(pairs: DataFrame, v: DataFrame) -> DataFrame:
    return _spread(pairs, v).agg(F.max("far").alias("diameter"))


def radius(pairs: DataFrame, v: DataFrame) -> DataFrame:
    return _spread(pairs, v).agg(F.min("far").alias("radius"))


def closeness(pairs: DataFrame, v: DataFrame) -> DataFrame:
    """(v, closeness): 1 over the sum of distances, 0 where some vertex is out of reach."""
    return _spread(pairs, v).select("v", F.when(F.col("total") > 0, F.lit(1.0) / F.col("total")).otherwise(0.0).alias("closeness"))


def average_path_length(pairs: DataFrame, v: DataFrame) -> DataFrame:
    n = v.agg(F.count("*").alias("n"))
    return pairs.agg(F.sum("d").alias("s")).crossJoin(n).select((F.col("s") / (F.col("n") * F.col("n") - F.col("n"))).alias("average"))


def distance_distribution(pairs: DataFrame, v: DataFrame) -> DataFrame:
    """(d, share) for d from 1 to n - 1: share of the ordered pairs at distance d."""
    n = v.count()
    k = pairs.where("a <> b").groupBy("d").agg(F.count("*").alias("k"))
    space = pairs.sparkSession.range(1, n).select(F.col("id").cast("double").alias("d"))
    return space.join(k, "d", "left").select("d", (F.coalesce("k", F.lit(0)) / (n * (n - 1))).alias("share"))


def smooth_diameter(pairs: DataFrame, v: DataFrame, share: float = 0.9) -> DataFrame:
    """The distance, interpolated, at which ``share`` of the pairs are covered."""
    d = distance_distribution(pairs, v)
    w = Window.orderBy("d")
    run = d.withColumn("upto", F.sum("share").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.lag("upto", 1, 0.0).over(w))
    hit = run.where((F.col("upto") >= share) & (F.col("before") < share))
    return hit.agg(F.min(F.col("d") - (F.col("upto") - share) / (F.col("upto") - F.col("before"))).alias("smooth_diameter"))


def minimum_spanning_tree(e: DataFrame) -> DataFrame:
    """(src, dst, w) of a minimum spanning forest, by Boruvka's rounds; ties go to the lesser (src, dst)."""
    from knotwork.operators.components import weak_components

    pairs = cut(weighted(e).where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("w").alias("w")), "pairs")
    names, chosen = cut(vertices(e).select("v", F.col("v").alias("component")), "names"), None
    while True:
        out = pairs.join(names.withColumnsRenamed({"v": "src", "component": "cs"}), "src").join(names.withColumnsRenamed({"v": "dst", "component": "cd"}), "dst").where("cs <> cd")
        offers = out.select(F.explode(F.array("cs", "cd")).alias("c"), F.struct("w", "src", "dst").alias("o"))
        new = cut(offers.groupBy("c").agg(F.min("o").alias("o")).select("o.*").distinct().select("src", "dst", "w"), "chosen")
        if new.isEmpty():
            return chosen if chosen is not None else new
        chosen = new if chosen is None else cut(chosen.unionByName(new), "chosen")
        names = cut(weak_components(chosen, vertices(e)), "names")
