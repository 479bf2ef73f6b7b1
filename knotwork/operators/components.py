"""Connected components: weak ones by star contraction, strong ones by colouring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators.representation import reverse, vertices
from knotwork.plans.storage import cut

ROUNDS = 64


def weak_components(e: DataFrame, v: DataFrame | None = None) -> DataFrame:
    """(v, component): component is the smallest vertex reachable, directions left aside.

    Each round hangs every vertex on the least neighbour of its neighbours (large star), then joins the ends of
    what is left (small star); rounds grow with the logarithm of the longest path, and a round is two grouped
    minima and two joins.
    """
    every = vertices(e) if v is None else v.select("v").distinct()
    stars = cut(e.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    before = None
    for _ in range(ROUNDS):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        stars = cut(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "stars")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    named = every.join(stars.select(F.col("v").alias("c"), F.col("u").alias("v")), "v", "left")
    return named.select("v", F.coalesce("c", "v").alias("component"))


def component_count(e: DataFrame, v: DataFrame | None = None) -> DataFrame:
    return weak_components(e, v).agg(F.count_distinct("component").alias("n"))


def giant_component(e: DataFrame, v: DataFrame | None = None) -> DataFrame:
    """(v) of the largest component; of equal ones that of the smallest vertex."""
    c = weak_components(e, v)
    largest = c.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    return c.join(F.broadcast(largest), "component", "left_semi").select("v")


def strong_components(e: DataFrame, v: DataFrame | None = None) -> DataFrame:
    """(v, component): component is the smallest vertex of the strongly connected component.

    Rounds of colouring: every vertex takes the least colour that reaches it; what reaches back inside a colour
    from its root is one component, and leaves the graph.
    """
    left_v = cut((vertices(e) if v is None else v.select("v").distinct()), "vertices")
    left_e, done = cut(e.where("src <> dst").select("src", "dst").distinct(), "edges"), None
    while not left_v.isEmpty():
        colour = _least_reaching(left_v, left_e)
        inside = left_e.join(colour.withColumnsRenamed({"v": "src", "c": "cs"}), "src").join(colour.withColumnsRenamed({"v": "dst", "c": "cd"}), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("c"))
        own = _reach_back(colour, inside)
        done = own if done is None else done.unionByName(own)
        left_v = cut(left_v.join(own, "v", "left_anti"), "vertices")
        left_e = cut(left_e.join(own.withColumnRenamed("v", "src"), "src", "left_anti").join(own.withColumnRenamed("v", "dst"), "dst", "left_anti").select("src", "dst"), "edges")
    return done if done is not None else left_v.select("v", F.col("v").alias("component"))


def _least_reaching(v: DataFrame, e: DataFrame) -> DataFrame:
    colour = cut(v.select("v", F.col("v").alias("c")), "colours")
    while True:
        sent = e.join(colour.withColumnRenamed("v", "src"), "src").groupBy(F.col("dst").alias("v")).agg(F.min("c").alias("m"))
        new = cut(colour.join(sent, "v", "left").select("v", F.least("c", F.coalesce("m", "c")).alias("c"), (F.col("m") < F.col("c")).alias("moved")), "colours")
        colour = new.select("v", "c")
        if new.where("moved").isEmpty():
            return colour


def _reach_back(colour: DataFrame, inside: DataFrame) -> DataFrame:
    found = cut(colour.where("v = c").select("v", F.col("c").alias("component")), "found")
    front, back = found, reverse(inside)
    while True:
        step = front.join(back.withColumnRenamed("src", "v"), "v").select(F.col("dst").alias("v"), "component").distinct()
        front = cut(step.join(found, "v", "left_anti"), "front")
        if front.isEmpty():
            return found
        found = cut(found.unionByName(front), "found")
