"""Yes-or-no questions about graphs, each one row (answer), and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.operators.components import weak_components
from knotwork.operators.representation import reverse, vertices, weighted
from knotwork.plans.storage import cut


def _is_empty(df: DataFrame, name: str = "answer", negate: bool = False) -> DataFrame:
    n = df.limit(1).agg((F.count("*") == 0).alias(name))
    return n.select((~F.col(name)).alias(name)) if negate else n


def is_directed(e: DataFrame) -> DataFrame:
    """Some edge has no reverse of its weight."""
    e = weighted(e).select("src", "dst", "w")
    return _is_empty(e.join(reverse(e), ["src", "dst", "w"], "left_anti"), negate=True)


def is_symmetric(e: DataFrame) -> DataFrame:
    e = weighted(e).select("src", "dst", "w")
    return _is_empty(e.join(reverse(e), ["src", "dst", "w"], "left_anti"))


def is_simple(e: DataFrame) -> DataFrame:
    """No loop and no weight or number of parallel edges over 1."""
    per = weighted(e).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return per.agg(F.coalesce(~F.bool_or((F.col("src") == F.col("dst")) | (F.col("w") > 1)), F.lit(True)).alias("answer"))


def is_weighted(e: DataFrame) -> DataFrame:
    return _is_empty(weighted(e).where("w <> 1"), negate=True)


def _in_degrees(e: DataFrame, v: DataFrame | None) -> DataFrame:
    own = e.select("src", "dst").distinct().groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("d"))
    return (vertices(e) if v is None else v).join(own, "v", "left").select("v", F.coalesce("d", F.lit(0)).alias("d"))


def is_regular(e: DataFrame, v: DataFrame | None = None) -> DataFrame:
    return _in_degrees(e, v).agg((F.min("d") == F.max("d")).alias("answer"))


def is_complete(e: DataFrame, v: DataFrame | None = None) -> DataFrame:
    """All degrees n - 1, or n with loops."""
    d = _in_degrees(e, v).agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("n"))
    return d.select(((F.col("low") == F.col("high")) & ((F.col("low") == F.col("n") - 1) | (F.col("low") == F.col("n")))).alias("answer"))


def is_eulerian(e: DataFrame, directed: bool = False) -> DataFrame:
    """All degrees even, or in equal to out; connectedness is taken for granted."""
    ends = weighted(e).select(F.col("src").alias("v"), F.col("w").alias("o"), F.lit(0).alias("i")).unionByName(weighted(e).select(F.col("dst").alias("v"), F.lit(0).alias("o"), F.col("w").alias("i")))
    d = ends.groupBy("v").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    return d.agg(F.bool_and(F.col("o") == F.col("i") if directed else F.col("i") % 2 == 0).alias("answer"))


def bipartite(e: DataFrame) -> DataFrame:
    """(v, component, side, proper): two colours, the least vertex of a component has false; proper says whether no edge
    of the component joins equal colours. All components are searched at once, level by level."""
    steps = cut(e.select("src", "dst").unionByName(reverse(e.select("src", "dst"))).distinct(), "steps")
    named = cut(weak_components(e), "components")
    front = seen = cut(named.where("v = component").select("v", F.lit(False).alias("side")), "front")
    while True:
        step = steps.join(front.withColumnRenamed("v", "src"), "src").select(F.col("dst").alias("v"), (~F.col("side")).alias("side")).distinct()
        front = cut(step.groupBy("v").agg(F.min("side").alias("side")).join(seen.select("v"), "v", "left_anti"), "front")
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front), "seen")
    ends = steps.join(seen.withColumnsRenamed({"v": "src", "side": "a"}), "src").join(seen.withColumnsRenamed({"v": "dst", "side": "b"}), "dst")
    wrong = ends.where("a = b").select(F.col("src").alias("v")).join(named, "v").select("component").distinct().withColumn("proper", F.lit(False))
    return seen.join(named, "v").join(wrong, "component", "left").select("v", "component", "side", F.coalesce("proper", F.lit(True)).alias("proper"))


def is_bipartite(e: DataFrame) -> DataFrame:
    return bipartite(e).agg(F.coalesce(F.bool_and("proper"), F.lit(True)).alias("answer"))


def num_nodes(e: DataFrame) -> DataFrame:
    return vertices(e).agg(F.count("*").alias("n"))


def num_edges(e: DataFrame) -> DataFrame:
    """The sum of weights if directed, else half of it with loops counted once."""
    e = weighted(e).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    back = reverse(e).select("src", "dst", F.col("w").alias("b"))
    both = e.join(back, ["src", "dst"], "left")
    s = both.agg(F.coalesce(F.bool_and(F.col("w").eqNullSafe(F.col("b"))), F.lit(True)).alias("sym"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("all"), F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), F.col("w"))), F.lit(0.0)).alias("loops"))
    return s.select(F.when(F.col("sym"), (F.col("all") - F.col("loops")) / 2 + F.col("loops")).otherwise(F.col("all")).cast("double").alias("m"))


def self_loops(e: DataFrame) -> DataFrame:
    """The sum of the loops' weights."""
    return weighted(e).where("src = dst").agg(F.coalesce(F.sum("w"), F.lit(0)).alias("loops"))


def multi_edges(e: DataFrame) -> DataFrame:
    """Places of weight over 1; both directions count."""
    return weighted(e).groupBy("src", "dst").agg(F.sum("w").alias("w")).agg(F.count_if(F.col("w") > 1).alias("n"))


def average_degree(e: DataFrame) -> DataFrame:
    return num_nodes(e).crossJoin(num_edges(e)).select((2 * F.col("m") / F.col("n")).alias("average_degree"))


def link_density(e: DataFrame) -> DataFrame:
    return num_nodes(e).crossJoin(num_edges(e)).select((2 * F.col("m") / (F.col("n") * (F.col("n") - 1))).alias("density"))


def is_connected(e: DataFrame, v: DataFrame | None = None) -> DataFrame:
    return weak_components(e, v).agg((F.count_distinct("component") <= 1).alias("answer"))


def is_tree(e: DataFrame, v: DataFrame | None = None) -> DataFrame:
    n = (vertices(e) if v is None else v).agg(F.count("*").alias("n"))
    both = is_connected(e, v).crossJoin(num_edges(e)).crossJoin(n)
    return both.select((F.col("answer") & (F.col("m") == F.col("n") - 1)).alias("answer"))


def is_graphic(sequence: DataFrame, degree: str = "d") -> DataFrame:
    """The Erdos-Gallai test of a degree sequence; degrees of 0 or less, or an odd sum, fail it.

    The sum over later places of min(k, d) comes from the counts of equal degrees, so that the work grows with
    the number of different degrees and not with the square of the sequence.
    """
    sizes = sequence.groupBy(F.col(degree).alias("d")).agg(F.count("*").alias("c"))
    down = Window.orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    at = sizes.withColumn("k", F.sum("c").over(down)).withColumn("left", F.sum(F.col("c") * F.col("d")).over(down))
    # It is enough to look at the last place of each run of equal degrees.
    later = at.select(F.col("d").alias("d2"), F.col("c").alias("c2"))
    right = at.join(later, F.col("d2") < F.col("d"), "left").groupBy("d", "k", "left").agg(F.coalesce(F.sum(F.col("c2") * F.least("k", "d2")), F.lit(0)).alias("rest"))
    ok = right.agg(F.bool_and(F.col("left") <= F.col("k") * (F.col("k") - 1) + F.col("rest")).alias("ok"))
    base = sequence.agg((F.sum(degree) % 2 == 0).alias("even"), (F.min(degree) > 0).alias("pos"))
    return ok.crossJoin(base).select(F.coalesce(F.col("ok") & F.col("even") & F.col("pos"), F.lit(False)).alias("answer"))

