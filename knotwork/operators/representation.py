"""Representations of a graph, and the ways between them.

Edges are (src, dst, w); an undirected graph stores both directions. Adjacency lists are (v, nbrs), incidence is
(node, edge_id, sign). Isolated vertices are known only from a vertex table (v).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.plans.ranking import positions


def weighted(e: DataFrame) -> DataFrame:
    return e if "w" in e.columns else e.withColumn("w", F.lit(1.0))


def reverse(e: DataFrame) -> DataFrame:
    return e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in e.columns if c not in ("src", "dst")])


def vertices(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array("src", "dst")).alias("v")).distinct()


def positive(e: DataFrame) -> DataFrame:
    """Edges as stored entries: those of weight over 0."""
    return weighted(e).where("w > 0")


def without_loops(e: DataFrame) -> DataFrame:
    return e.where("src <> dst")


def simple_edges(e: DataFrame) -> DataFrame:
    """Weights 1, no loops; parallel edges stay."""
    return without_loops(e).select("src", "dst", F.lit(1).alias("w"))


def simple_graph(e: DataFrame) -> DataFrame:
    """Weights 1, no loops, no parallel edges."""
    return without_loops(e).select("src", "dst").distinct().withColumn("w", F.lit(1))


def symmetrized(e: DataFrame) -> DataFrame:
    """The greater of an edge's weight and its reverse's, both ways."""
    return weighted(e).unionByName(reverse(weighted(e))).groupBy("src", "dst").agg(F.max("w").alias("w"))


def with_reverses(e: DataFrame) -> DataFrame:
    """Edges with the reverses that are missing."""
    missing = reverse(weighted(e)).join(e.select("src", "dst"), ["src", "dst"], "left_anti").dropDuplicates(["src", "dst"])
    return weighted(e).unionByName(missing)


def added_weights(e: DataFrame) -> DataFrame:
    """Parallel edges in one, their weights added."""
    return weighted(e).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def undirected_pairs(e: DataFrame) -> DataFrame:
    """Each pair of neighbours once, src < dst."""
    return e.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def adjacency_lists(e: DataFrame, v: DataFrame | None = None) -> DataFrame:
    """(v, nbrs) in order of id; vertices without edges have an empty list."""
    lists = positive(e).groupBy(F.col("src").alias("v")).agg(F.sort_array(F.collect_set("dst")).alias("nbrs"))
    every = vertices(e) if v is None else v
    return every.join(lists, "v", "left").select("v", F.coalesce("nbrs", F.array().cast("array<long>")).alias("nbrs"))


def arrival_lists(e: DataFrame, sequence: str) -> DataFrame:
    """(v, nbrs) in the order of the column ``sequence``; repeats stay."""
    held = e.groupBy(F.col("src").alias("v")).agg(F.array_sort(F.collect_list(F.struct(sequence, "dst"))).alias("x"))
    return held.select("v", F.col("x.dst").alias("nbrs"))


def edges_of_lists(adj: DataFrame) -> DataFrame:
    return adj.select(F.col("v").alias("src"), F.explode("nbrs").alias("dst"), F.lit(1).alias("w"))


def matrix_of_lists(adj: DataFrame) -> DataFrame:
    return edges_of_lists(adj).distinct().select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("w").alias("val"))


def matrix_of_edges(e: DataFrame, sequence: str | None = None) -> DataFrame:
    """(row, col, val) with ids compacted to their ranks; of repeated edges the last by ``sequence`` counts."""
    ids = positions(vertices(e), ["v"], "rank")
    one = weighted(e).groupBy("src", "dst").agg((F.max_by("w", sequence) if sequence else F.max("w")).alias("w"))
    out = one.join(ids.withColumnsRenamed({"v": "src", "rank": "row"}), "src").join(ids.withColumnsRenamed({"v": "dst", "rank": "col"}), "dst")
    return out.select("row", "col", F.col("w").alias("val"))


def edges_of_matrix(a: DataFrame) -> DataFrame:
    return a.where("val > 0").select(F.col("row").alias("src"), F.col("col").alias("dst"), F.col("val").alias("w"))


def incidence(e: DataFrame, directed: bool) -> DataFrame:
    """(node, edge_id, sign): tail -1 and head +1, both +1 if undirected, a loop a single +1; weight w is w columns."""
    own = positive(e) if directed else positive(e).where("src <= dst")
    parallel = own.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
    named = positions(parallel.select("src", "dst", "k"), ["src", "dst", "k"], "edge_id")
    tail = named.where("src <> dst").select(F.col("src").alias("node"), "edge_id", F.lit(-1 if directed else 1).alias("sign"))
    return tail.unionByName(named.select(F.col("dst").alias("node"), "edge_id", F.lit(1).alias("sign")))


def edges_of_incidence(inc: DataFrame) -> DataFrame:
    """(src, dst, w) of an incidence; columns without -1 are undirected and come both ways."""
    held = inc.groupBy("edge_id").agg(F.max(F.when(F.col("sign") < 0, F.col("node"))).alias("tail"), F.max(F.when(F.col("sign") > 0, F.col("node"))).alias("head"), F.min("node").alias("low"), F.count("*").alias("n"))
    held = held.withColumn("head", F.when(F.col("n") > 2, F.raise_error(F.lit("an incidence column has more than two ends"))).otherwise(F.col("head")))
    directed = held.where("tail IS NOT NULL").select(F.col("tail").alias("src"), F.col("head").alias("dst"))
    plain = held.where("tail IS NULL").select(F.col("low").alias("src"), F.col("head").alias("dst"))
    both = plain.unionByName(reverse(plain.where("src <> dst")))
    return directed.unionByName(both).groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def to_string(adj: DataFrame) -> DataFrame:
    """One row (text): ``.`` before each neighbour, ``,`` after each vertex, vertices in order of id."""
    parts = adj.select("v", F.concat(F.array_join(F.transform("nbrs", lambda x: F.concat(F.lit("."), x.cast("string"))), ""), F.lit(",")).alias("p"))
    return parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("v", "p"))), lambda x: x["p"]), "").alias("text"))


def from_string(texts: DataFrame) -> DataFrame:
    """(src, dst, w) of ``to_string``'s text; vertices count from 1."""
    nodes = texts.select(F.posexplode(F.split("text", ",")).alias("k", "part")).where("part <> ''")
    return nodes.select((F.col("k") + 1).cast("long").alias("src"), F.explode(F.split(F.substring("part", 2, 1 << 30), "\\.")).alias("d")).select("src", F.col("d").cast("long").alias("dst"), F.lit(1).alias("w"))


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a whose key is not in b."""
    return a.join(b.select(key), key, "left_anti")


def subgraph(e: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends in ``keep`` (v)."""
    ids = keep.select("v").distinct()
    return e.join(ids.withColumnRenamed("v", "src"), "src", "left_semi").join(ids.withColumnRenamed("v", "dst"), "dst", "left_semi")


def complement(e: DataFrame, v: DataFrame | None = None, most: int = 5000) -> DataFrame:
    """All pairs that are no edge, loops too; every pair is looked at, so refused beyond ``most`` vertices."""
    every = vertices(e) if v is None else v
    n = every.count()
    if n > most:
        raise ValueError(f"{n} vertices are beyond {most} for a complement")
    pairs = every.select(F.col("v").alias("src")).crossJoin(every.select(F.col("v").alias("dst")))
    return pairs.join(e.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("w", F.lit(1))


def line_graph(e: DataFrame) -> DataFrame:
    """The dual: edges are vertices (a, b), joined if they share an end; (a1, b1, a2, b2) in order."""
    pairs = undirected_pairs(e).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("end"))
    other = ends.withColumnsRenamed({"a": "a2", "b": "b2"})
    both = ends.join(other, "end").where("a < a2 OR (a = a2 AND b < b2)")
    return both.select(F.col("a").alias("a1"), F.col("b").alias("b1"), "a2", "b2").distinct()
