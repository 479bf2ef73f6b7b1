"""Breadth-first search, its validation and its communication model.

A search is a loop over levels: the frontier is joined with the edges, what is known already is taken out, and
each new vertex takes its greatest (or least) parent, which makes the tree the same on every run. Whether the
frontier is broadcast or shuffled is left to the optimiser, level by level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.random import order
from knotwork.operators.representation import reverse, vertices
from knotwork.plans.storage import cut

LEVELS = 10_000


def bfs(e: DataFrame, root: int, keep: Column | None = None, parent: str = "max", most_levels: int = LEVELS) -> DataFrame:
    """(v, level, parent) of what the root reaches over edges that ``keep`` accepts; the root is its own parent."""
    steps = cut((e if keep is None else e.where(keep)).where("src <> dst").select("src", "dst").distinct(), "steps")
    choose = F.max if parent == "max" else F.min
    start = e.sparkSession.range(1).select(F.lit(root).cast("long").alias("v"), F.lit(0).alias("level"), F.lit(root).cast("long").alias("parent"))
    front = seen = cut(start, "front")
    for level in range(1, most_levels + 1):
        step = steps.join(front.select(F.col("v").alias("src")), "src").groupBy(F.col("dst").alias("v")).agg(choose("src").alias("parent"))
        front = cut(step.join(seen.select("v"), "v", "left_anti").select("v", F.lit(level).alias("level"), "parent"), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if level % 8 == 0:
            seen = cut(seen, "seen")
    return seen


def bfs_bottom_up(e: DataFrame, root: int, most_levels: int = LEVELS) -> DataFrame:
    """The same tree, by unreached vertices looking for a parent in the frontier."""
    steps = cut(e.where("src <> dst").select("src", "dst").distinct(), "steps")
    front = seen = cut(e.sparkSession.range(1).select(F.lit(root).cast("long").alias("v"), F.lit(0).alias("level"), F.lit(root).cast("long").alias("parent")), "front")
    for level in range(1, most_levels + 1):
        open_edges = steps.join(seen.select(F.col("v").alias("dst")), "dst", "left_anti")
        found = open_edges.join(front.select(F.col("v").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("v")).agg(F.max("src").alias("parent"))
        front = cut(found.select("v", F.lit(level).alias("level"), "parent"), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def go_bottom_up(frontier_edges: int, edges: int, grew: bool) -> bool:
    """When a direction-optimising search turns to looking for parents."""
    return frontier_edges > edges / 20 and grew


def go_top_down(frontier: int, n: int, edges: int, shrank: bool) -> bool:
    return frontier < n * n / (12 * edges) and shrank


def bfs_direction_optimizing(e: DataFrame, root: int, most_levels: int = LEVELS) -> DataFrame:
    """The tree of ``bfs``; a level goes bottom-up while the frontier has more than a twentieth of the edges and
    grows, and top-down again when it is small and shrinks. Two counts a level decide."""
    steps = cut(e.where("src <> dst").select("src", "dst").distinct(), "steps")
    m = steps.count()
    n = vertices(steps).count()
    degree = steps.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("d"))
    front = seen = cut(e.sparkSession.range(1).select(F.lit(root).cast("long").alias("v"), F.lit(0).alias("level"), F.lit(root).cast("long").alias("parent")), "front")
    up, before = False, 1
    for level in range(1, most_levels + 1):
        if up:
            open_edges = steps.join(seen.select(F.col("v").alias("dst")), "dst", "left_anti")
            found = open_edges.join(front.select(F.col("v").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("v")).agg(F.max("src").alias("parent"))
        else:
            step = steps.join(front.select(F.col("v").alias("src")), "src").groupBy(F.col("dst").alias("v")).agg(F.max("src").alias("parent"))
            found = step.join(seen.select("v"), "v", "left_anti")
        front = cut(found.select("v", F.lit(level).alias("level"), "parent"), "front")
        size, edges = front.join(degree, "v", "left").agg(F.count("*"), F.coalesce(F.sum("d"), F.lit(0))).first()
        if not size:
            break
        up = not go_top_down(size, n, m, size < before) if up else go_bottom_up(edges, m, size > before)
        seen, before = seen.unionByName(front), size
    return seen


def kernel_1(edges: DataFrame) -> DataFrame:
    """Graph construction: no loops, both directions, no repeats."""
    e = edges.where("src <> dst AND src >= 0 AND dst >= 0").select("src", "dst")
    return e.unionByName(reverse(e)).distinct()


def level_sets(tree: DataFrame) -> DataFrame:
    return tree.groupBy("level").agg(F.count("*").alias("n"))


def tree_edges(tree: DataFrame) -> DataFrame:
    return tree.where("level > 0").select(F.col("parent").alias("src"), F.col("v").alias("dst"))


def tree_levels(tree: DataFrame, most_doublings: int = 40) -> DataFrame:
    """(v, level) from (v, parent) alone, by pointer doubling; -1 on a cycle, -2 where a path leaves the tree."""
    at = cut(tree.select("v", F.col("parent").alias("up"), F.when(F.col("v") == F.col("parent"), 0).otherwise(1).cast("long").alias("level")), "levels")
    for _ in range(most_doublings):
        far = at.select(F.col("v").alias("up"), F.col("up").alias("up2"), F.col("level").alias("more"))
        new = at.join(far, "up", "left").select("v", F.when(F.col("level") < 0, F.col("up")).otherwise(F.col("up2")).alias("up"), F.when(F.col("level") < 0, F.col("level")).when(F.col("up2").isNull(), -2).when(F.col("more") < 0, F.col("more")).otherwise(F.col("level") + F.col("more")).alias("level"))
        new = cut(new, "levels")
        if new.join(at, ["v", "up", "level"], "left_anti").isEmpty():
            return new.select("v", "level")
        n = at.count()
        at = new
        if new.where(F.col("level") > n).count():
            at = cut(new.select("v", "up", F.when(F.col("level") > n, -1).otherwise(F.col("level")).alias("level")), "levels")
    return at.select("v", "level")


def validate(tree: DataFrame, edges: DataFrame, root: int) -> DataFrame:
    """One row (code, traversed): 0 if the tree (v, parent) is a search tree of ``edges`` from ``root``.

    -999 the root is missing or not its own parent, -16 another vertex is, -1 a cycle, -2 a path that leaves the
    tree, -12 an edge with one end in the tree, -14 levels of an edge's ends more than one apart, -15 a tree edge
    that is no edge. traversed counts the edges with both ends in the tree, loops and repeats too.
    """
    levels = cut(tree_levels(tree), "levels")
    ok_root = tree.agg(F.count_if((F.col("v") == root) & (F.col("parent") == root)).alias("root"), F.count_if((F.col("v") == F.col("parent")) & (F.col("v") != root)).alias("others"))
    walk = levels.agg(F.count_if(F.col("level") == -1).alias("cycles"), F.count_if(F.col("level") == -2).alias("leaving"))
    both = edges.select("src", "dst").join(levels.withColumnsRenamed({"v": "src", "level": "ls"}), "src", "left").join(levels.withColumnsRenamed({"v": "dst", "level": "ld"}), "dst", "left")
    over = both.agg(F.count_if(F.col("ls").isNotNull() & F.col("ld").isNotNull()).alias("traversed"), F.count_if(F.col("ls").isNull() != F.col("ld").isNull()).alias("half"), F.count_if(F.abs(F.col("ls") - F.col("ld")) > 1).alias("jumps"))
    known = edges.select("src", "dst").unionByName(reverse(edges.select("src", "dst"))).distinct()
    made = tree.where("v <> parent").select(F.col("parent").alias("src"), F.col("v").alias("dst")).join(known, ["src", "dst"], "left_anti").agg(F.count("*").alias("made"))
    every = ok_root.crossJoin(walk).crossJoin(over).crossJoin(made)
    code = F.when(F.col("root") != 1, -999).when(F.col("others") > 0, -16).when(F.col("cycles") > 0, -1).when(F.col("leaving") > 0, -2).when(F.col("half") > 0, -12).when(F.col("jumps") > 0, -14).when(F.col("made") > 0, -15).otherwise(0)
    return every.select(code.alias("code"), "traversed")


def depth_by_relaxation(tree: DataFrame, root: int) -> DataFrame:
    """(v, depth) by depth = depth of the parent + 1, round by round."""
    known = cut(tree.where(F.col("v") == root).select("v", F.lit(0).alias("depth")), "depths")
    front = known
    while True:
        step = tree.where("v <> parent").join(front.select(F.col("v").alias("parent"), "depth"), "parent").select("v", (F.col("depth") + 1).alias("depth"))
        front = cut(step.join(known.select("v"), "v", "left_anti"), "depths")
        if front.isEmpty():
            return known
        known = known.unionByName(front)


def parents_in_range(tree: DataFrame, n: int) -> DataFrame:
    return tree.agg(F.count_if((F.col("parent") < -1) | (F.col("parent") >= n)).alias("out_of_range"))


def choose_roots(e: DataFrame, n: int = 64, seed: int = 1) -> DataFrame:
    """(v) of up to n vertices with an edge that is no loop, in a seeded random order."""
    return vertices(e.where("src <> dst")).orderBy(*order(seed, "v")).limit(n)


def traversed_by_degree(tree: DataFrame, e: DataFrame) -> DataFrame:
    """Edges traversed as the sum of the degrees of what was reached."""
    d = e.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("d"))
    return tree.join(d, "v").agg(F.coalesce(F.sum("d"), F.lit(0)).alias("traversed"))


def communication(tree: DataFrame, e: DataFrame, n: int, owners: int, high: int = 60) -> DataFrame:
    """Per level of a search: edges out of it by what they lead to, those that cross owners, and those to vertices
    of more than ``high`` neighbours. The owner of v is floor(v / (n / owners))."""
    size = n / owners
    d = e.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("deg"))
    t = tree.select("v", "level", "parent")
    both = e.select("src", "dst").join(t.select(F.col("v").alias("src"), F.col("level").alias("ls"), F.col("parent").alias("ps")), "src")
    both = both.join(t.select(F.col("v").alias("dst"), F.col("level").alias("ld"), F.col("parent").alias("pd")), "dst").join(d, "dst", "left")
    crosses = F.floor(F.col("src") / size) != F.floor(F.col("dst") / size)
    down = F.col("ld") == F.col("ls") + 1
    child = down & (F.col("pd") == F.col("src"))
    return both.groupBy(F.col("ls").alias("level")).agg(
        F.count_if(child).alias("children"), F.count_if(down & ~child).alias("failed_children"), F.count_if(F.col("ld") == F.col("ls")).alias("peers"),
        F.count_if(F.col("ld") < F.col("ls")).alias("parents"), F.count_if(child & crosses).alias("remote_children"), F.count_if(F.col("deg") > high).alias("high_degree"),
    )


def frontier_history(tree: DataFrame, n: int, owners: int) -> DataFrame:
    """(level, owner, remote): running number of tree edges that arrive at an owner from elsewhere."""
    from pyspark.sql import Window

    size = n / owners
    arrived = tree.where("level > 0").withColumn("owner", F.floor(F.col("v") / size)).where(F.floor(F.col("parent") / size) != F.col("owner"))
    per = arrived.groupBy("owner", "level").agg(F.count("*").alias("k"))
    run = Window.partitionBy("owner").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("level", "owner", F.sum("k").over(run).alias("remote"))


def bfs_order(e: DataFrame, root: int) -> DataFrame:
    """(v, pos): by level, then by the parent's place, then by id; what is not reached comes last."""
    from knotwork.plans.ranking import positions

    tree = cut(bfs(e, root, parent="min"), "tree")
    top = tree.agg(F.max("level")).first()[0]
    placed = positions(tree.where("level = 0"), ["v"]).select("v", "pos")
    done = placed
    steps = e.where("src <> dst").select("src", "dst").distinct()
    for level in range(1, top + 1):
        base = done.count()
        here = tree.where(F.col("level") == level).select(F.col("v").alias("dst"))
        first = steps.join(here, "dst").join(placed.select(F.col("v").alias("src"), "pos"), "src").groupBy(F.col("dst").alias("v")).agg(F.min("pos").alias("p"))
        placed = cut(positions(first, ["p", "v"], "pos", base).select("v", "pos"), "order")
        done = done.unionByName(placed)
    rest = vertices(e).join(done, "v", "left_anti")
    return done.unionByName(positions(rest, ["v"], "pos", done.count()).select("v", "pos"))
