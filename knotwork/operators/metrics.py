"""Degrees, motifs and other measures of graphs with edges (src, dst, w).

Undirected graphs store both directions. Triangles are found on edges turned from the lesser to the greater
degree, which keeps the pairs of a hub's neighbours few.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.functors import choose
from knotwork.operators.representation import reverse, undirected_pairs, vertices, weighted
from knotwork.plans.ranking import positions
from knotwork.plans.storage import cut, scratch
from knotwork.shipping import ship

#: Pairs that a task holds to find triangles among them.
HELD = 6_000_000


def in_out_degrees(e: DataFrame, v: DataFrame | None = None) -> DataFrame:
    """(v, indeg, outdeg) by weight; one pass over the edges."""
    w, none = F.col("w").cast("double"), F.lit(0.0)
    tail, head = F.struct(F.col("src").alias("v"), w.alias("o"), none.alias("i")), F.struct(F.col("dst").alias("v"), none.alias("o"), w.alias("i"))
    ends = weighted(e).select(F.explode(F.array(tail, head)).alias("x")).select("x.*")
    d = ends.groupBy("v").agg(F.sum("i").alias("indeg"), F.sum("o").alias("outdeg"))
    if v is None:
        return d
    return v.join(d, "v", "left").select("v", F.coalesce("indeg", F.lit(0.0)).alias("indeg"), F.coalesce("outdeg", F.lit(0.0)).alias("outdeg"))


def degrees(e: DataFrame, directed: bool, v: DataFrame | None = None) -> DataFrame:
    """(v, deg): in and out if directed, else the sum of a vertex's entries with loops twice."""
    if directed:
        return in_out_degrees(e, v).select("v", (F.col("indeg") + F.col("outdeg")).alias("deg"))
    d = weighted(e).groupBy(F.col("dst").alias("v")).agg((F.sum("w") + F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), F.col("w"))), F.lit(0))).cast("double").alias("deg"))
    every = vertices(e) if v is None else v
    return every.join(d, "v", "left").select("v", F.coalesce("deg", F.lit(0.0)).alias("deg"))


def neighbour_counts(e: DataFrame) -> DataFrame:
    """(v, n): number of different neighbours, of an undirected graph."""
    return e.where("src <> dst").select("src", "dst").distinct().groupBy(F.col("src").alias("v")).agg(F.count("*").alias("n"))


def degree_histogram(e: DataFrame) -> DataFrame:
    """(deg, n, share) of out-degrees by number of entries."""
    d = e.groupBy("src").agg(F.count("*").alias("deg")).groupBy("deg").agg(F.count("*").alias("n"))
    total = d.agg(F.sum("n").alias("total"))
    return d.crossJoin(F.broadcast(total)).select("deg", "n", (F.col("n") / F.col("total")).alias("share"))


def degree_summary(e: DataFrame) -> DataFrame:
    return e.groupBy("src").agg(F.count("*").alias("deg")).agg(F.avg("deg").alias("mean"), F.stddev_samp("deg").alias("sd"))


def average_neighbour_degree(e: DataFrame) -> DataFrame:
    """(v, value): the sum of the neighbours' degrees over the own degree."""
    d = degrees(e, False)
    both = e.join(d.withColumnsRenamed({"v": "dst", "deg": "other"}), "dst").groupBy(F.col("src").alias("v")).agg(F.sum("other").alias("s"))
    return d.join(both, "v", "left").select("v", F.when(F.col("deg") > 0, F.coalesce("s", F.lit(0.0)) / F.col("deg")).otherwise(0.0).alias("value"))


def leaf_nodes(e: DataFrame) -> DataFrame:
    return e.groupBy(F.col("dst").alias("v")).count().where("count = 1").select("v")


def leaf_edges(e: DataFrame) -> DataFrame:
    return e.join(leaf_nodes(e).withColumnRenamed("v", "dst"), "dst", "left_semi").select(*e.columns)


def order_by_degree(e: DataFrame) -> DataFrame:
    """(v, pos): descending by number of entries, then by id."""
    d = e.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("deg"))
    return positions(d, [F.desc("deg"), "v"]).select("v", "pos")


def order_by_max_neighbour(e: DataFrame) -> DataFrame:
    """(v, pos): ascending by degree, then by the greatest degree of a neighbour, then by id."""
    d = degrees(e, False)
    far = e.join(d.withColumnsRenamed({"v": "dst", "deg": "other"}), "dst").groupBy(F.col("src").alias("v")).agg(F.max("other").alias("far"))
    return positions(d.join(far, "v", "left").select("v", "deg", F.coalesce("far", F.lit(0.0)).alias("far")), ["deg", "far", "v"]).select("v", "pos")


def order_by_neighbour_sums(e: DataFrame, hops: int = 3) -> DataFrame:
    """(v, pos): descending by degree, then by the sums of the degrees one, two, ... ``hops`` walk steps away."""
    d = degrees(e, False)
    keyed, pairs = d, vertices(e).select(F.col("v").alias("a"), F.col("v").alias("b"))
    names = ["deg"]
    for k in range(1, hops + 1):
        pairs = pairs.join(e.select(F.col("src").alias("b"), F.col("dst").alias("c")), "b").select("a", F.col("c").alias("b")).distinct()
        s = pairs.join(d.withColumnsRenamed({"v": "b", "deg": "x"}), "b").groupBy(F.col("a").alias("v")).agg(F.sum("x").alias(f"s{k}"))
        keyed = keyed.join(s, "v", "left")
        names.append(f"s{k}")
    key = F.array(*[F.coalesce(F.col(n), F.lit(0.0)) for n in names])
    return positions(keyed.select("v", key.alias("key")), [F.desc("key"), "v"]).select("v", "pos")


def walk_neighbours(e: DataFrame, start: int, k: int) -> DataFrame:
    """(v) at the end of a walk of exactly k steps from ``start``."""
    steps = e.select("src", "dst").distinct()
    at = e.sparkSession.range(1).select(F.lit(start).cast("long").alias("v"))
    for _ in range(k):
        at = at.join(steps, F.col("v") == F.col("src")).select(F.col("dst").alias("v")).distinct()
    return at


def first_reached(e: DataFrame, start: int, k: int) -> DataFrame:
    """(v) reached by a walk of k steps and none shorter, the start left out."""
    seen = e.sparkSession.range(1).select(F.lit(start).cast("long").alias("v"))
    for j in range(1, k):
        seen = seen.unionByName(walk_neighbours(e, start, j))
    return walk_neighbours(e, start, k).join(seen.distinct(), "v", "left_anti")


def triangles(e: DataFrame, held: int = HELD) -> DataFrame:
    """(a, b, c) of every triangle of an undirected graph once.

    Vertices are dealt into classes, and pairs of neighbours into blocks by the classes of their ends, many to a row. For
    any one, two or three classes a task reads the blocks among them from the shared folder, about ``held`` pairs, and
    finds the triangles with corners in each of them. Only the pairs are shuffled: no path of two edges leaves its task.
    """
    spark = e.sparkSession
    ship(spark)
    pairs = cut(e.where("src < dst").select("src", "dst").distinct(), "pairs")
    none = spark.range(0).select(*[F.lit(None).cast(e.schema["src"].dataType).alias(x) for x in "abc"])
    m, schema = pairs.count(), none.schema
    if m <= held // 8:
        return pairs.withColumn("mixed", F.lit(True)).coalesce(1).mapInArrow(corners(), schema)
    k = max(3, math.ceil(math.sqrt(6 * m / held)))
    one, two = (F.pmod(F.xxhash64(x), F.lit(k)).cast("int") for x in ("src", "dst"))
    dealt = pairs.withColumn("block", F.least(one, two) * k + F.greatest(one, two)).coalesce(max(spark.sparkContext.defaultParallelism, m // 4_000_000))
    path, rows = scratch(spark, "blocks"), "pairs binary, block int"
    dealt.mapInArrow(boxed(), rows).write.option("compression", "uncompressed").partitionBy("block").parquet(path)
    blocks = spark.read.schema(rows).parquet(path)
    cells = [c for size in (3, 2, 1) for c in itertools.combinations(range(k), size)]
    # A union of single partitions alone is itself a single partition, one task for all cells; with a range of no rows it is not.
    found = [none]
    for cell in cells:  # a triangle inside one class is found there alone, so that three classes need no pairs inside one
        own = [x * k + y for x in cell for y in cell if x < y or (x == y and len(cell) < 3)]
        found.append(blocks.where(f"block IN ({', '.join(map(str, own))})").coalesce(1).mapInArrow(unboxed(corners(within=len(cell) == 1), k), schema))
    while len(found) > 1:  # by twos, since each union is analysed whole
        found = [functools.reduce(DataFrame.union, found[i : i + 2]) for i in range(0, len(found), 2)]
    return found[0]


def boxed(most: int = 1 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (src, dst, block) to (pairs, block): the pairs of a block among about ``most`` read as one binary value."""

    def box(read: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(read).combine_chunks()
        block = rows.column(2).to_numpy()
        by = np.argsort(block, kind="stable")
        pairs, block = rows.select([0, 1]).take(pa.array(by)).combine_chunks(), block[by]
        starts, values = np.flatnonzero(np.diff(block, prepend=-1)), []
        for lo, hi in zip(starts, [*starts[1:], len(block)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pairs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(pairs.slice(lo, hi - lo))
            values.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), pa.array(block[starts])], names=["pairs", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, n = [], 0
        for x in batches:
            read.append(x)
            n += x.num_rows
            if n >= most:
                yield box(read)
                read, n = [], 0
        if n:
            yield box(read)

    return run


def unboxed(find: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``find`` over rows of ``boxed``; a pair is mixed where its ends are of two of the ``k`` classes."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for value, block in zip(x.column(0), x.column(1).to_pylist()):
                for own in pa.ipc.open_stream(value.as_buffer()):
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(len(own), block % (k + 1) != 0))], names=["src", "dst", "mixed"])

    return lambda batches: find(pairs(batches))


def corners(within: bool = True, marks: int = 1 << 25, paths: int = 1 << 17) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From pairs (src, dst, mixed), each once, to the triangles (a, b, c) among them; without ``within`` only those of
    which a pair is mixed. Pairs are turned to the greater degree; for the vertices of a run, as many as have room in
    ``marks``, the ends are marked, and what lies two steps away is looked up, about ``paths`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [x for x in batches if x.num_rows]
        if not read:
            return
        ends = pa.chunked_array([x.column(i) for i in (0, 1) for x in read])
        mixed = np.concatenate([x.column(2).to_numpy(zero_copy_only=False) for x in read])
        read.clear()
        ids, ends = numbered(ends)
        m, n = len(mixed), len(ids)
        degree = np.bincount(ends, minlength=n)
        by, place = np.argsort(degree, kind="stable"), np.empty(n, np.int32)
        place[by] = np.arange(n, dtype=np.int32)
        ids, ends = ids[by], place[ends]
        b = np.minimum(ends[:m], ends[m:]).astype(np.int64)
        b <<= 31
        b |= np.maximum(ends[:m], ends[m:])
        b <<= 1
        b |= mixed
        del ends
        b.sort()  # by the lesser end, then by the greater; quicker than an order of rows
        a, mixed = b >> 32, (b & 1).astype(bool)
        b &= 0xFFFFFFFF
        b >>= 1
        first = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))])
        own, run_of, lo = np.diff(first), max(1, marks // n), 0
        mark, found = np.zeros(run_of * n, bool), []
        while lo < len(a):
            base = int(a[lo])
            end = int(first[min(base + run_of, n)])
            start, ahead = (a[lo:end] - base) * n, own[b[lo:end]]  # paths over each edge
            upto = np.cumsum(ahead)
            mark[start + b[lo:end]] = True
            i = lo
            while i < end:
                j = min(end, max(i + 1, lo + int(np.searchsorted(upto, upto[i - lo] - ahead[i - lo] + paths, "right"))))
                some = ahead[i - lo : j - lo]
                before = np.cumsum(some) - some
                at = np.repeat(first[b[i:j]] - before, some)
                at += np.arange(len(at))
                hit = np.flatnonzero(mark[np.repeat(start[i - lo : j - lo], some) + b[at]])
                over, at = i + np.searchsorted(before + some, hit, "right"), at[hit]
                if not within:
                    keep = mixed[over] | mixed[at]
                    over, at = over[keep], at[keep]
                found.append((a[over], b[over], b[at]))
                i = j
            mark[start + b[lo:end]] = False
            lo = end
            if lo == len(a) or sum(len(x[0]) for x in found) >= paths or len(found) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(ids[np.concatenate(x)]) for x in zip(*found)], names=["a", "b", "c"])
                found = []

    return run


def numbered(x: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and for each entry the place of its own: by a table where integers lie close together,
    else by a dictionary."""
    if pa.types.is_integer(x.type):
        low, high = pc.min_max(x).as_py().values()
        if high - low < len(x):
            of, there = [c.to_numpy().astype(np.int64, copy=False) for c in x.chunks], np.zeros(high - low + 1, bool)
            for c in of:
                there[c - low] = True
            place, at, i = np.cumsum(there, dtype=np.int32) - np.int32(1), np.empty(len(x), np.int32), 0
            for c in of:
                at[i : i + len(c)] = place[c - low]
                i += len(c)
            return (np.flatnonzero(there) + low).astype(x.type.to_pandas_dtype()), at
    x = x.dictionary_encode()
    by, of = pc.sort_indices(x.chunk(0).dictionary), np.concatenate([c.indices.to_numpy() for c in x.chunks])
    place = np.empty(len(by), np.int32)
    place[by.to_numpy()] = np.arange(len(by), dtype=np.int32)
    return x.chunk(0).dictionary.take(by).to_numpy(zero_copy_only=False), place[of]


def triangle_count(e: DataFrame) -> DataFrame:
    return triangles(e).agg(F.count("*").alias("triangles"))


def triangles_per_vertex(e: DataFrame) -> DataFrame:
    return triangles(e).select(F.explode(F.array("a", "b", "c")).alias("v")).groupBy("v").agg(F.count("*").alias("t"))


def four_loops(e: DataFrame) -> DataFrame:
    """Number of sets of four vertices that hold a cycle of four."""
    steps = e.where("src <> dst").select("src", "dst").distinct()
    via = steps.join(steps.withColumnsRenamed({"dst": "far"}), "src").where("dst < far").select(F.col("dst").alias("p"), F.col("far").alias("q"), F.col("src").alias("m"))
    two = via.join(via.withColumnRenamed("m", "n"), ["p", "q"]).where("m < n")
    return two.select(F.array_sort(F.array("p", "q", "m", "n")).alias("s")).distinct().agg(F.count("*").alias("loops4"))


def connected_triples(e: DataFrame) -> DataFrame:
    """Sum of n(n-1)/2 over the vertices less twice the triangles."""
    pairs = neighbour_counts(e).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("pairs"))
    return pairs.crossJoin(triangle_count(e)).select((F.col("pairs") - 2 * F.col("triangles")).alias("triples"))


def star_motifs(e: DataFrame, k: int) -> DataFrame:
    """Sum of degree over k - 1."""
    return degrees(e, False).agg(F.sum(choose(F.col("deg"), k - 1)).alias("stars"))


def clustering(e: DataFrame) -> DataFrame:
    """(v, c): share of a vertex's pairs of neighbours that are joined; 0 with fewer than two."""
    n, t = neighbour_counts(e), triangles_per_vertex(e)
    both = vertices(e).join(n, "v", "left").join(t, "v", "left")
    return both.select("v", F.when(F.col("n") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("c"))


def clustering_summary(e: DataFrame) -> DataFrame:
    """(c1, c2): triangles over connected triples, and the mean of the vertices' values."""
    c1 = triangle_count(e).crossJoin(connected_triples(e)).select((F.col("triangles") / F.when(F.col("triples") != 0, F.col("triples"))).alias("c1"))
    return c1.crossJoin(clustering(e).agg(F.avg("c").alias("c2")))


def weighted_clustering(e: DataFrame) -> DataFrame:
    """(v, c): over ordered pairs of joined neighbours the mean of the two weights, over strength * (neighbours - 1)."""
    e = weighted(e).where("src <> dst").select("src", "dst", "w")
    s = e.groupBy(F.col("src").alias("v")).agg(F.sum("w").alias("s"), F.count("*").alias("n"))
    own = e.select(F.col("src").alias("v"), F.col("dst").alias("i"), F.col("w").alias("wi"))
    pair = own.join(own.withColumnsRenamed({"i": "j", "wi": "wj"}), "v").where("i <> j")
    closed = pair.join(e.select(F.col("src").alias("i"), F.col("dst").alias("j")), ["i", "j"], "left_semi")
    t = closed.groupBy("v").agg(F.sum((F.col("wi") + F.col("wj")) / 2).alias("t"))
    return vertices(e).join(s, "v", "left").join(t, "v", "left").select("v", F.when(F.col("n") > 1, F.coalesce("t", F.lit(0.0)) / (F.col("s") * (F.col("n") - 1))).otherwise(0.0).alias("c"))


def assortativity(e: DataFrame) -> DataFrame:
    """Degree correlation over stored entries: k column sums, xb = k.k / sum k."""
    k = weighted(e).groupBy(F.col("dst").alias("v")).agg(F.sum("w").alias("k"))
    m = k.agg((F.sum(F.col("k") * F.col("k")) / F.sum("k")).alias("xb"))
    den = k.crossJoin(F.broadcast(m)).agg(F.sum(F.col("k") * (F.col("k") - F.col("xb")) * (F.col("k") - F.col("xb"))).alias("den"))
    both = weighted(e).join(k.withColumnsRenamed({"v": "src", "k": "ks"}), "src").join(k.withColumnsRenamed({"v": "dst", "k": "kd"}), "dst").crossJoin(F.broadcast(m))
    num = both.agg(F.sum((F.col("ks") - F.col("xb")) * F.col("w") * (F.col("kd") - F.col("xb"))).alias("num"))
    return num.crossJoin(den).select((F.col("num") / F.when(F.col("den") != 0, F.col("den"))).alias("r"))


def s_metric(e: DataFrame) -> DataFrame:
    """Sum over stored entries of the two degrees' product."""
    d = degrees(e, False)
    both = e.join(d.withColumnsRenamed({"v": "src", "deg": "ds"}), "src").join(d.withColumnsRenamed({"v": "dst", "deg": "dd"}), "dst")
    return both.agg(F.coalesce(F.sum(F.col("ds") * F.col("dd")), F.lit(0.0)).alias("s"))


def rich_club(e: DataFrame, k: int) -> DataFrame:
    """Density among the vertices of degree k or more; 0 with fewer than two."""
    rich = degrees(e, False).where(F.col("deg") >= k).select("v")
    inside = undirected_pairs(e).join(rich.withColumnRenamed("v", "src"), "src", "left_semi").join(rich.withColumnRenamed("v", "dst"), "dst", "left_semi").agg(F.count("*").alias("m"))
    n = rich.agg(F.count("*").alias("n"))
    return n.crossJoin(inside).select(F.when(F.col("n") > 1, 2 * F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("phi"))


def cdf_and_rank(x: DataFrame, col: str) -> DataFrame:
    """(x, n, cdf, log_rank, log_x) for each different value; ranks from the largest, a value's best one."""
    sizes = x.groupBy(F.col(col).cast("double").alias("x")).agg(F.count("*").alias("n"))
    up, down = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, -1)
    total = sizes.agg(F.sum("n").alias("total"))
    placed = sizes.crossJoin(F.broadcast(total)).withColumn("cdf", F.sum("n").over(up) / F.col("total")).withColumn("rank", F.coalesce(F.sum("n").over(down), F.lit(0)) + 1)
    return placed.select("x", "n", "cdf", F.log("rank").alias("log_rank"), F.when(F.col("x") > 0, F.log("x")).alias("log_x"))


def window_pdf(x: DataFrame, col: str, width: float) -> DataFrame:
    """(x, pdf): share of values within half the width of each different value."""
    sizes = x.groupBy(F.col(col).cast("double").alias("x")).agg(F.count("*").alias("n"))
    half = f"{float(width) / 2}D"
    total = sizes.agg(F.sum("n").alias("total"))
    return sizes.crossJoin(F.broadcast(total)).select("x", (F.expr(f"sum(n) OVER (ORDER BY x RANGE BETWEEN {half} PRECEDING AND {half} FOLLOWING)") / F.col("total")).alias("pdf"))


def cyclomatic(m: Column, n: Column, c: Column) -> Column:
    return m - n + c


def laplacian(e: DataFrame) -> DataFrame:
    """(row, col, val): column sums on the diagonal less the entries."""
    a = weighted(e).select(F.col("src").alias("row"), F.col("dst").alias("col"), (-F.col("w")).alias("val"))
    d = weighted(e).groupBy("dst").agg(F.sum("w").alias("w")).select(F.col("dst").alias("row"), F.col("dst").alias("col"), F.col("w").alias("val"))
    return a.unionByName(d).groupBy("row", "col").agg(F.sum("val").alias("val"))


def both_ways(e: DataFrame) -> DataFrame:
    return e.unionByName(reverse(e))
