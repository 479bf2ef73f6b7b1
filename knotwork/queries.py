"""The registered graph queries over the test tables, each with the SQL that DuckDB runs beside it.

A query applies one operator to whole tables. Doubles are rounded to six places in both, because the order of
their sums differs between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions import functors, semirings
from knotwork.operators import apps, community, components, experiments, gnn, matrix, metrics, partition, paths, predicates, sequential, spectral, statistics, traversal, vector
from knotwork.operators import generators as gen
from knotwork.operators import representation as rep
from knotwork.plans import views
from knotwork.plans.storage import cut, scratch
from knotwork.plans.views import SQL as G
from knotwork.sources import formats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

GRAPHS = {"g1": views.supplier_part, "g2": views.co_supply, "g0": views.nation_trade, "g3": views.foremost_trade, "g5": views.user_transitions, "g6": views.customer_supplier_lines, "g7": views.co_purchase}
#: Graphs with both ways of each edge: of the nations, of their foremost trade, of the users.
BOTH_WAYS = {"n0": "g0", "n3": "g3", "u5": "g5"}


#: Queries over the nations that have a second one, named _top3, over their foremost trade: that graph is sparse, where the
#: whole one is nearly complete.
SPARSE_TOO = frozenset("strong_components betweenness node_betweenness edge_betweenness shortest_paths all_pairs diameter eccentricity closeness average_path_length distance_distribution smooth_diameter minimum_spanning_tree first_reached_2 kneighbors_2 complement cliques_4 bfs_bottom_up predicates line_graph labelled_subgraphs four_loops eigenvector_centrality independent_loops".split())


def graph(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    e = GRAPHS[BOTH_WAYS.get(name, name)](spark, sf_dir)
    return rep.symmetrized(e) if name in BOTH_WAYS else e


def source(name: str) -> str:
    """The graph as the table ``g`` of a WITH."""
    if name not in BOTH_WAYS:
        return f"g AS ({G[name]})"
    return f"{name} AS (WITH g AS ({G[BOTH_WAYS[name]]}) SELECT src, dst, max(w) AS w FROM (SELECT src, dst, w FROM g UNION ALL SELECT dst, src, w FROM g) GROUP BY 1, 2), g AS (SELECT * FROM {name})"


def add(name: str, over: str, run: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """Register ``run`` over a graph; the SQL may read it as ``g``."""
    if name in SPARSE_TOO:
        add(f"{name}_top3", over.replace("0", "3"), run, sql)
    QUERIES[name] = lambda spark, sf_dir: run(graph(spark, sf_dir, over))
    if sql is not None:
        ORACLE_SQL[name] = f"WITH RECURSIVE {source(over)} {sql}"


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def as_matrix(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("w").alias("val"))


def indices(e: DataFrame, col: str, mod: int, rest: int) -> DataFrame:
    """Positions of the ids of a side that leave ``rest``: (pos, idx) with pos the id's quotient."""
    return e.select(F.col(col).alias("idx")).distinct().where(F.col("idx") % mod == rest).select(F.floor(F.col("idx") / mod).alias("pos"), "idx")


# Representations.

add("degree_in_out", "g5", metrics.in_out_degrees, "SELECT v, CAST(sum(i) AS DOUBLE) AS indeg, CAST(sum(o) AS DOUBLE) AS outdeg FROM (SELECT src AS v, w AS o, 0 AS i FROM g UNION ALL SELECT dst, 0, w FROM g) GROUP BY v")
add("edge_weight_sum", "g6", lambda e: rep.added_weights(rep.weighted(e)), "SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM g GROUP BY 1, 2")
add("symmetrize", "g5", rep.symmetrized, "SELECT src, dst, max(w) AS w FROM (SELECT src, dst, w FROM g UNION ALL SELECT dst, src, w FROM g) GROUP BY 1, 2")
add("missing_reverses", "g5", rep.with_reverses, "SELECT src, dst, w FROM g UNION ALL SELECT dst, src, w FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.src = a.dst AND b.dst = a.src)")
add("simple_graph", "g6", rep.simple_graph, "SELECT DISTINCT src, dst, 1 AS w FROM g WHERE src <> dst")
add("drop_loops", "g6", rep.without_loops, "SELECT src, dst FROM g WHERE src <> dst")
add("dedupe", "g6", lambda e: e.distinct(), "SELECT DISTINCT src, dst FROM g")
add("undirected_pairs", "g5", rep.undirected_pairs, "SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM g WHERE src <> dst")
add("vertices", "g7", rep.vertices, "SELECT src AS v FROM g UNION SELECT dst FROM g")
add("adjacency_lists", "g5", lambda e: rep.adjacency_lists(e).select("v", F.array_join(F.transform("nbrs", lambda x: x.cast("string")), " ").alias("nbrs")), "SELECT v, coalesce(string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst), '') AS nbrs FROM (SELECT src AS v FROM g UNION SELECT dst FROM g) LEFT JOIN (SELECT DISTINCT src, dst FROM g) ON v = src GROUP BY v")
add("edges_of_lists", "g5", lambda e: rep.edges_of_lists(rep.adjacency_lists(e)), "SELECT DISTINCT src, dst, 1 AS w FROM g")
add("compacted_matrix", "g5", rep.matrix_of_edges, ", r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM (SELECT src AS v FROM g UNION SELECT dst FROM g)) SELECT a.k AS row, b.k AS col, w AS val FROM g JOIN r a ON a.v = src JOIN r b ON b.v = dst")
add("incidence", "g0", lambda e: rep.incidence(e.withColumn("w", F.lit(1)), True), ", k AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS edge_id FROM g) SELECT src AS node, edge_id, -1 AS sign FROM k UNION ALL SELECT dst, edge_id, 1 FROM k")
add("edges_of_incidence", "g0", lambda e: rep.edges_of_incidence(rep.incidence(e.withColumn("w", F.lit(1)), True)), "SELECT src, dst, CAST(1 AS DOUBLE) AS w FROM g")
add("graph_text", "n0", lambda e: rep.to_string(rep.adjacency_lists(e)), "SELECT string_agg(p || ',', '' ORDER BY src) AS text FROM (SELECT src, string_agg('.' || CAST(dst AS VARCHAR), '' ORDER BY dst) AS p FROM g GROUP BY src)")
add("graph_text_parsed", "n0", lambda e: rep.from_string(rep.to_string(rep.adjacency_lists(e))), ", k AS (SELECT src, row_number() OVER (ORDER BY src) AS r FROM (SELECT DISTINCT src FROM g)) SELECT r AS src, dst, 1 AS w FROM g JOIN k USING (src)")
add("subgraph_even", "g7", lambda e: rep.subgraph(e, rep.vertices(e).where("v % 2 = 0")), "SELECT src, dst, w FROM g WHERE src % 2 = 0 AND dst % 2 = 0")
add("complement", "n0", rep.complement, ", v AS (SELECT DISTINCT src AS v FROM g) SELECT a.v AS src, b.v AS dst, 1 AS w FROM v a CROSS JOIN v b WHERE NOT EXISTS (SELECT 1 FROM g WHERE src = a.v AND dst = b.v)")
add("line_graph", "n0", rep.line_graph, ", p AS (SELECT DISTINCT src AS a, dst AS b FROM g WHERE src < dst) SELECT x.a AS a1, x.b AS b1, y.a AS a2, y.b AS b2 FROM p x JOIN p y ON (x.a < y.a OR (x.a = y.a AND x.b < y.b)) AND (x.a IN (y.a, y.b) OR x.b IN (y.a, y.b))")

# Predicates and counts.


def _answers(e: DataFrame) -> DataFrame:
    asked = {"directed": predicates.is_directed, "symmetric": predicates.is_symmetric, "simple": predicates.is_simple, "weighted": predicates.is_weighted, "regular": predicates.is_regular, "complete": predicates.is_complete, "eulerian": predicates.is_eulerian, "connected": predicates.is_connected, "tree": predicates.is_tree}
    out = None
    for name, ask in asked.items():
        row = ask(e).select(F.lit(name).alias("question"), "answer")
        out = row if out is None else out.unionByName(row)
    return out


_N = "(SELECT count(*) FROM (SELECT src FROM g UNION SELECT dst FROM g))"
add("predicates", "n0", _answers, f"""
, d AS (SELECT dst, count(*) AS d, sum(w) AS s FROM g GROUP BY dst),
r AS (SELECT min(src) AS v FROM g UNION SELECT g.dst FROM r JOIN g ON g.src = r.v)
SELECT 'directed' AS question, EXISTS (SELECT 1 FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.src = a.dst AND b.dst = a.src AND b.w = a.w)) AS answer
UNION ALL SELECT 'symmetric', NOT EXISTS (SELECT 1 FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.src = a.dst AND b.dst = a.src AND b.w = a.w))
UNION ALL SELECT 'simple', NOT EXISTS (SELECT 1 FROM g WHERE src = dst OR w > 1) UNION ALL SELECT 'weighted', EXISTS (SELECT 1 FROM g WHERE w <> 1)
UNION ALL SELECT 'regular', (SELECT min(d) = max(d) FROM d) UNION ALL SELECT 'complete', (SELECT min(d) = max(d) AND (min(d) = {_N} - 1 OR min(d) = {_N}) FROM d)
UNION ALL SELECT 'eulerian', (SELECT bool_and(s % 2 = 0) FROM d) UNION ALL SELECT 'connected', (SELECT count(*) FROM r) = {_N}
UNION ALL SELECT 'tree', (SELECT count(*) FROM r) = {_N} AND (SELECT sum(w) FROM g) / 2 = {_N} - 1""")
add("num_nodes", "g5", predicates.num_nodes, f"SELECT {_N} AS n")
add("num_edges", "u5", predicates.num_edges, "SELECT CAST(sum(w) / 2 AS DOUBLE) AS m FROM g")
add("self_loops", "g5", predicates.self_loops, "SELECT CAST(coalesce(sum(w) FILTER (WHERE src = dst), 0) AS BIGINT) AS loops FROM g")
add("multi_edges", "g5", predicates.multi_edges, "SELECT count(*) AS n FROM g WHERE w > 1")
add("average_degree", "u5", lambda e: rounded(predicates.average_degree(e), "average_degree"), f"SELECT round(sum(w) / CAST({_N} AS DOUBLE), 6) AS average_degree FROM g")
add("link_density", "u5", lambda e: rounded(predicates.link_density(e), "density"), f"SELECT round(sum(w) / (CAST({_N} AS DOUBLE) * ({_N} - 1)), 6) AS density FROM g")
add("graphic_sequence", "u5", lambda e: predicates.is_graphic(metrics.neighbour_counts(e), "n"), ", d AS (SELECT count(*) AS d FROM g WHERE src <> dst GROUP BY src), k AS (SELECT d, row_number() OVER (ORDER BY d DESC) AS k, sum(d) OVER (ORDER BY d DESC ROWS UNBOUNDED PRECEDING) AS s FROM d) SELECT (SELECT sum(d) % 2 = 0 AND min(d) > 0 FROM d) AND bool_and(s <= k * (k - 1) + coalesce((SELECT sum(least(b.d, a.k)) FROM k b WHERE b.k > a.k), 0)) AS answer FROM k a")

# Degrees and motifs.

_D = ", d AS (SELECT dst AS v, CAST(sum(w) AS DOUBLE) AS deg FROM g GROUP BY dst)"
_T = ", p AS (SELECT DISTINCT src AS a, dst AS b FROM g WHERE src < dst), t AS (SELECT x.a, x.b, y.b AS c FROM p x JOIN p y ON x.b = y.a JOIN p z ON z.a = x.a AND z.b = y.b)"
_K = ", n AS (SELECT src AS v, count(*) AS n FROM (SELECT DISTINCT src, dst FROM g WHERE src <> dst) GROUP BY src)"
add("degrees", "u5", lambda e: metrics.degrees(e, False), f"{_D} SELECT * FROM d")
add("degree_histogram", "g7", lambda e: rounded(metrics.degree_histogram(e), "share"), ", d AS (SELECT count(*) AS deg FROM g GROUP BY src) SELECT deg, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM d) AS DOUBLE), 6) AS share FROM d GROUP BY deg")
add("degree_summary", "g7", lambda e: rounded(metrics.degree_summary(e), "mean", "sd"), "SELECT round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd FROM (SELECT count(*) AS d FROM g GROUP BY src)")
add("average_neighbour_degree", "u5", lambda e: rounded(metrics.average_neighbour_degree(e), "value"), f"{_D} SELECT a.v, round(sum(b.deg) / any_value(a.deg), 6) AS value FROM d a JOIN g ON g.src = a.v JOIN d b ON b.v = g.dst GROUP BY a.v")
add("leaf_nodes", "g5", metrics.leaf_nodes, "SELECT dst AS v FROM g GROUP BY dst HAVING count(*) = 1")
add("leaf_edges", "g5", metrics.leaf_edges, "SELECT src, dst, w FROM g WHERE dst IN (SELECT dst FROM g GROUP BY dst HAVING count(*) = 1)")
add("order_by_max_neighbour", "u5", metrics.order_by_max_neighbour, f"{_D} SELECT v, row_number() OVER (ORDER BY deg, far, v) - 1 AS pos FROM (SELECT a.v, any_value(a.deg) AS deg, max(b.deg) AS far FROM d a JOIN g ON g.src = a.v JOIN d b ON b.v = g.dst GROUP BY a.v)")
add("degree_order", "g7", metrics.order_by_degree, "SELECT src AS v, row_number() OVER (ORDER BY count(*) DESC, src) - 1 AS pos FROM g GROUP BY src")
add("order_by_neighbour_sums", "n0", lambda e: metrics.order_by_neighbour_sums(e, 2), f"{_D}, two AS (SELECT DISTINCT a.src, b.dst FROM g a JOIN g b ON a.dst = b.src) SELECT v, row_number() OVER (ORDER BY deg DESC, s1 DESC, s2 DESC, v) - 1 AS pos FROM (SELECT v, deg, (SELECT sum(b.deg) FROM (SELECT DISTINCT src, dst FROM g) x JOIN d b ON b.v = x.dst WHERE x.src = d.v) AS s1, (SELECT sum(b.deg) FROM two x JOIN d b ON b.v = x.dst WHERE x.src = d.v) AS s2 FROM d)")
add("kneighbors_2", "g0", lambda e: metrics.walk_neighbours(e, 0, 2), "SELECT DISTINCT b.dst AS v FROM g a JOIN g b ON a.dst = b.src WHERE a.src = 0")
add("first_reached_2", "g0", lambda e: metrics.first_reached(e, 0, 2), "SELECT DISTINCT b.dst AS v FROM g a JOIN g b ON a.dst = b.src WHERE a.src = 0 AND b.dst <> 0 AND b.dst NOT IN (SELECT dst FROM g WHERE src = 0)")
add("triangles", "g7", metrics.triangle_count, f"{_T} SELECT count(*) AS triangles FROM t")
add("triangles_per_vertex", "u5", metrics.triangles_per_vertex, f"{_T} SELECT v, count(*) AS t FROM (SELECT a AS v FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY v")
add("four_loops", "n0", metrics.four_loops, ", s AS (SELECT DISTINCT src, dst FROM g WHERE src <> dst) SELECT count(*) AS loops4 FROM (SELECT DISTINCT list_sort([a.dst, b.dst, a.src, c.src]) FROM s a JOIN s b ON a.src = b.src AND a.dst < b.dst JOIN s c ON c.dst = a.dst AND c.src > a.src JOIN s d ON d.src = c.src AND d.dst = b.dst)")
add("triples", "u5", metrics.connected_triples, f"{_T}{_K} SELECT (SELECT CAST(sum(n * (n - 1) / 2) AS DOUBLE) FROM n) - 2 * (SELECT count(*) FROM t) AS triples")
add("star_motifs", "u5", lambda e: metrics.star_motifs(e, 3), f"{_D} SELECT sum(deg * (deg - 1) / 2) AS stars FROM d")
add("clustering", "u5", lambda e: rounded(metrics.clustering(e), "c"), f"{_T}{_K}, k AS (SELECT v, count(*) AS t FROM (SELECT a AS v FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY v) SELECT n.v, round(CASE WHEN n > 1 THEN 2 * coalesce(t, 0) / CAST(n * (n - 1) AS DOUBLE) ELSE 0 END, 6) AS c FROM n LEFT JOIN k ON k.v = n.v")
add("clustering_summary", "u5", lambda e: rounded(metrics.clustering_summary(e), "c1", "c2"), f"{_T}{_K}, k AS (SELECT v, count(*) AS t FROM (SELECT a AS v FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY v) SELECT round((SELECT count(*) FROM t) / ((SELECT CAST(sum(n * (n - 1) / 2) AS DOUBLE) FROM n) - 2 * (SELECT count(*) FROM t)), 6) AS c1, round(avg(CASE WHEN n > 1 THEN 2 * coalesce(t, 0) / CAST(n * (n - 1) AS DOUBLE) ELSE 0 END), 6) AS c2 FROM n LEFT JOIN k ON k.v = n.v")
add("weighted_clustering", "n0", lambda e: rounded(metrics.weighted_clustering(e), "c"), ", s AS (SELECT src AS v, sum(w) AS s, count(*) AS n FROM g GROUP BY src), t AS (SELECT a.src AS v, sum((a.w + b.w) / 2.0) AS t FROM g a JOIN g b ON a.src = b.src AND a.dst <> b.dst JOIN g c ON c.src = a.dst AND c.dst = b.dst GROUP BY a.src) SELECT s.v, round(CASE WHEN n > 1 THEN coalesce(t, 0) / (s * (n - 1.0)) ELSE 0 END, 6) AS c FROM s LEFT JOIN t ON s.v = t.v")
add("assortativity", "u5", lambda e: rounded(metrics.assortativity(e), "r"), f"{_D}, m AS (SELECT sum(deg * deg) / sum(deg) AS xb FROM d) SELECT round((SELECT sum((a.deg - xb) * w * (b.deg - xb)) FROM g JOIN d a ON a.v = src JOIN d b ON b.v = dst, m) / (SELECT sum(deg * (deg - xb) * (deg - xb)) FROM d, m), 6) AS r")
add("s_metric", "u5", metrics.s_metric, f"{_D} SELECT sum(a.deg * b.deg) AS s FROM g JOIN d a ON a.v = src JOIN d b ON b.v = dst")
add("rich_club", "g7", lambda e: rounded(metrics.rich_club(e, 140), "phi"), f"{_D}, r AS (SELECT v FROM d WHERE deg >= 140) SELECT round(CASE WHEN (SELECT count(*) FROM r) > 1 THEN 2 * (SELECT count(*) FROM g WHERE src < dst AND src IN (SELECT v FROM r) AND dst IN (SELECT v FROM r)) / CAST((SELECT count(*) FROM r) * ((SELECT count(*) FROM r) - 1) AS DOUBLE) ELSE 0 END, 6) AS phi")
add("degree_cdf_rank", "g7", lambda e: rounded(metrics.cdf_and_rank(metrics.neighbour_counts(e), "n"), "cdf", "log_rank", "log_x"), f"{_K}, k AS (SELECT CAST(n AS DOUBLE) AS x, count(*) AS n FROM n GROUP BY 1) SELECT x, n, round(sum(n) OVER (ORDER BY x) / (SELECT sum(n) FROM k), 6) AS cdf, round(ln(coalesce(sum(n) OVER (ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1), 6) AS log_rank, round(ln(x), 6) AS log_x FROM k")
add("degree_pdf", "g7", lambda e: rounded(metrics.window_pdf(metrics.neighbour_counts(e), "n", 10), "pdf"), f"{_K}, k AS (SELECT CAST(n AS DOUBLE) AS x, count(*) AS n FROM n GROUP BY 1) SELECT x, round(sum(n) OVER (ORDER BY x RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) / (SELECT sum(n) FROM k), 6) AS pdf FROM k")
add("laplacian", "n0", metrics.laplacian, f"{_D} SELECT src AS row, dst AS col, -w AS val FROM g UNION ALL SELECT v, v, CAST(deg AS BIGINT) FROM d")

# Sparse algebra over suppliers and parts (g1) and users (g5).


def _x(e: DataFrame) -> DataFrame:
    """A vector over the columns: the id mod 7, plus 1."""
    return e.select(F.col("dst").alias("idx")).distinct().withColumn("val", F.col("idx") % 7 + 1)


_X = ", x AS (SELECT DISTINCT dst AS idx, dst % 7 + 1 AS val FROM g)"
add("spmv_plus_times", "g1", lambda e: matrix.times_vector(as_matrix(e), _x(e)), f"{_X} SELECT src AS idx, CAST(sum(w * val) AS BIGINT) AS val FROM g JOIN x ON dst = idx GROUP BY src")
add("spmv_min_plus", "g1", lambda e: matrix.times_vector(as_matrix(e), _x(e), semirings.MIN_PLUS), f"{_X} SELECT src AS idx, min(w + val) AS val FROM g JOIN x ON dst = idx GROUP BY src")
add("spmv_max_select", "g1", lambda e: matrix.times_vector(as_matrix(e), _x(e).where("val > 3"), semirings.MAX_SECOND), f"{_X} SELECT src AS idx, max(val) AS val FROM g JOIN x ON dst = idx WHERE val > 3 GROUP BY src")
add("spmv_filtered", "g1", lambda e: matrix.times_vector(as_matrix(e), _x(e), semirings.PLUS_TIMES.filtered(lambda a: a > 1)), f"{_X} SELECT src AS idx, CAST(sum(w * val) AS BIGINT) AS val FROM g JOIN x ON dst = idx WHERE w > 1 GROUP BY src")
add("spgemm_cosupply", "g1", lambda e: matrix.multiply(as_matrix(e), matrix.transpose(as_matrix(e))), "SELECT a.src AS row, b.src AS col, CAST(sum(a.w * b.w) AS BIGINT) AS val FROM g a JOIN g b ON a.dst = b.dst GROUP BY 1, 2")
add("square", "g0", lambda e: matrix.square(as_matrix(e)), "SELECT a.src AS row, b.dst AS col, CAST(sum(a.w * b.w) AS BIGINT) AS val FROM g a JOIN g b ON a.dst = b.src GROUP BY 1, 2")
add("triple_product", "g0", lambda e: matrix.triple_product(as_matrix(e), as_matrix(e), as_matrix(e), r_transposed=True), "SELECT a.dst AS row, c.dst AS col, CAST(sum(a.w * b.w * c.w) AS BIGINT) AS val FROM g a JOIN g b ON a.src = b.src JOIN g c ON b.dst = c.src GROUP BY 1, 2")
add("boolean_power_4", "g0", lambda e: matrix.powers(as_matrix(e), 4)[-1].select("row", "col"), "SELECT DISTINCT a.src AS row, d.dst AS col FROM g a JOIN g b ON a.dst = b.src JOIN g c ON b.dst = c.src JOIN g d ON c.dst = d.src")
add("transpose", "g1", lambda e: matrix.transpose(as_matrix(e)), "SELECT dst AS row, src AS col, w AS val FROM g")
add("matrix_sum", "g5", lambda e: matrix.add(as_matrix(e), matrix.transpose(as_matrix(e))), "SELECT src AS row, dst AS col, CAST(sum(w) AS BIGINT) AS val FROM (SELECT src, dst, w FROM g UNION ALL SELECT dst, src, w FROM g) GROUP BY 1, 2")

_PAIR = ", v AS (SELECT src, dst, w FROM g), o AS (SELECT dst AS src, src AS dst, w FROM g)"


def _ewise(name: str, sql: str, **switches) -> None:
    add(f"ewise_{name}", "g5", lambda e: matrix.apply_elements(as_matrix(e), matrix.transpose(as_matrix(e)), lambda x, y: x * 10 + y, **switches), f"{_PAIR} {sql}")


_ewise("intersect", "SELECT v.src AS row, v.dst AS col, v.w * 10 + o.w AS val FROM v JOIN o ON v.src = o.src AND v.dst = o.dst")
_ewise("union", "SELECT coalesce(v.src, o.src) AS row, coalesce(v.dst, o.dst) AS col, coalesce(v.w, 0) * 10 + coalesce(o.w, 0) AS val FROM v FULL JOIN o ON v.src = o.src AND v.dst = o.dst", allow_v_nulls=True, allow_w_nulls=True)
_ewise("left", "SELECT v.src AS row, v.dst AS col, v.w * 10 + coalesce(o.w, 0) AS val FROM v LEFT JOIN o ON v.src = o.src AND v.dst = o.dst", allow_w_nulls=True)
_ewise("right", "SELECT o.src AS row, o.dst AS col, coalesce(v.w, 0) * 10 + o.w AS val FROM v RIGHT JOIN o ON v.src = o.src AND v.dst = o.dst", allow_v_nulls=True)
_ewise("antisect", "SELECT coalesce(v.src, o.src) AS row, coalesce(v.dst, o.dst) AS col, coalesce(v.w, 0) * 10 + coalesce(o.w, 0) AS val FROM v FULL JOIN o ON v.src = o.src AND v.dst = o.dst WHERE v.src IS NULL OR o.src IS NULL", allow_v_nulls=True, allow_w_nulls=True, allow_intersect=False)
_ewise("predicate", "SELECT v.src AS row, v.dst AS col, v.w * 10 + o.w AS val FROM v JOIN o ON v.src = o.src AND v.dst = o.dst WHERE v.w > o.w", do=lambda x, y: x > y)
add("elements_times", "g5", lambda e: matrix.times_elements(as_matrix(e), matrix.transpose(as_matrix(e))), f"{_PAIR} SELECT v.src AS row, v.dst AS col, v.w * o.w AS val FROM v JOIN o ON v.src = o.src AND v.dst = o.dst")
add("elements_excluded", "g5", lambda e: matrix.times_elements(as_matrix(e), matrix.transpose(as_matrix(e)), exclude=True), f"{_PAIR} SELECT src AS row, dst AS col, w AS val FROM v WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.src = v.src AND o.dst = v.dst)")
add("apply_unary", "g1", lambda e: rounded(matrix.apply(as_matrix(e), functors.safe_inverse), "val"), "SELECT src AS row, dst AS col, round(1.0 / w, 6) AS val FROM g")
add("prune_values", "g1", lambda e: matrix.prune(as_matrix(e), lambda c: c == 1), "SELECT src AS row, dst AS col, w AS val FROM g WHERE w <> 1")
add("prune_places", "g1", lambda e: matrix.prune_places(as_matrix(e), indices(e, "src", 2, 0), indices(e, "dst", 3, 0)), "SELECT src AS row, dst AS col, w AS val FROM g WHERE NOT (src % 2 = 0 AND dst % 3 = 0)")
add("apply_along_columns", "g1", lambda e: matrix.apply_along(as_matrix(e), _x(e), lambda a, x: a * x, by="col"), f"{_X} SELECT src AS row, dst AS col, w * val AS val FROM g JOIN x ON dst = idx")
add("reduce_rows", "g1", lambda e: matrix.reduce(as_matrix(e), "row"), "SELECT src AS idx, CAST(sum(w) AS BIGINT) AS val FROM g GROUP BY src")
add("reduce_columns_dense", "g0", lambda e: matrix.reduce(as_matrix(e), "col", F.max, size=30, identity=-1), "SELECT i AS idx, coalesce(max(w), -1) AS val FROM range(30) t(i) LEFT JOIN g ON dst = i GROUP BY i")
add("index_submatrix", "g1", lambda e: matrix.index(as_matrix(e), indices(e, "src", 3, 1), indices(e, "dst", 5, 2)), "SELECT src // 3 AS row, dst // 5 AS col, w AS val FROM g WHERE src % 3 = 1 AND dst % 5 = 2")
add("assign_submatrix", "g1", lambda e: matrix.assign(as_matrix(e), indices(e, "src", 3, 1), indices(e, "dst", 5, 2), matrix.index(as_matrix(e), indices(e, "src", 3, 1), indices(e, "dst", 5, 2)).where("val > 1")), "SELECT src AS row, dst AS col, w AS val FROM g WHERE NOT (src % 3 = 1 AND dst % 5 = 2 AND w <= 1)")
add("load_imbalance", "g1", lambda e: rounded(matrix.load_imbalance(as_matrix(e), 8), "imbalance"), "SELECT round(8.0 * max(n) / sum(n), 6) AS imbalance FROM (SELECT count(*) AS n FROM g GROUP BY src % 8)")
add("block_owners", "g1", lambda e: matrix.owners(as_matrix(e), 100, 2000, 4), "SELECT src AS row, dst AS col, w AS val, least(src // 25, 3) AS owner_row, least(dst // 500, 3) AS owner_col, src - least(src // 25, 3) * 25 AS local_row, dst - least(dst // 500, 3) * 500 AS local_col FROM g")
add("rows_as_lists", "g0", lambda e: matrix.lists_as_rows(matrix.rows_as_lists(as_matrix(e))), "SELECT src AS row, dst AS col, w AS val FROM g")
add("densify", "g0", lambda e: matrix.densify(as_matrix(e), 25, 25), "SELECT i AS row, j AS col, coalesce(w, 0) AS val FROM range(25) a(i) CROSS JOIN range(25) b(j) LEFT JOIN g ON src = i AND dst = j")
add("sparsify", "g0", lambda e: matrix.sparsify(matrix.densify(as_matrix(e), 25, 25)), "SELECT src AS row, dst AS col, w AS val FROM g")
add("update_dense", "g0", lambda e: matrix.update_dense(matrix.densify(as_matrix(e), 25, 25), matrix.transpose(as_matrix(e)), lambda d, a: d - a), "SELECT i AS row, j AS col, coalesce(a.w, 0) - coalesce(b.w, 0) AS val FROM range(25) x(i) CROSS JOIN range(25) y(j) LEFT JOIN g a ON a.src = i AND a.dst = j LEFT JOIN g b ON b.src = j AND b.dst = i")
add("expand_symmetry", "g5", lambda e: matrix.expand_symmetry(as_matrix(e.where("src < dst"))), "SELECT src AS row, dst AS col, w AS val FROM g WHERE src < dst UNION ALL SELECT dst, src, w FROM g WHERE src < dst")
add("check_valid", "g5", lambda e: matrix.check_valid(as_matrix(e), 100, 100), "SELECT count(*) AS entries, count(*) FILTER (WHERE src < 0 OR src >= 100 OR dst < 0 OR dst >= 100) AS out_of_range, CAST(0 AS BIGINT) AS repeated FROM g")
add("density_bins", "g1", lambda e: matrix.binned(as_matrix(e), 50), "SELECT src // 50 AS row_bin, dst // 50 AS col_bin, count(*) AS n FROM g GROUP BY 1, 2")

# Vectors: the number of lines of each supplier by id.


def _lines(e: DataFrame) -> DataFrame:
    return e.groupBy(F.col("src").alias("idx")).agg(F.sum("w").alias("val"))


_V = ", v AS (SELECT src AS idx, CAST(sum(w) AS BIGINT) AS val FROM g GROUP BY src)"
add("vector_reduce", "g1", lambda e: vector.reduce(_lines(e), F.max), f"{_V} SELECT max(val) AS val FROM v")
add("vector_count", "g1", lambda e: vector.count(_lines(e), lambda c: c % 2 == 0), f"{_V} SELECT count(*) AS n FROM v WHERE val % 2 = 0")
add("vector_find_indices", "g1", lambda e: vector.find_indices(_lines(e), lambda c: c % 3 == 0), f"{_V} SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, idx AS val FROM v WHERE val % 3 = 0")
add("vector_sorted", "g1", lambda e: vector.sort(_lines(e))[0], f"{_V} SELECT row_number() OVER (ORDER BY val, idx) - 1 AS idx, val FROM v")
add("vector_permutation", "g1", lambda e: vector.sort(_lines(e))[1], f"{_V} SELECT row_number() OVER (ORDER BY val, idx) - 1 AS idx, idx AS val FROM v")
add("vector_gather", "g1", lambda e: vector.gather(_lines(e), indices(e, "src", 4, 1)), f"{_V} SELECT idx // 4 AS idx, val FROM v WHERE idx % 4 = 1")
add("vector_apply_index", "g1", lambda e: vector.apply_index(_lines(e), lambda x, i: x * 1000 + i), f"{_V} SELECT idx, val * 1000 + idx AS val FROM v")
add("vector_masked", "g1", lambda e: vector.apply_masked(_lines(e), lambda x: -x, indices(e, "src", 2, 0)), f"{_V} SELECT idx, CASE WHEN idx % 2 = 0 THEN -val ELSE val END AS val FROM v")
add("vector_update", "g1", lambda e: vector.update(_lines(e), indices(e, "src", 2, 0).select("idx", F.col("pos").alias("val")), lambda a, b: a + b), f"{_V} SELECT idx, CASE WHEN idx % 2 = 0 THEN val + idx // 2 ELSE val END AS val FROM v")
add("vector_set_from", "g1", lambda e: vector.set_from(_lines(e), indices(e, "src", 2, 0).select("idx", F.col("pos").alias("val"))), f"{_V} SELECT idx, CASE WHEN idx % 2 = 0 THEN idx // 2 ELSE val END AS val FROM v")
add("vector_add", "g1", lambda e: vector.subtract(_lines(e), _lines(e.where("dst % 2 = 0"))), "SELECT src AS idx, CAST(coalesce(sum(w) FILTER (WHERE dst % 2 <> 0), 0) AS BIGINT) AS val FROM g GROUP BY src")
add("vector_times_dense", "g1", lambda e: vector.times_dense(_lines(e), indices(e, "src", 1, 0).select("idx", (F.col("idx") % 3).alias("val"))), f"{_V} SELECT idx, val * (idx % 3) AS val FROM v WHERE idx % 3 <> 0")
add("vector_upsert", "g1", lambda e: vector.delete_element(vector.set_element(_lines(e), 5, -1), 6), f"{_V} SELECT idx, val FROM v WHERE idx NOT IN (5, 6) UNION ALL SELECT 5, -1")
add("vector_concatenate", "g1", lambda e: vector.concatenate([_lines(e), _lines(e)], [10_000, 10_000]), f"{_V} SELECT idx, val FROM v UNION ALL SELECT idx + 10000, val FROM v")

# Typed edges.


def _typed(name: str, run: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(views.user_activity(spark, sf_dir))
    ORACLE_SQL[name] = f"WITH g AS ({G['g4']}) {sql}"


_DAY = "2024-01-20 00:00:00"
_typed("prune_by_time", lambda e: e.where(functors.last_by(F.col("count"), F.col("latest"), _DAY)).select("src", "event_type", "count"), f"SELECT src, event_type, count FROM g WHERE count > 0 AND latest <= TIMESTAMP '{_DAY}'")
_typed("filtered_degree", lambda e: e.where(functors.since(F.col("count"), F.col("latest"), _DAY)).groupBy("src").agg(F.count("*").alias("n")), f"SELECT src, count(*) AS n FROM g WHERE count > 0 AND latest >= TIMESTAMP '{_DAY}' GROUP BY src")
_typed("active_within", lambda e: e.where(functors.within(F.col("count"), F.col("latest"), "2024-01-10", _DAY)).agg(F.count("*").alias("n")), f"SELECT count(*) AS n FROM g WHERE count > 0 AND latest BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '{_DAY}'")
_typed("typed_edge_sum", lambda e: e.groupBy("event_type").agg(*functors.add_typed_edges()), "SELECT event_type, CAST(sum(count) AS BIGINT) AS count, bool_or(follower) AS follower, max(latest) FILTER (WHERE count > 0) AS latest FROM g GROUP BY event_type")

# Partitions: the part of a vertex is its id mod 8.


def _last(e: DataFrame) -> int:
    return e.agg(F.max("src")).first()[0]


def _mod8(e: DataFrame) -> DataFrame:
    return partition.by_modulus(rep.vertices(e), 8)


add("cut_hash_k8", "g1", lambda e: rounded(partition.edge_cut(e, _mod8(e), 8), "lambda", "of_random"), "SELECT count(*) AS nnz, count(*) FILTER (WHERE src % 8 <> dst % 8) AS cut, round(count(*) FILTER (WHERE src % 8 <> dst % 8) / CAST(count(*) AS DOUBLE), 6) AS lambda, round(count(*) FILTER (WHERE src % 8 <> dst % 8) / CAST(count(*) AS DOUBLE) / 0.875, 6) AS of_random FROM g")
add("cut_low_degree", "g7", lambda e: rounded(partition.edge_cut(e, _mod8(e), 8, low_degree=120), "lambda", "of_random"), ", d AS (SELECT src AS v FROM g GROUP BY src HAVING count(*) < 120), k AS (SELECT * FROM g WHERE src IN (SELECT v FROM d) AND dst IN (SELECT v FROM d)) SELECT count(*) AS nnz, count(*) FILTER (WHERE src % 8 <> dst % 8) AS cut, round(count(*) FILTER (WHERE src % 8 <> dst % 8) / CAST(count(*) AS DOUBLE), 6) AS lambda, round(count(*) FILTER (WHERE src % 8 <> dst % 8) / CAST(count(*) AS DOUBLE) / 0.875, 6) AS of_random FROM k")
add("cut_per_part", "g7", lambda e: partition.cuts_per_part(e, _mod8(e)), "SELECT CAST(src % 8 AS INTEGER) AS part, count(*) AS nnz, count(*) FILTER (WHERE src % 8 <> dst % 8) AS cut FROM g GROUP BY 1")
add("balance_hash_k8", "g7", lambda e: rounded(partition.balance(_mod8(e), e), "n_balance", "nnz_balance"), "SELECT round(max(n) / CAST(min(n) AS DOUBLE), 6) AS n_balance, round(max(m) / CAST(min(m) AS DOUBLE), 6) AS nnz_balance FROM (SELECT src % 8, count(DISTINCT src) AS n, count(*) AS m FROM g GROUP BY 1)")
add("part_report", "g7", lambda e: rounded(partition.report(e, _mod8(e)), "density", "average_degree"), ", n AS (SELECT CAST(src % 8 AS INTEGER) AS part, count(DISTINCT src) AS n, count(*) FILTER (WHERE src % 8 = dst % 8) AS inside FROM g GROUP BY 1) SELECT part, n, inside, round(inside / CAST(n * n AS DOUBLE), 6) AS density, round(inside / CAST(n AS DOUBLE), 6) AS average_degree FROM n")
add("chunk_cut", "g7", lambda e: rounded(partition.chunk_cut_percent(e, _last(e) + 1, 8), "cut_percent"), ", c AS (SELECT (max(src) + 1) // 8 AS c FROM g) SELECT round(100.0 * count(*) FILTER (WHERE src // c <> dst // c OR src // c >= 8) / count(*), 6) AS cut_percent FROM g, c")
add("chunk_judge", "g7", lambda e: rounded(partition.judge_chunks(e, _last(e) + 1, 8), "balance", "cut"), ", c AS (SELECT (max(src) + 1) // 8 AS c FROM g) SELECT (SELECT round(max(n) / CAST(min(n) AS DOUBLE), 6) FROM (SELECT count(*) AS n FROM g, c GROUP BY least(src // c, 7))) AS balance, round(count(*) FILTER (WHERE src // c <> dst // c OR src // c >= 8) / CAST(count(*) AS DOUBLE), 6) AS cut FROM g, c")
add("chunks", "g7", lambda e: partition.by_chunks(rep.vertices(e), 8), ", v AS (SELECT DISTINCT src AS v FROM g), k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS p FROM v) SELECT v, CAST(p * 8 // (SELECT count(*) FROM v) AS INTEGER) AS part FROM k")
add("round_robin", "g7", lambda e: partition.balanced(rep.vertices(e), 8), ", v AS (SELECT DISTINCT src AS v FROM g) SELECT v, CAST((row_number() OVER (ORDER BY v) - 1) % 8 AS INTEGER) AS part FROM v")
add("part_permutation", "g7", lambda e: partition.permutation(_mod8(e)), ", v AS (SELECT DISTINCT src AS v FROM g) SELECT v, CAST(v % 8 AS INTEGER) AS part, row_number() OVER (ORDER BY v % 8, v) - 1 AS new FROM v")
add("part_ranges", "g7", lambda e: partition.part_ranges(partition.permutation(_mod8(e))), ", v AS (SELECT v, CAST(v % 8 AS INTEGER) AS part, row_number() OVER (ORDER BY v % 8, v) - 1 AS new FROM (SELECT DISTINCT src AS v FROM g)) SELECT part, min(new) AS lo, max(new) AS hi FROM v GROUP BY part")
add("permuted_edges", "g5", lambda e: partition.relabel(e, partition.permutation(_mod8(e))), ", v AS (SELECT v, row_number() OVER (ORDER BY v % 8, v) - 1 AS new FROM (SELECT src AS v FROM g UNION SELECT dst FROM g)) SELECT a.new AS src, b.new AS dst, w FROM g JOIN v a ON a.v = src JOIN v b ON b.v = dst")
add("redistributed", "g1", lambda e: partition.redistribute(e, _mod8(e), 200, 8), ", d AS (SELECT src AS v, count(*) AS deg FROM g GROUP BY src) SELECT src, dst, CAST(CASE WHEN deg >= 200 THEN dst % 8 ELSE src % 8 END AS INTEGER) AS home FROM g JOIN d ON v = src")
add("assignment_counts", "g7", lambda e: partition.counts_of_assignment(rep.vertices(e), _mod8(e).where("part < 6")), "SELECT count(*) AS unassigned, CAST(0 AS BIGINT) AS repeated FROM (SELECT DISTINCT src FROM g) WHERE src % 8 >= 6")
add("fennel_pass", "u5", lambda e: partition.stream_partition(e.drop("w"), 8))
add("fennel_stream_tempered", "u5", lambda e: partition.stream_partition(e.drop("w"), 8, passes=5, rate=1.7, cost="derivative"))
add("ldg", "u5", lambda e: partition.ldg_bisection(e.drop("w")))
add("restream_pass", "g7", lambda e: partition.restreamed(e.drop("w"), 8))
add("label_propagation", "u5", lambda e: partition.label_propagation(e.drop("w"), 8))

# Traversal.

_B = ", m AS (SELECT min(src) AS root FROM g), b AS (SELECT root AS v, 0 AS level FROM m UNION SELECT g.dst, b.level + 1 FROM b JOIN g ON g.src = b.v WHERE b.level < 12), t AS (SELECT v, min(level) AS level FROM b GROUP BY v), p AS (SELECT t.v, t.level, CASE WHEN t.level = 0 THEN t.v ELSE max(g.src) END AS parent FROM t LEFT JOIN g ON g.dst = t.v LEFT JOIN t f ON f.v = g.src WHERE t.level = 0 OR f.level = t.level - 1 GROUP BY t.v, t.level)"


def _tree(e: DataFrame) -> DataFrame:
    return traversal.bfs(e, e.agg(F.min("src")).first()[0])


add("bfs_levels", "u5", lambda e: traversal.level_sets(_tree(e)), f"{_B} SELECT CAST(level AS INTEGER) AS level, count(*) AS n FROM t GROUP BY level")
add("bfs_parents_max", "u5", lambda e: _tree(e), f"{_B} SELECT v, CAST(level AS INTEGER) AS level, parent FROM p")
add("bfs_bottom_up", "g0", lambda e: traversal.bfs_bottom_up(e, 0), f"{_B} SELECT v, CAST(level AS INTEGER) AS level, parent FROM p")
add("bfs_direction_optimizing", "u5", lambda e: traversal.bfs_direction_optimizing(e, e.agg(F.min("src")).first()[0]), f"{_B} SELECT v, CAST(level AS INTEGER) AS level, parent FROM p")
add("bfs_depths", "u5", lambda e: traversal.depth_by_relaxation(_tree(e), e.agg(F.min("src")).first()[0]), f"{_B} SELECT v, CAST(level AS INTEGER) AS depth FROM t")
add("bfs_parents_in_range", "u5", lambda e: traversal.parents_in_range(_tree(e), _last(e) + 1), "SELECT CAST(0 AS BIGINT) AS out_of_range FROM (SELECT 1)")
add("bfs_filtered", "u5", lambda e: traversal.level_sets(traversal.bfs(e, e.agg(F.min("src")).first()[0], F.col("w") > 1)), _B.replace("JOIN g ON g.src = b.v WHERE", "JOIN g ON g.src = b.v WHERE g.w > 1 AND") + " SELECT CAST(level AS INTEGER) AS level, count(*) AS n FROM t GROUP BY level")
add("bfs_tree_levels", "u5", lambda e: traversal.tree_levels(_tree(e).select("v", "parent")), f"{_B} SELECT v, CAST(level AS BIGINT) AS level FROM t")
add("bfs_validation", "u5", lambda e: traversal.validate(_tree(e).select("v", "parent"), e, e.agg(F.min("src")).first()[0]), "SELECT 0 AS code, count(*) AS traversed FROM g")
add("level_comm", "u5", lambda e: traversal.communication(_tree(e), e, _last(e) + 1, 4), f"""{_B}, o AS (SELECT (max(src) + 1) / 4.0 AS c FROM g), d AS (SELECT src AS v, count(*) AS deg FROM g GROUP BY src), x AS (SELECT a.level AS la, b.level AS lb, b.parent = g.src AND b.level = a.level + 1 AS child, b.level = a.level + 1 AS down, floor(g.src / c) <> floor(g.dst / c) AS crosses, deg FROM o, g JOIN p a ON a.v = g.src JOIN p b ON b.v = g.dst JOIN d ON d.v = g.dst)
SELECT CAST(la AS INTEGER) AS level, count(*) FILTER (WHERE child) AS children, count(*) FILTER (WHERE down AND NOT child) AS failed_children, count(*) FILTER (WHERE la = lb) AS peers, count(*) FILTER (WHERE lb < la) AS parents, count(*) FILTER (WHERE child AND crosses) AS remote_children, count(*) FILTER (WHERE deg > 60) AS high_degree FROM x GROUP BY la""")
add("bfs_frontier_history", "u5", lambda e: traversal.frontier_history(_tree(e), _last(e) + 1, 4), f"{_B}, o AS (SELECT (max(src) + 1) / 4.0 AS c FROM g), x AS (SELECT level, CAST(floor(v / c) AS BIGINT) AS owner FROM p, o WHERE level > 0 AND floor(v / c) <> floor(parent / c)) SELECT CAST(level AS INTEGER) AS level, owner, CAST(sum(count(*)) OVER (PARTITION BY owner ORDER BY level) AS BIGINT) AS remote FROM x GROUP BY level, owner")
add("bfs_traversed", "u5", lambda e: traversal.traversed_by_degree(_tree(e), e), "SELECT count(*) AS traversed FROM g")
add("bfs_order", "g0", lambda e: traversal.bfs_order(e, 0))
add("kernel_1", "g6", lambda e: traversal.kernel_1(e), "SELECT src, dst FROM g WHERE src <> dst UNION SELECT dst, src FROM g WHERE src <> dst")
add("components", "g1", components.weak_components, ", u AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), r AS (SELECT DISTINCT src AS v, src AS c FROM u WHERE src = (SELECT min(src) FROM u) UNION SELECT u.dst, r.c FROM r JOIN u ON u.src = r.v) SELECT src AS v, coalesce(min(c), src) AS component FROM (SELECT DISTINCT src FROM u) LEFT JOIN r ON r.v = src GROUP BY src")
add("giant_component", "u5", components.giant_component, ", r AS (SELECT min(src) AS v FROM g UNION SELECT g.dst FROM r JOIN g ON g.src = r.v) SELECT v FROM r")
add("strong_components", "g0", components.strong_components, ", r AS (SELECT src AS a, src AS b FROM g UNION SELECT r.a, g.dst FROM r JOIN g ON g.src = r.b) SELECT x.a AS v, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a UNION SELECT dst, dst FROM g WHERE dst NOT IN (SELECT src FROM g)")

_P = ", s AS (SELECT src, sum(w) AS t FROM g GROUP BY src), m AS (SELECT dst AS r, g.src AS c, w / CAST(t AS DOUBLE) AS p FROM g JOIN s ON s.src = g.src), v AS (SELECT DISTINCT src AS v FROM g), k AS (SELECT count(*) AS n FROM v), x0 AS (SELECT v, 1.0 / CAST(n AS DOUBLE) AS x FROM v, k)"
for _i in range(1, 21):
    _P += f", x{_i} AS (SELECT v.v, 0.85 * coalesce(sum(p * x), 0) + 0.15 / any_value(n) AS x FROM v CROSS JOIN k LEFT JOIN m ON m.r = v.v LEFT JOIN x{_i - 1} ON x{_i - 1}.v = m.c GROUP BY v.v)"
add("pagerank_20", "u5", lambda e: rounded(apps.pagerank(e, rounds=20, tolerance=None), "rank"), f"{_P} SELECT v, round(x, 6) AS rank FROM x20")
add("mis_seeded", "u5", apps.independent_set)
#: Distances d and numbers n of shortest paths between all pairs of the small graph, for its betweenness.
_SP = ", v AS (SELECT src AS v FROM g UNION SELECT dst FROM g), b AS (SELECT v AS s, v, 0 AS d FROM v UNION SELECT b.s, g.dst, b.d + 1 FROM b JOIN g ON g.src = b.v WHERE b.d < 12), t AS (SELECT s, v, min(d) AS d FROM b GROUP BY 1, 2), e AS (SELECT DISTINCT src, dst FROM g WHERE src <> dst)"
_SP += ", sp0 AS (SELECT s, v, 1.0::DOUBLE AS n FROM t WHERE d = 0)" + "".join(f", sp{_i} AS (SELECT t.s, t.v, sum(x.n) AS n FROM t JOIN e ON e.dst = t.v JOIN sp{_i - 1} x ON x.s = t.s AND x.v = e.src WHERE t.d = {_i} GROUP BY 1, 2)" for _i in range(1, 9))
_SP += ", p AS (SELECT t.s, t.v, t.d, q.n FROM t JOIN (" + " UNION ALL ".join(f"SELECT * FROM sp{_i}" for _i in range(9)) + ") q ON q.s = t.s AND q.v = t.v)"
_THROUGH = "SELECT a.v, sum(a.n * b.n / c.n) AS x FROM p a JOIN p b ON a.v = b.s JOIN p c ON c.s = a.s AND c.v = b.v AND c.d = a.d + b.d WHERE a.s <> a.v AND b.v <> a.v GROUP BY a.v"
_PAIRS = "(SELECT CAST(count(*) * (count(*) - 1) AS DOUBLE) FROM v)"
add("betweenness", "n0", lambda e: rounded(apps.betweenness(e), "score"), f"{_SP} SELECT v.v, round(coalesce(x, 0), 6) AS score FROM v LEFT JOIN ({_THROUGH}) h ON h.v = v.v")
add("node_betweenness", "n0", lambda e: rounded(apps.node_betweenness(e), "score"), f"{_SP} SELECT v.v, round(coalesce(x, 0) / {_PAIRS}, 6) AS score FROM v LEFT JOIN ({_THROUGH}) h ON h.v = v.v")
add("edge_betweenness", "n0", lambda e: rounded(apps.edge_betweenness(e), "score"), f"{_SP} SELECT e.src, e.dst, round(sum(a.n * b.n / c.n) / {_PAIRS}, 6) AS score FROM e JOIN p a ON a.v = e.src JOIN p b ON b.s = e.dst JOIN p c ON c.s = a.s AND c.v = b.v AND c.d = a.d + b.d + 1 GROUP BY 1, 2")
add("markov_clusters", "n0", lambda e: rounded(apps.markov_clusters(as_matrix(e).withColumn("val", F.col("val").cast("double")), normalize=True), "val"))
#: The shifted matrix, squared ten times and brought to a greatest entry of 1 each time: its columns are the vector.
_E = ", v AS (SELECT src AS v FROM g UNION SELECT dst FROM g), e0 AS (SELECT i, j, CAST(sum(x) AS DOUBLE) AS x FROM (SELECT src AS i, dst AS j, w AS x FROM g UNION ALL SELECT v, v, 1 FROM v) GROUP BY 1, 2)"
for _i in range(1, 11):
    _E += f", f{_i} AS MATERIALIZED (SELECT a.i, b.j, sum(a.x * b.x) AS x FROM e{_i - 1} a JOIN e{_i - 1} b ON a.j = b.i GROUP BY 1, 2), e{_i} AS MATERIALIZED (SELECT i, j, x / (SELECT max(x) FROM f{_i}) AS x FROM f{_i})"
add("eigenvector_centrality", "n0", lambda e: rounded(apps.eigenvector_centrality(e), "x"), f"{_E}, r AS (SELECT i AS v, sum(x) AS x FROM e10 GROUP BY i) SELECT v, round(x / sqrt((SELECT sum(x * x) FROM r)), 6) AS x FROM r")

# Shortest paths over the nations, an edge as long as 1 + w mod 5.


def _long(e: DataFrame) -> DataFrame:
    return e.withColumn("w", F.col("w") % 5 + 1)


_R = ", e AS (SELECT src, dst, w % 5 + 1 AS w FROM g), q AS (SELECT DISTINCT src AS a, src AS b, 0 AS d, 0 AS k FROM e UNION SELECT q.a, e.dst, q.d + e.w, k + 1 FROM q JOIN e ON e.src = q.b WHERE q.d + e.w <= 24 AND k < 24), ap AS (SELECT a, b, CAST(min(d) AS DOUBLE) AS d FROM q GROUP BY 1, 2)"
_R3 = ", q AS (SELECT DISTINCT src AS a, src AS b, 0 AS d FROM g UNION SELECT q.a, g.dst, q.d + 1 FROM q JOIN g ON g.src = q.b WHERE q.d < 12), ap AS (SELECT a, b, CAST(min(d) AS DOUBLE) AS d FROM q GROUP BY 1, 2), nn AS (SELECT count(DISTINCT src) AS n FROM g), sp AS (SELECT a, CASE WHEN count(*) < any_value(n) THEN 'infinity'::DOUBLE ELSE max(d) END AS far, CASE WHEN count(*) < any_value(n) THEN 'infinity'::DOUBLE ELSE sum(d) END AS total FROM ap, nn GROUP BY a)"
add("shortest_paths", "n0", lambda e: paths.shortest_paths(_long(e), 0).select("v", "dist"), f"{_R} SELECT b AS v, d AS dist FROM ap WHERE a = 0")
add("all_pairs", "n0", lambda e: paths.all_pairs(_long(e)), f"{_R} SELECT * FROM ap")
add("staged_costs_3", "g0", lambda e: paths.staged_costs(_long(e), 0, 3).select("v", "cost"), ", e AS (SELECT src, dst, w % 5 + 1 AS w FROM g), r AS (SELECT CAST(0 AS BIGINT) AS v, 0 AS c, 0 AS k UNION ALL SELECT e.src, r.c + e.w, k + 1 FROM r JOIN e ON e.dst = r.v WHERE k < 3) SELECT v, CAST(min(c) AS DOUBLE) AS cost FROM r GROUP BY v")


def _hops(run: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    def over(e: DataFrame) -> DataFrame:
        e = e.withColumn("w", F.lit(1))
        return run(paths.all_pairs(e), rep.vertices(e))

    return over


add("eccentricity", "n0", _hops(paths.eccentricity), f"{_R3} SELECT a AS v, far AS eccentricity FROM sp")
add("diameter", "n0", _hops(paths.diameter), f"{_R3} SELECT max(far) AS diameter FROM sp")
add("radius", "n0", _hops(paths.radius), f"{_R3} SELECT min(far) AS radius FROM sp")
add("closeness", "n0", lambda e: rounded(_hops(paths.closeness)(e), "closeness"), f"{_R3} SELECT a AS v, round(1 / total, 6) AS closeness FROM sp")
add("average_path_length", "n0", lambda e: rounded(_hops(paths.average_path_length)(e), "average"), f"{_R3} SELECT round(sum(d) / any_value(n * n - n), 6) AS average FROM ap, nn")
add("distance_distribution", "n0", lambda e: rounded(_hops(paths.distance_distribution)(e), "share"), f"{_R3} SELECT CAST(i AS DOUBLE) AS d, round(count(a) / CAST(any_value(n * (n - 1)) AS DOUBLE), 6) AS share FROM nn, range(1, 25) t(i) LEFT JOIN ap ON d = i AND a <> b GROUP BY i")
add("smooth_diameter", "n0", lambda e: rounded(_hops(paths.smooth_diameter)(e), "smooth_diameter"), f"{_SP}, k AS (SELECT d, count(*) / {_PAIRS} AS x FROM t WHERE d > 0 GROUP BY d), u AS (SELECT d, sum(x) OVER (ORDER BY d) AS upto, x FROM k) SELECT round(min(d - (upto - 0.9) / x), 6) AS smooth_diameter FROM u WHERE upto >= 0.9 AND upto - x < 0.9")
add("minimum_spanning_tree", "n0", lambda e: paths.minimum_spanning_tree(_long(e)), ", e AS (SELECT row_number() OVER (ORDER BY w, src, dst) AS k, src, dst, w FROM (SELECT src, dst, w % 5 + 1 AS w FROM g) WHERE src < dst), b AS (SELECT k, src AS v FROM e UNION SELECT b.k, CASE WHEN e.src = b.v THEN e.dst ELSE e.src END FROM b JOIN e ON e.k < b.k AND b.v IN (e.src, e.dst)) SELECT src, dst, w FROM e WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k = e.k AND b.v = e.dst)")
add("top_edges", "g5", lambda e: apps.top_edges(e, 3), "SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS k FROM g) WHERE k <= 3")

# Statistics of the events' values.


def _values(name: str, run: Callable[[DataFrame, str], DataFrame], cols: list[str], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(run(views.table(spark, sf_dir, "events"), "value"), *cols)
    ORACLE_SQL[name] = f"WITH s AS (SELECT value AS x, row_number() OVER (ORDER BY value) - 1 AS k FROM events WHERE value IS NOT NULL), n AS (SELECT count(*) AS n FROM s), a AS (SELECT list(x ORDER BY x) AS x, count(*) AS n FROM s) {sql}"


_Q = ["q1", "median", "q3"]
_values("quartiles_A", statistics.quartiles_pairs, _Q, "SELECT round((x[(n - 1) // 4 + 1] + x[n // 4 + 1]) / 2, 6) AS q1, round((x[(n - 1) // 2 + 1] + x[n // 2 + 1]) / 2, 6) AS median, round((x[n - (n - 1) // 4] + x[n - n // 4]) / 2, 6) AS q3 FROM a")
_values("quartiles_B", statistics.quartiles_interpolated, _Q, "SELECT round(CASE WHEN (n + 1) % 4 = 0 THEN x[(n + 1) // 4 + 1] ELSE 0.75 * x[(n + 1) // 4 + 1] + 0.25 * x[(n + 1) // 4 + 2] END, 6) AS q1, round(CASE WHEN (n + 1) % 2 = 0 THEN x[(n + 1) // 2 + 1] ELSE 0.5 * x[(n + 1) // 2 + 1] + 0.5 * x[(n + 1) // 2 + 2] END, 6) AS median, round(CASE WHEN 3 * (n + 1) % 4 = 0 THEN x[3 * (n + 1) // 4 + 1] ELSE 0.25 * x[3 * (n + 1) // 4 + 1] + 0.75 * x[3 * (n + 1) // 4 + 2] END, 6) AS q3 FROM a")
_values("quartiles_C", statistics.quartiles_means, _Q, "SELECT round((x[n // 4] + x[n // 4 + 1]) / 2, 6) AS q1, round((x[n // 2] + x[n // 2 + 1]) / 2, 6) AS median, round((x[3 * n // 4] + x[3 * n // 4 + 1]) / 2, 6) AS q3 FROM a")
_values("harmonic_stats", statistics.harmonic, ["hmean", "hstd"], ", i AS (SELECT CASE WHEN x <> 0 THEN 1 / x ELSE 0 END AS i FROM s) SELECT round(count(*) / sum(i), 6) AS hmean, round(sqrt(sum(i * i) - sum(i) * sum(i) / count(*)) / (count(*) - 1) * (count(*) / sum(i)) * (count(*) / sum(i)), 6) AS hstd FROM i")
_values("value_summary", statistics.summary, ["mean", "stddev"], "SELECT min(x) AS min, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS stddev, max(x) AS max FROM s")


# Communities and spectra.

add("modularity_mod_8", "g7", lambda e: rounded(community.modularity(e, _mod8(e)), "modularity"), ", x AS (SELECT src % 8 AS m, sum(w) FILTER (WHERE src % 8 = dst % 8) AS i, sum(w) AS o FROM g GROUP BY 1), t AS (SELECT CAST(sum(w) AS DOUBLE) AS t FROM g) SELECT round(sum(i / t - (o / t) * (o / t)), 6) AS modularity FROM x, t")
add("newman_fast", "n0", community.newman_fast)
add("merge_history", "n0", lambda e: rounded(community.merge_history(e), "q"))
add("newman_eigenvector", "n0", community.newman_eigenvector)
add("girvan_newman", "n0", lambda e: community.girvan_newman(e, 3))
add("louvain", "n0", community.louvain)
add("louvain_least_gain", "n0", lambda e: community.louvain(e, take="min"))
add("louvain_rounds", "g7", lambda e: community.louvain_rounds(e, rounds=None))
add("spectral_parts", "n0", lambda e: spectral.spectral_parts(e, k=4))
add("spectrum", "n0", lambda e: rounded(spectral.spectrum(e), "value"))
add("fiedler_vector", "n0", lambda e: rounded(spectral.fiedler_vector(e), "x"))
add("algebraic_connectivity", "n0", lambda e: rounded(spectral.algebraic_connectivity(e), "connectivity"))
add("graph_energy", "n0", lambda e: rounded(spectral.energy(e), "energy"))
add("vertex_similarity", "g0", lambda e: rounded(apps.vertex_similarity(as_matrix(e), as_matrix(e)), "val"))

# Message passing: the out-degree shares of the users, and outputs of the suppliers' lines.

add("mean_aggregation", "u5", lambda e: rounded(gnn.mean_aggregation(e, 0.5), "val"), ", n AS (SELECT src, count(*) AS n FROM g GROUP BY src) SELECT dst AS row, g.src AS col, round(sum(0.5 / n), 6) AS val FROM g JOIN n ON n.src = g.src GROUP BY 1, 2")
add("message_fixpoint", "u5", lambda e: rounded(gnn.fixpoint(gnn.mean_aggregation(e, 0.5), rep.vertices(e).select(F.col("v").alias("idx"), F.lit(1.0).alias("val")), 1e-9), "val"))
add("affine_rounds_3", "u5", lambda e: rounded(apps.affine_rounds(gnn.mean_aggregation(e, 0.5), *[rep.vertices(e).select(F.col("v").alias("idx"), F.lit(1.0).alias("val"))] * 2, 3), "val"), ", n AS (SELECT src, count(*) AS n FROM g GROUP BY src), m AS (SELECT dst AS r, g.src AS c, 0.5 / n AS p FROM g JOIN n ON n.src = g.src), x1 AS (SELECT r, 1 + sum(p) AS x FROM m GROUP BY r), x2 AS (SELECT m.r, 1 + sum(p * x) AS x FROM m JOIN x1 ON x1.r = c GROUP BY m.r), x3 AS (SELECT m.r, 1 + sum(p * x) AS x FROM m JOIN x2 ON x2.r = c GROUP BY m.r) SELECT r AS idx, round(x, 6) AS val FROM x3")


def _outputs(e: DataFrame) -> DataFrame:
    """A made output and target for each edge of the users: w mod 5 less 2, and w mod 3 less 1."""
    return e.select((F.col("src") % 10).alias("graph_id"), (F.col("src") * 1000 + F.col("dst")).alias("node_id"), (F.col("w") % 5 - 2).cast("double").alias("out"), (F.col("w") % 3 - 1).cast("double").alias("target"), F.lit(1.0).alias("mask"))


_O = ", o AS (SELECT src % 10 AS graph_id, src * 1000 + dst AS node_id, CAST(w % 5 - 2 AS DOUBLE) AS x, CAST(w % 3 - 1 AS DOUBLE) AS t FROM g)"
add("squared_error", "u5", lambda e: gnn.squared_error(_outputs(e)), f"{_O} SELECT sum((x - t) * (x - t)) / 2 AS error FROM o")
add("quadratic_error", "u5", lambda e: gnn.quadratic_error(_outputs(e)), f"{_O} SELECT sum(x * x) / 2 AS error FROM o")
add("product_error", "u5", lambda e: gnn.product_error(_outputs(e).withColumn("state", F.lit(0.5))), f"{_O} SELECT sum((x * 0.5 - t) * (x * 0.5 - t)) / 2 AS error FROM o")
add("pair_closeness_error", "n0", lambda e: rounded(gnn.pair_closeness_error(_outputs(e)), "error"), f"{_O} SELECT round(sum(1.0 / ((a.x - b.x) * (a.x - b.x) + 0.001)), 6) AS error FROM o a JOIN o b ON a.graph_id = b.graph_id AND a.node_id < b.node_id")
add("ranking_error", "n0", lambda e: rounded(gnn.ranking_error(_outputs(e), 1.0), "error"), f"{_O} SELECT round(avg(ln(1 + exp(b.x - a.x))), 6) AS error FROM o a JOIN o b ON a.graph_id = b.graph_id AND a.t > b.t")
add("confusion", "u5", lambda e: gnn.confusion(_outputs(e)), f"{_O} SELECT x > 0 AS predicted, t > 0 AS actual, count(*) AS n FROM o GROUP BY 1, 2")
add("accuracy", "u5", lambda e: rounded(gnn.accuracy(_outputs(e)), "accuracy"), f"{_O} SELECT round(avg(CASE WHEN (x > 0) = (t > 0) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM o")
add("within_tolerance", "u5", lambda e: rounded(gnn.within_tolerance(_outputs(e), 1.0), "share"), f"{_O} SELECT round(avg(CASE WHEN abs(x - t) <= 1 THEN 1.0 ELSE 0.0 END), 6) AS share FROM o")
add("graph_accuracy", "u5", lambda e: gnn.graph_accuracy(_outputs(e)), f"{_O} SELECT graph_id, bool_and((x > 0) = (t > 0)) AS correct FROM o GROUP BY graph_id")
add("class_weights", "u5", lambda e: rounded(gnn.class_weights(_outputs(e)).select("node_id", "mask"), "mask"), f"{_O}, k AS (SELECT count(*) FILTER (WHERE t > 0) AS p, count(*) FILTER (WHERE t <= 0) AS q FROM o) SELECT node_id, round(least(p, q) / CAST(CASE WHEN t > 0 THEN p ELSE q END AS DOUBLE), 6) AS mask FROM o, k")
add("normalized_labels", "u5", lambda e: gnn.normalized(_labels(e), _labels(e), 2).select("node_id", *[F.round(F.col("labels")[k], 6).alias(f"l{k}") for k in range(2)]), f"{_O}, k AS (SELECT min(x) AS a, max(x) AS b, min(t) AS c, max(t) AS d FROM o) SELECT node_id, round(2 * (x - a) / (b - a) - 1, 6) AS l0, round(2 * (t - c) / (d - c) - 1, 6) AS l1 FROM o, k")
add("principal_components", "u5", lambda e: gnn.principal_components(_labels(e), _labels(e), 2, 1).select("node_id", F.round(F.col("labels")[0], 6).alias("x")))
add("cliques_4", "n0", lambda e: gnn.cliques(e, 4).select(*[F.col("c")[k].alias(f"v{k}") for k in range(4)]), ", p AS (SELECT DISTINCT src AS a, dst AS b FROM g WHERE src < dst) SELECT x.a AS v0, x.b AS v1, y.b AS v2, z.b AS v3 FROM p x JOIN p y ON y.a = x.b JOIN p z ON z.a = y.b WHERE EXISTS (SELECT 1 FROM p WHERE a = x.a AND b = y.b) AND EXISTS (SELECT 1 FROM p WHERE a = x.a AND b = z.b) AND EXISTS (SELECT 1 FROM p WHERE a = x.b AND b = z.b)")
add("labelled_subgraphs", "g0", lambda e: gnn.labelled_subgraphs(e, rep.vertices(e).select("v", (F.col("v") % 2).alias("label")), [(0, 1), (1, 2)], [0, 1, 0]), "SELECT a.src AS v0, a.dst AS v1, b.dst AS v2 FROM g a JOIN g b ON a.dst = b.src WHERE a.src % 2 = 0 AND a.dst % 2 = 1 AND b.dst % 2 = 0 AND a.src <> b.dst AND NOT EXISTS (SELECT 1 FROM g x WHERE (x.src = a.dst AND x.dst = a.src) OR (x.src = b.dst AND x.dst = a.dst) OR (x.src = a.src AND x.dst = b.dst) OR (x.src = b.dst AND x.dst = a.src))")
add("edge_labels", "g0", lambda e: gnn.edge_labels(e, rep.vertices(e).select(F.col("v").alias("node_id"), F.array((F.col("v") % 3).cast("double")).alias("labels"))).select("src", "dst", F.col("labels")[0].alias("a"), F.col("labels")[1].alias("b")), "SELECT src, dst, CAST(src % 3 AS DOUBLE) AS a, CAST(dst % 3 AS DOUBLE) AS b FROM g")
add("connect_components", "g0", lambda e: gnn.connected(rep.symmetrized(e).where("src % 5 = dst % 5").select("src", "dst"), rep.vertices(e)))


def _labels(e: DataFrame) -> DataFrame:
    return _outputs(e).select("node_id", F.array("out", "target").alias("labels"))


# Generators: each vertex count is that of a table, so that graphs grow with the data.


def _made(name: str, run: Callable[[SparkSession, int], DataFrame], sql: str | None = None, of: str = "supplier") -> None:
    QUERIES[name] = lambda spark, sf_dir: run(spark, views.table(spark, sf_dir, of).count())
    if sql is not None:
        ORACLE_SQL[name] = f"WITH n AS (SELECT count(*) AS n FROM {of}), v AS (SELECT unnest(range(n)) AS v FROM n), h AS ({sql}) SELECT a AS src, b AS dst, 1 AS w FROM h UNION SELECT b, a, 1 FROM h"


_made("net_line", lambda s, n: gen.canonical(s, n, "line"), "SELECT v AS a, v + 1 AS b FROM v, n WHERE v < n - 1")
_made("net_circle", lambda s, n: gen.canonical(s, n, "circle"), "SELECT v AS a, (v + 1) % n AS b FROM v, n")
_made("net_star", lambda s, n: gen.canonical(s, n, "star"), "SELECT CAST(0 AS BIGINT) AS a, v AS b FROM v WHERE v > 0")
_made("net_clique", lambda s, n: gen.canonical(s, n, "clique"), "SELECT x.v AS a, y.v AS b FROM v x JOIN v y ON x.v < y.v")
_made("net_btree", lambda s, n: gen.canonical(s, n, "btree"), "SELECT v AS a, (v - 1) // 2 AS b FROM v WHERE v > 0")
_made("net_tree_3", lambda s, n: gen.canonical(s, n, "tree", 3), "SELECT v AS a, (v - 1) // 3 AS b FROM v WHERE v > 0")
_made("net_htree", lambda s, n: gen.canonical(s, n, "htree"))
_made("net_squares", lambda s, n: gen.canonical(s, n, "sqlattice"), "SELECT v AS a, v + 1 AS b FROM v, n WHERE v % CAST(round(sqrt(n)) AS BIGINT) <> CAST(round(sqrt(n)) AS BIGINT) - 1 AND v + 1 < n UNION ALL SELECT v, v + CAST(round(sqrt(n)) AS BIGINT) FROM v, n WHERE v + CAST(round(sqrt(n)) AS BIGINT) < n")
_made("net_triangles", lambda s, n: gen.canonical(s, n, "trilattice"))
_made("net_hexagons", lambda s, n: gen.canonical(s, n, "hexlattice"))
_made("ring_lattice_4", lambda s, n: gen.ring_lattice(s, n, 4), "SELECT v AS a, (v + 1) % n AS b FROM v, n UNION SELECT v, (v + 2) % n FROM v, n")
_made("kronecker", lambda s, n: gen.kronecker(s, max(1, (n - 1).bit_length())))
_made("rmat", lambda s, n: gen.rmat(s, max(1, (n - 1).bit_length())))
_made("erdos_renyi", lambda s, n: gen.erdos_renyi(s, n, min(1.0, 8 / n)))
_made("erdos_renyi_directed", lambda s, n: gen.erdos_renyi(s, n, min(1.0, 8 / n), directed=True))
_made("random_edges", lambda s, n: gen.random_edges(s, n, 4 * n))
_made("modular_graph", lambda s, n: gen.modular(s, n, 4, min(1.0, 8 / n), 0.9))
_made("nested_hierarchies", lambda s, n: gen.nested_hierarchies(s, n, 3, 2, 6, 0.3))
_made("growth_tree", lambda s, n: gen.growth_tree(s, n))
_made("stub_matching", lambda s, n: gen.stub_matching(gen.drawn_degrees(s, n, "exponential", 4)))
_made("preferential_attachment", lambda s, n: sequential.preferential_attachment(s, n, 2))
_made("price_model", lambda s, n: sequential.price_model(s, n))
_made("master_equation_growth", lambda s, n: sequential.master_equation_growth(s, n, 2, 1.0))
_made("trade_off_tree", lambda s, n: sequential.trade_off_tree(s, n, 4.0))
_made("forest_fire", lambda s, n: sequential.forest_fire(s, n, 0.3, 0.2))
_made("spatial_distribution", lambda s, n: sequential.spatial_distribution(s, n, 0.5))
_made("hierarchy_with_shortcuts", lambda s, n: sequential.hierarchy_with_shortcuts(s, n, 3, n // 4, 2.0, 2.0))
_made("degree_sequence_graph", lambda s, n: sequential.from_degree_sequence(s, [3 if k % 2 else 2 for k in range(n - n % 4)]))
_made("largest_s_graph", lambda s, n: sequential.largest_s_graph(s, [4 if k % 2 else 2 for k in range(n)]))
_made("uniform_regular", lambda s, n: sequential.uniform_regular(s, n, 4))
_made("random_permutation", lambda s, n: vector.random_permutation(s, n, 1))
_made("select_candidates", lambda s, n: vector.select_candidates(s, 64, n, 1))
add("permuted_labels", "g5", lambda e: gen.permuted_labels(e, 1))
add("rewired", "u5", lambda e: sequential.rewired(e, 500))
add("rewired_assortative", "u5", lambda e: sequential.rewired(e, 200, toward=1))
add("rewired_disassortative", "u5", lambda e: sequential.rewired(e, 200, toward=-1))
add("search_roots", "g7", lambda e: traversal.choose_roots(e))
add("hash_parts", "g7", lambda e: partition.by_hash(rep.vertices(e), 8))
add("fennel_bisection", "u5", lambda e: partition.stream_partition(e.drop("w"), 2, gamma=1.5, delta=1.0))
add("fennel_parked_hubs", "u5", lambda e: partition.stream_partition(e.drop("w"), 8, passes=3, cost="derivative", ties="high", cutoff=60))


# Experiments.

add("partition_testbed", "u5", lambda e: rounded(experiments.testbed(e, ks=(2, 8), gammas=(1.5, 2.0), trials=1), "lambda", "balance"))
QUERIES["lambda_sweep_random"] = lambda spark, sf_dir: rounded(experiments.lambda_over_densities(spark, views.table(spark, sf_dir, "supplier").count(), (0.05, 0.1, 0.2), 4), "lambda")
QUERIES["lambda_sweep_kronecker"] = lambda spark, sf_dir: rounded(experiments.lambda_over_factors(spark, max(1, (views.table(spark, sf_dir, "supplier").count() - 1).bit_length()), (4, 8), 4), "lambda")


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = views.table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("t"), F.col("event_type").alias("layer")).agg(F.count("*").alias("value"))
    return rounded(statistics.stacked_layers(days), "low", "high")


QUERIES["stacked_layers"] = _layers
ORACLE_SQL["stacked_layers"] = """WITH d AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS t, event_type AS layer, count(*) AS value FROM events GROUP BY 1, 2),
l AS (SELECT layer, row_number() OVER (ORDER BY layer) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT layer FROM d)),
b AS (SELECT t, -sum((n - k + 1) * value) / CAST(any_value(n) + 1 AS DOUBLE) AS b FROM d JOIN l USING (layer) GROUP BY t)
SELECT t, layer, round(b + sum(value) OVER (PARTITION BY t ORDER BY layer) - value, 6) AS low, round(b + sum(value) OVER (PARTITION BY t ORDER BY layer), 6) AS high FROM d JOIN b USING (t)"""


# Every other operator on matrices, vectors, representations and values, one query each.


def _ones(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.lit(1).alias("val"))


def _said(spark: SparkSession, **answers: bool) -> DataFrame:
    return spark.range(1).select(*(F.lit(x).alias(name) for name, x in answers.items()))


_NO_REVERSE = "NOT EXISTS (SELECT 1 FROM g b WHERE b.src = a.dst AND b.dst = a.src)"
_SPLIT = views.PART_BASE + 500
add("matrix_accumulate", "g0", lambda e: matrix.accumulate(as_matrix(e), as_matrix(e), as_matrix(e)), "SELECT src AS row, dst AS col, CAST(sum(x) AS BIGINT) AS val FROM (SELECT src, dst, w AS x FROM g UNION ALL SELECT a.src, b.dst, a.w * b.w FROM g a JOIN g b ON a.dst = b.src) GROUP BY 1, 2")
add("matrix_accumulate_transposed", "g0", lambda e: matrix.accumulate(as_matrix(e), as_matrix(e), as_matrix(e), b_transposed=True), "SELECT src AS row, dst AS col, CAST(sum(x) AS BIGINT) AS val FROM (SELECT src, dst, w AS x FROM g UNION ALL SELECT a.src, b.src, a.w * b.w FROM g a JOIN g b ON a.dst = b.dst) GROUP BY 1, 2")
add("apply_where_absent", "g5", lambda e: matrix.apply_where_absent(as_matrix(e), matrix.transpose(as_matrix(e)), lambda x, y: x * 10 + y, True, 7), f"SELECT src AS row, dst AS col, w * 10 + 7 AS val FROM g a WHERE {_NO_REVERSE}")
add("apply_where_present", "g5", lambda e: matrix.apply_where_absent(as_matrix(e), matrix.transpose(as_matrix(e)), lambda x, y: x * 10 + y, False), "SELECT a.src AS row, a.dst AS col, a.w * 10 + b.w AS val FROM g a JOIN g b ON b.src = a.dst AND b.dst = a.src")
add("matrix_scale", "g0", lambda e: matrix.scale(as_matrix(e), matrix.densify(matrix.transpose(as_matrix(e)), 25, 25)), "SELECT a.src AS row, a.dst AS col, a.w * coalesce(b.w, 0) AS val FROM g a LEFT JOIN g b ON b.src = a.dst AND b.dst = a.src")
add("matrix_find_places", "g1", lambda e: matrix.find(as_matrix(e), values=False), "SELECT src AS row, dst AS col FROM g")
add("matrix_find", "g1", lambda e: matrix.find(as_matrix(e)), "SELECT src AS row, dst AS col, w AS val FROM g")
add("matrix_sparse", "g6", lambda e: matrix.sparse(_ones(e)), "SELECT src AS row, dst AS col, count(*) AS val FROM g GROUP BY 1, 2")
add("matrix_sparse_scalar", "g6", lambda e: matrix.sparse(_ones(e), F.max, 3), "SELECT DISTINCT src AS row, dst AS col, 3 AS val FROM g")
add("matrix_equal", "g5", lambda e: _said(e.sparkSession, itself=matrix.equal(as_matrix(e), as_matrix(e)), reverse=matrix.equal(as_matrix(e), matrix.transpose(as_matrix(e)))), "SELECT true AS itself, NOT EXISTS (SELECT 1 FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.src = a.dst AND b.dst = a.src AND b.w = a.w)) AS reverse")
add("matrix_without_loops", "g6", lambda e: matrix.without_loops(_ones(e)), "SELECT src AS row, dst AS col, 1 AS val FROM g WHERE src <> dst")
add("matrix_nnz", "g1", lambda e: matrix.nnz(as_matrix(e)), "SELECT count(*) AS nnz FROM g")
add("matrix_cast", "g1", lambda e: matrix.cast(as_matrix(e), "double", "int"), "SELECT CAST(src AS INTEGER) AS row, CAST(dst AS INTEGER) AS col, CAST(w AS DOUBLE) AS val FROM g")
add("matrix_split_right", "g1", lambda e: matrix.split_columns(as_matrix(e), 2 * _SPLIT)[1], f"SELECT src AS row, dst - {_SPLIT} AS col, w AS val FROM g WHERE dst >= {_SPLIT}")
add("matrix_split_merged", "g1", lambda e: matrix.merge_columns(*matrix.split_columns(as_matrix(e), 2 * _SPLIT), _SPLIT), "SELECT src AS row, dst AS col, w AS val FROM g")
add("matrix_merge_max", "g5", lambda e: matrix.merge([as_matrix(e), matrix.transpose(as_matrix(e)), as_matrix(e)], F.max), "SELECT src AS row, dst AS col, max(w) AS val FROM (SELECT src, dst, w FROM g UNION ALL SELECT dst, src, w FROM g) GROUP BY 1, 2")


def _halves(e: DataFrame) -> DataFrame:
    return indices(e, "src", 2, 0).select("idx", F.col("pos").alias("val"))


add("vector_find", "g1", lambda e: vector.find(_lines(e), lambda c: c % 2 == 0), f"{_V} SELECT idx, val FROM v WHERE val % 2 = 0")
add("vector_get", "g1", lambda e: vector.get_element(_lines(e), 5), f"{_V} SELECT max(val) FILTER (WHERE idx = 5) AS val, count(*) FILTER (WHERE idx = 5) > 0 AS found FROM v")
add("vector_get_absent", "g1", lambda e: vector.get_element(_lines(e), -5), f"{_V} SELECT CAST(NULL AS BIGINT) AS val, count(*) FILTER (WHERE idx = -5) > 0 AS found FROM v")
add("vector_apply", "g1", lambda e: vector.apply(_lines(e), lambda c: c * 2 + 1), f"{_V} SELECT idx, val * 2 + 1 AS val FROM v")
add("vector_apply_elements", "g1", lambda e: vector.apply_elements(_lines(e), _halves(e), lambda a, b: a - b, allow_w_nulls=True), f"{_V} SELECT idx, val - CASE WHEN idx % 2 = 0 THEN idx // 2 ELSE 0 END AS val FROM v")
add("vector_apply_common", "g1", lambda e: vector.apply_elements(_lines(e), _halves(e), lambda a, b: a * b, do=lambda a, b: a > b), f"{_V} SELECT idx, val * (idx // 2) AS val FROM v WHERE idx % 2 = 0 AND val > idx // 2")
add("vector_plus", "g1", lambda e: vector.add(_lines(e), _halves(e)), f"{_V} SELECT idx, val + CASE WHEN idx % 2 = 0 THEN idx // 2 ELSE 0 END AS val FROM v")
add("vector_equal", "g1", lambda e: _said(e.sparkSession, itself=vector.equal(_lines(e), _lines(e)), other=vector.equal(_lines(e), vector.set_element(_lines(e), 5, -1))), "SELECT true AS itself, false AS other")
add("vector_value_is_index", "g1", lambda e: vector.value_is_index(_lines(e)), f"{_V} SELECT idx, idx AS val FROM v")
add("vector_nnz", "g1", lambda e: vector.nnz(_lines(e)), f"{_V} SELECT count(*) AS nnz FROM v")
add("vector_empty", "g1", lambda e: vector.nnz(vector.empty(_lines(e))), "SELECT CAST(0 AS BIGINT) AS nnz")
add("vector_bulk_set", "g1", lambda e: vector.bulk_set(e.select(F.col("dst").alias("idx"))), "SELECT DISTINCT dst AS idx, dst AS val FROM g")
QUERIES["vector_iota"] = lambda spark, sf_dir: vector.iota(spark, views.table(spark, sf_dir, "supplier").count(), 3)
ORACLE_SQL["vector_iota"] = "SELECT i AS idx, i + 3 AS val FROM (SELECT unnest(range((SELECT count(*) FROM supplier))) AS i)"

add("matrix_edges", "g5", lambda e: rep.edges_of_matrix(matrix.add(as_matrix(e), matrix.apply(matrix.transpose(as_matrix(e)), lambda c: -c))), "SELECT * FROM (SELECT src, dst, CAST(sum(x) AS BIGINT) AS w FROM (SELECT src, dst, w AS x FROM g UNION ALL SELECT dst, src, -w FROM g) GROUP BY 1, 2) WHERE w > 0")
add("matrix_of_lists", "g5", lambda e: rep.matrix_of_lists(rep.adjacency_lists(e)), "SELECT DISTINCT src AS row, dst AS col, 1 AS val FROM g")
add("simple_edges", "g6", rep.simple_edges, "SELECT src, dst, 1 AS w FROM g WHERE src <> dst")
add("vertices_without_leaves", "g5", lambda e: rep.difference(rep.vertices(e), metrics.leaf_nodes(e), "v"), "SELECT v FROM (SELECT src AS v FROM g UNION SELECT dst FROM g) WHERE v NOT IN (SELECT dst FROM g GROUP BY dst HAVING count(*) = 1)")
_CC = ", r AS (SELECT src AS v, src AS c FROM g UNION SELECT g.dst, r.c FROM r JOIN g ON g.src = r.v), k AS (SELECT v, min(c) AS c FROM r GROUP BY v)"
add("component_count", "n0", components.component_count, f"{_CC} SELECT count(DISTINCT c) AS n FROM k")
add("independent_loops", "n0", lambda e: rep.undirected_pairs(e).agg(F.count("*").alias("m")).crossJoin(rep.vertices(e).agg(F.count("*").alias("v"))).crossJoin(components.component_count(e)).select(metrics.cyclomatic(F.col("m"), F.col("v"), F.col("n")).alias("loops")), f"{_CC} SELECT (SELECT count(*) FROM g WHERE src < dst) - count(*) + count(DISTINCT c) AS loops FROM k")
add("bipartite", "g1", lambda e: predicates.bipartite(e).agg(F.count("*").alias("n"), F.count_if("side").alias("sides"), F.bool_and("proper").alias("proper")), f"SELECT count(*) AS n, count(*) FILTER (WHERE v >= {views.PART_BASE}) AS sides, true AS proper FROM (SELECT src AS v FROM g UNION SELECT dst FROM g)")
add("bipartite_answers", "u5", lambda e: predicates.is_bipartite(e).select(F.lit("all").alias("part"), "answer").unionByName(predicates.is_bipartite(e.where((F.col("src") - F.col("dst")) % 2 != 0)).select(F.lit("odd").alias("part"), "answer")), ", r AS (SELECT min(src) AS v, 0 AS p FROM g UNION SELECT g.dst, 1 - p FROM r JOIN g ON g.src = r.v) SELECT 'all' AS part, NOT EXISTS (SELECT 1 FROM r GROUP BY v HAVING count(*) > 1) AS answer UNION ALL SELECT 'odd', true")


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), "l_linenumber")
    return rep.arrival_lists(lines, "l_linenumber").select("v", F.array_join(F.transform("nbrs", lambda x: x.cast("string")), " ").alias("nbrs"))


QUERIES["arrival_lists"] = _arrivals
ORACLE_SQL["arrival_lists"] = "SELECT l_orderkey AS v, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_linenumber, l_partkey) AS nbrs FROM lineitem GROUP BY 1"

_FUNCTORS: dict[str, tuple[Callable[[], Column], str]] = {
    "constant": (lambda: functors.constant(7), "7"), "identity": (lambda: functors.identity(F.col("w")), "w"), "totality": (lambda: functors.totality(F.col("w")), "true"), "totality_of_two": (lambda: functors.totality(F.col("src"), F.col("dst")), "true"),
    "power": (lambda: functors.exponentiate(F.col("w"), F.lit(2)), "CAST(pow(w, 2) AS DOUBLE)"), "maximum": (lambda: functors.maximum(F.col("src"), F.col("dst")), "greatest(src, dst)"), "minimum": (lambda: functors.minimum(F.col("src"), F.col("dst")), "least(src, dst)"),
    "band": (lambda: functors.bitwise_and(F.col("src"), F.col("dst")), "src & dst"), "bor": (lambda: functors.bitwise_or(F.col("src"), F.col("dst")), "src | dst"), "bxor": (lambda: functors.bitwise_xor(F.col("src"), F.col("dst")), "xor(src, dst)"),
    "lxor": (lambda: functors.logical_xor(F.col("src") % 2 == 0, F.col("dst") % 2 == 0), "(src % 2 = 0) <> (dst % 2 = 0)"), "choice": (lambda: functors.symmetric_choice(F.col("src"), F.col("dst")), "CASE WHEN (src + dst) % 2 = 1 THEN least(src, dst) ELSE greatest(src, dst) END"),
    "kept": (lambda: functors.keep_in_frontier(_parent(), F.when(F.col("dst") % 2 == 0, F.col("dst"))), "src % 3 <> 0 AND dst % 2 <> 0"), "parent_set": (lambda: functors.parent_is_set(_parent()), "src % 3 <> 0"),
    "second_smaller": (lambda: functors.second_is_smaller(F.col("src"), F.col("dst")), "dst < src"), "degree": (lambda: functors.select_degree(_parent(), F.col("w")), "CASE WHEN src % 3 <> 0 THEN w ELSE 0 END"),
}


def _parent() -> Column:
    return F.when(F.col("src") % 3 != 0, F.col("src"))


add("functors", "g5", lambda e: e.select("src", "dst", *(c().alias(name) for name, (c, _) in _FUNCTORS.items())), "SELECT src, dst, " + ", ".join(f"{x} AS {name}" for name, (_, x) in _FUNCTORS.items()) + " FROM g")
_typed("followers", lambda e: e.where(functors.is_follower(F.col("follower"))).select("src", "event_type"), "SELECT src, event_type FROM g WHERE follower")
_typed("active_edges", lambda e: e.where(functors.is_active(F.col("count"))).select("src", "event_type", "count"), "SELECT src, event_type, count FROM g WHERE count > 0")

# What a validator has to say of trees that are none, and of parents that are out of range.


def _broken(e: DataFrame) -> DataFrame:
    e = cut(e, "edges")
    tree = cut(_tree(e).select("v", "parent", "level"), "tree")
    root, last = e.agg(F.min("src")).first()[0], tree.orderBy(F.desc("level"), "v").first()["v"]
    at, up = F.col("v") == last, tree.where(F.col("v") == last).first()["parent"]
    trees = {
        "two roots": tree.withColumn("parent", F.when(at, F.col("v")).otherwise(F.col("parent"))),
        "cycle": tree.withColumn("parent", F.when(at, F.lit(up)).when(F.col("v") == up, F.lit(last)).otherwise(F.col("parent"))),
        "leaving": tree.withColumn("parent", F.when(at, F.lit(-7)).otherwise(F.col("parent"))),
    }
    out = None
    for name, broken in trees.items():
        row = traversal.validate(broken.select("v", "parent"), e, root).select(F.lit(name).alias("tree"), "code")
        out = row if out is None else out.unionByName(row)
    return out


add("bfs_validation_broken", "u5", _broken, "SELECT * FROM (VALUES ('two roots', -16), ('cycle', -1), ('leaving', -2)) t(tree, code)")
add("bfs_parents_beyond_half", "u5", lambda e: traversal.parents_in_range(_tree(e), _last(e) // 2), f"{_B} SELECT count(*) FILTER (WHERE parent >= (SELECT max(src) // 2 FROM g)) AS out_of_range FROM p")

# What holds of seeded results, whatever the seed draws.


def _suppliers(spark: SparkSession, sf_dir: str) -> int:
    return views.table(spark, sf_dir, "supplier").count()


def _held(name: str, run: Callable[[SparkSession, int], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(spark, _suppliers(spark, sf_dir))
    ORACLE_SQL[name] = f"WITH k AS (SELECT count(*) AS n FROM supplier) {sql}"


def _degree_counts(e: DataFrame) -> DataFrame:
    return e.groupBy("src").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("n"))


def _faults(e: DataFrame, n: int) -> DataFrame:
    outside = (F.col("src") < 0) | (F.col("src") >= n) | (F.col("dst") < 0) | (F.col("dst") >= n)
    return e.groupBy("src", "dst").count().agg(F.count_if(F.col("src") == F.col("dst")).alias("loops"), F.count_if(outside).alias("outside"), F.count_if(F.col("count") > 1).alias("repeats"))


def _independent(e: DataFrame) -> DataFrame:
    v = cut(apps.independent_set(e), "independent")
    touched = e.join(v.withColumnRenamed("v", "src"), "src", "left_semi").select(F.col("dst").alias("v")).distinct()
    inside = touched.join(v, "v", "left_semi").agg(F.count("*").alias("inside"))
    return inside.crossJoin(rep.vertices(e).join(v.unionByName(touched), "v", "left_anti").agg(F.count("*").alias("uncovered")))


def _parts_held(parts: DataFrame) -> DataFrame:
    return parts.agg(F.count_distinct("v").alias("n"), F.count_if((F.col("part") < 0) | (F.col("part") > 7)).alias("outside"))


_DEGREES = "SELECT degree, count(*) AS n FROM (SELECT count(*) AS degree FROM g GROUP BY src) GROUP BY degree"
_ALL_PARTS = f"SELECT {_N} AS n, CAST(0 AS BIGINT) AS outside"
_NO_FAULT = "SELECT CAST(0 AS BIGINT) AS loops, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS repeats"
_held("permutation_holds", lambda s, n: vector.random_permutation(s, n, 1).agg(F.count_distinct("idx").alias("places"), F.count_distinct("val").alias("values"), F.max("val").alias("last")), "SELECT n AS places, n AS values, n - 1 AS last FROM k")
_held("erdos_renyi_holds", lambda s, n: _faults(gen.erdos_renyi(s, n, 0.1), n), _NO_FAULT)
_held("modular_graph_holds", lambda s, n: _faults(gen.modular(s, n, 4, 0.1, 0.8), n), _NO_FAULT)
_held("kronecker_holds", lambda s, n: gen.kronecker(s, max(1, (n - 1).bit_length())).agg(F.count("*").alias("edges"), F.max(F.greatest("src", "dst")).alias("last")).select("edges", (F.col("last") * 16 < F.col("edges")).alias("inside")), "SELECT CAST(16 * pow(2, ceil(log2(n))) AS BIGINT) AS edges, true AS inside FROM k")
add("permuted_labels_hold", "g5", lambda e: _degree_counts(gen.permuted_labels(e, 1)), _DEGREES)
add("rewired_holds", "u5", lambda e: _degree_counts(sequential.rewired(e, 500)), _DEGREES)
add("rewired_assortative_holds", "u5", lambda e: _degree_counts(sequential.rewired(e, 200, toward=1)), _DEGREES)
add("mis_holds", "u5", _independent, "SELECT CAST(0 AS BIGINT) AS inside, CAST(0 AS BIGINT) AS uncovered")
add("search_roots_hold", "g7", lambda e: traversal.choose_roots(e).agg(F.count_distinct("v").alias("roots")), f"SELECT least(64, {_N}) AS roots")
add("hash_parts_hold", "g7", lambda e: _parts_held(partition.by_hash(rep.vertices(e), 8)), _ALL_PARTS)
add("fennel_parts_hold", "u5", lambda e: _parts_held(partition.stream_partition(e.drop("w"), 8)), _ALL_PARTS)
add("label_propagation_holds", "u5", lambda e: _parts_held(partition.label_propagation(e.drop("w"), 8)), _ALL_PARTS)
add("markov_columns_hold", "n0", lambda e: apps.markov_clusters(as_matrix(e).withColumn("val", F.col("val").cast("double")), normalize=True).groupBy("col").agg(F.round(F.sum("val"), 2).alias("total")), "SELECT DISTINCT src AS col, CAST(1 AS DOUBLE) AS total FROM g")
add("spectrum_holds", "n0", lambda e: spectral.spectrum(e).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("trace"), F.round(F.abs(F.min("value")), 3).alias("least")), f"SELECT {_N} AS n, CAST(sum(w) AS DOUBLE) AS trace, CAST(0 AS DOUBLE) AS least FROM g")

# Planted graphs: what is planted is found again, in as many graphs as there are suppliers.


def _planted_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = gnn.planted_cliques(spark, views.table(spark, sf_dir, "supplier").count(), 12, 0.2, 5)
    members = nodes.where("target > 0").select("graph_id", F.col("node_id").alias("v"))
    inside = edges.join(members.select(F.col("v").alias("src")), "src", "left_semi").join(members.select(F.col("v").alias("dst")), "dst", "left_semi").groupBy("graph_id").agg(F.count("*").alias("arcs"))
    return members.groupBy("graph_id").agg(F.count("*").alias("members")).join(inside, "graph_id")


def _planted_subgraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern, wanted = [(0, 1), (1, 2), (2, 3), (3, 0)], [5, 6, 5, 7]
    nodes, edges = gnn.planted_subgraphs(spark, views.table(spark, sf_dir, "supplier").count(), 12, 0.2, pattern, wanted)
    labels = nodes.select(F.col("node_id").alias("v"), F.col("labels")[0].alias("label"))
    both = pattern + [(b, a) for a, b in pattern]
    found = gnn.labelled_subgraphs(edges, labels, both, wanted)
    return found.select(F.floor(F.col("v0") / 12).alias("graph_id")).groupBy("graph_id").agg(F.count("*").alias("places"))


QUERIES["planted_cliques"] = _planted_cliques
ORACLE_SQL["planted_cliques"] = "SELECT i AS graph_id, CAST(5 AS BIGINT) AS members, CAST(20 AS BIGINT) AS arcs FROM (SELECT unnest(range((SELECT count(*) FROM supplier))) AS i)"
QUERIES["planted_subgraphs"] = _planted_subgraphs
ORACLE_SQL["planted_subgraphs"] = "SELECT i AS graph_id, CAST(2 AS BIGINT) AS places FROM (SELECT unnest(range((SELECT count(*) FROM supplier))) AS i)"


# Sources and sinks: what is written is read back.


def _stored(name: str, over: str, write: Callable[[DataFrame, str], None], read: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    def round_trip(e: DataFrame) -> DataFrame:
        path = scratch(e.sparkSession, name)
        write(e, path)
        return read(e.sparkSession, path)

    add(name, over, round_trip, sql)


def _from_one(e: DataFrame) -> DataFrame:
    return e.select((F.col("src") + 1).alias("src"), (F.col("dst") + 1).alias("dst"), F.col("w").cast("double").alias("w"))


def _dated(e: DataFrame) -> DataFrame:
    return e.select("src", "dst", (F.col("w") % 2 == 0).alias("follower"), F.col("w").cast("short").alias("count"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("dst")).alias("latest"))


_TRIPLES = "SELECT src AS row, dst AS col, CAST(w AS DOUBLE) AS val FROM g"
_stored("source_matrix_market", "g1", lambda e, p: formats.write_matrix_market(as_matrix(e), p, _last(e), 2 * views.PART_BASE), formats.read_matrix_market, _TRIPLES)
_stored("source_triples", "g5", lambda e, p: formats.write_triples(as_matrix(e), p, _last(e) + 1, _last(e) + 1), lambda s, p: formats.read_triples(s, p)[1], _TRIPLES)
_stored("source_vector", "g1", lambda e, p: formats.write_vector(_lines(e), p, _last(e) + 1), formats.read_vector, f"{_V} SELECT idx, CAST(val AS DOUBLE) AS val FROM v")
_stored("source_snap", "g5", lambda e, p: formats.write_edges(e, p, sep="\t"), formats.read_snap, "SELECT DISTINCT src, dst, 1 AS w FROM g")
_stored("source_metis", "u5", lambda e, p: formats.write_metis(_from_one(e), p, _last(e) + 1), formats.read_metis, "SELECT src + 1 AS src, dst + 1 AS dst, CAST(1 AS DOUBLE) AS w FROM g")
_stored("source_pajek", "u5", lambda e, p: formats.write_pajek(_from_one(e), p, _last(e) + 1), formats.read_pajek, "SELECT src + 1 AS src, dst + 1 AS dst, CAST(w AS DOUBLE) AS w FROM g")
_stored("source_parts", "g7", lambda e, p: formats.write_parts(_mod8(e), p), formats.read_parts, "SELECT DISTINCT src AS v, CAST(src % 8 AS INTEGER) AS part FROM g")
_stored("source_edge_dump_64", "g5", formats.write_edge_dump, formats.read_edge_dump, "SELECT src, dst FROM g")
_stored("source_edge_dump_32", "g5", lambda e, p: formats.write_edge_dump(e, p, 32), lambda s, p: formats.read_edge_dump(s, p, 32), "SELECT src, dst FROM g")
_stored("source_binary_triples", "g5", lambda e, p: formats.write_binary_triples(as_matrix(e), p, _last(e) + 1, _last(e) + 1), formats.read_binary_triples, _TRIPLES)
_stored("source_typed_edge_records", "g5", lambda e, p: formats.write_typed_edge_records(_dated(e), p), formats.read_typed_edge_records, "SELECT src, dst, w % 2 = 0 AS follower, CAST(w AS SMALLINT) AS count, make_timestamp((1700000000 + dst) * 1000000) AS latest FROM g")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut of suppliers and parts over eight parts."""
    return QUERIES["cut_hash_k8"](spark, sf_dir)
