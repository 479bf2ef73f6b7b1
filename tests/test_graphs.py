"""Known values on tiny graphs, and agreement of operators with plain versions."""

from __future__ import annotations

import math
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from knotwork.functions.random import binomial
from knotwork.operators import apps, community, components, gnn, metrics, partition, paths, predicates, representation, sequential, spectral, statistics, traversal
from knotwork.operators import generators as gen
from knotwork.plans.storage import cut

BOWTIE = [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6)]


def both(spark, pairs, w=1):
    rows = [(a, b, w) for a, b in pairs] + [(b, a, w) for a, b in pairs if a != b]
    return spark.createDataFrame(rows, "src long, dst long, w int")


@pytest.fixture(scope="module")
def bowtie(spark):
    return both(spark, BOWTIE)


@pytest.fixture(scope="module")
def triangle(spark):
    return both(spark, [(1, 2), (1, 3), (2, 3)])


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def one(df):
    return df.first()[0]


def test_degrees_and_neighbours(bowtie):
    assert by(metrics.degrees(bowtie, False), "v", "deg") == {1: 2, 2: 2, 3: 3, 4: 3, 5: 2, 6: 2}
    near = by(metrics.average_neighbour_degree(bowtie), "v", "value")
    assert near[1] == 2.5 and near[3] == pytest.approx(7 / 3)


def test_motifs(spark, bowtie, triangle):
    assert one(metrics.triangle_count(bowtie)) == 2
    assert one(metrics.star_motifs(bowtie, 3)) == 10 and one(metrics.star_motifs(bowtie, 4)) == 2
    assert one(metrics.s_metric(triangle)) == 24 and one(metrics.s_metric(bowtie)) == 82
    assert metrics.clustering_summary(triangle).first()["c1"] == 1 and metrics.clustering_summary(both(spark, [(1, 2), (1, 3)])).first()["c1"] == 0
    assert one(metrics.four_loops(both(spark, [(1, 2), (2, 3), (3, 4), (4, 1)]))) == 1 and one(metrics.four_loops(bowtie)) == 0
    assert one(metrics.rich_club(both(spark, [(1, 2), (1, 3), (2, 3), (3, 4)]), 2)) == 1


def test_predicates(spark, bowtie, triangle):
    assert one(predicates.is_connected(bowtie)) and not one(predicates.is_connected(both(spark, [e for e in BOWTIE if e != (3, 4)])))
    assert one(predicates.is_regular(triangle)) and one(predicates.is_complete(triangle)) and not one(predicates.is_complete(bowtie))
    assert one(predicates.is_tree(both(spark, [(1, 2), (1, 3)]))) and not one(predicates.is_tree(triangle))
    assert one(predicates.is_eulerian(triangle)) and not one(predicates.is_eulerian(bowtie))
    assert not one(predicates.is_directed(bowtie)) and one(predicates.is_directed(bowtie.where("src < dst")))
    assert one(predicates.num_edges(bowtie)) == 7 and one(predicates.num_nodes(bowtie)) == 6
    seq = lambda *d: spark.createDataFrame([(x,) for x in d], "d int")
    assert one(predicates.is_graphic(seq(2, 2, 3, 3, 2, 2))) and not one(predicates.is_graphic(seq(3, 1))) and not one(predicates.is_graphic(seq(4, 4, 4, 1, 1)))


def test_text_round_trip(triangle):
    text = representation.to_string(representation.adjacency_lists(triangle))
    assert one(text) == ".2.3,.1.3,.1.2,"
    assert {(r["src"], r["dst"]) for r in representation.from_string(text).collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b}


def test_representations(spark, bowtie):
    assert representation.line_graph(bowtie).select("a1", "b1").union(representation.line_graph(bowtie).select("a2", "b2")).distinct().count() == 7
    assert sorted(r["v"] for r in representation.complement(bowtie).where("src = 1").select(F.col("dst").alias("v")).collect()) == [1, 4, 5, 6]
    e = spark.createDataFrame([(1, 2, 2), (2, 3, 1), (3, 3, 1)], "src long, dst long, w int")
    back = representation.edges_of_incidence(representation.incidence(e.where("src <> dst"), True))
    assert {tuple(r) for r in back.collect()} == {(1, 2, 2.0), (2, 3, 1.0)}


def test_paths(spark, bowtie):
    d = by(paths.shortest_paths(bowtie, 1), "v", "dist")
    assert d == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3, 6: 3}
    assert paths.path_to(paths.shortest_paths(bowtie, 1), 5) == [1, 3, 4, 5]
    square = spark.createDataFrame([(1, 2, 3.5), (2, 1, 3.5), (1, 4, 1.0), (4, 1, 1.0), (2, 3, 1.0), (3, 2, 1.0), (3, 4, 1.4), (4, 3, 1.4)], "src long, dst long, w double")
    assert by(paths.shortest_paths(square, 1), "v", "dist") == pytest.approx({1: 0, 2: 3.4, 3: 2.4, 4: 1})
    assert set(by(paths.shortest_paths(spark.createDataFrame([(1, 2, 1), (1, 3, 1)], "src long, dst long, w int"), 2), "v", "dist")) == {2}


def test_all_pairs_measures(bowtie):
    pairs, v = paths.all_pairs(bowtie), representation.vertices(bowtie)
    assert one(paths.diameter(pairs, v)) == 3 and one(paths.radius(pairs, v)) == 2
    assert by(paths.eccentricity(pairs, v), "v", "eccentricity") == {1: 3, 2: 3, 3: 2, 4: 2, 5: 3, 6: 3}
    assert by(paths.closeness(pairs, v), "v", "closeness") == pytest.approx({1: 0.1, 2: 0.1, 3: 1 / 7, 4: 1 / 7, 5: 0.1, 6: 0.1})
    assert by(paths.distance_distribution(pairs, v), "d", "share") == pytest.approx({1: 7 / 15, 2: 4 / 15, 3: 4 / 15, 4: 0, 5: 0})


def test_spanning_tree(spark):
    e = spark.createDataFrame([(1, 2, 1), (2, 3, 2), (1, 3, 3), (3, 4, 1), (2, 4, 5), (5, 6, 1)], "src long, dst long, w int")
    assert sorted(tuple(r) for r in paths.minimum_spanning_tree(e).collect()) == [(1, 2, 1), (2, 3, 2), (3, 4, 1), (5, 6, 1)]


def test_centrality(bowtie):
    score = by(apps.betweenness(bowtie), "v", "score")
    assert score == pytest.approx({1: 0, 2: 0, 3: 12, 4: 12, 5: 0, 6: 0})
    edges = {(r["src"], r["dst"]): r["score"] for r in apps.edge_betweenness(bowtie).collect()}
    assert edges[1, 2] == pytest.approx(1 / 30) and edges[1, 3] == pytest.approx(4 / 30) and edges[3, 4] == pytest.approx(9 / 30)
    a = np.zeros((6, 6))
    for x, y in BOWTIE:
        a[x - 1, y - 1] = a[y - 1, x - 1] = 1
    vector = np.abs(np.linalg.eigh(a)[1][:, -1])
    assert by(apps.eigenvector_centrality(bowtie), "v", "x") == pytest.approx({k + 1: x for k, x in enumerate(vector)}, abs=1e-6)


def test_components(spark, bowtie):
    cut = both(spark, [e for e in BOWTIE if e != (3, 4)])
    assert by(components.weak_components(cut), "v", "component") == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    line = both(spark, [(k, k + 1) for k in range(60)])
    assert set(by(components.weak_components(line), "v", "component").values()) == {0}
    d = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 5)], "src long, dst long")
    assert by(components.strong_components(d), "v", "component") == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_search_and_validation(spark, bowtie):
    tree = traversal.bfs(bowtie, 1)
    assert {(r["v"], r["level"], r["parent"]) for r in tree.collect()} == {(1, 0, 1), (2, 1, 1), (3, 1, 1), (4, 2, 3), (5, 3, 4), (6, 3, 4)}
    assert {tuple(r) for r in traversal.bfs_bottom_up(bowtie, 1).collect()} == {tuple(r) for r in tree.collect()}
    good = tree.select("v", "parent")
    assert tuple(traversal.validate(good, bowtie, 1).first()) == (0, 14)

    def code(**to):
        return traversal.validate(good.select("v", F.coalesce(*[F.when(F.col("v") == int(k[1:]), p) for k, p in to.items()], "parent").cast("long").alias("parent")), bowtie, 1).first()["code"]

    assert code(v1=2) == -999 and code(v2=2) == -16 and code(v5=6, v6=5) == -1 and code(v6=9) == -2 and code(v5=3) == -15 and code(v5=1) == -14
    assert traversal.validate(good.where("v < 5"), bowtie, 1).first()["code"] == -12
    assert [r["v"] for r in traversal.bfs_order(bowtie, 4).orderBy("pos").collect()] == [4, 3, 5, 6, 1, 2]


def test_independent_set(spark):
    e = gen.erdos_renyi(spark, 60, 0.1, seed=3)
    chosen = {r["v"] for r in apps.independent_set(e, v=spark.range(60).withColumnRenamed("id", "v")).collect()}
    pairs = {(r["src"], r["dst"]) for r in e.collect()}
    assert not any((a, b) in pairs for a in chosen for b in chosen)
    assert all(v in chosen or any((v, u) in pairs for u in chosen) for v in range(60))


def test_communities(bowtie):
    halves = {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1}

    def same(parts):
        got = by(parts, "v", "part")
        return all((got[a] == got[b]) == (halves[a] == halves[b]) for a in halves for b in halves)

    assert same(community.girvan_newman(bowtie, 2)) and same(community.newman_fast(bowtie)) and same(community.newman_eigenvector(bowtie))
    assert same(community.louvain(bowtie)) and same(spectral.spectral_parts(bowtie)) and same(spectral.spectral_parts(bowtie, k=2))
    q = one(community.modularity(bowtie, bowtie.sparkSession.createDataFrame(list(halves.items()), "v long, part int")))
    assert q == pytest.approx(6 / 7 - 0.5)
    assert community.louvain_rounds(bowtie).count() == 6


def test_spectra(triangle, bowtie):
    assert [round(r["value"], 9) for r in spectral.spectrum(triangle).orderBy("k").collect()] == [3, 3, 0]
    assert one(spectral.algebraic_connectivity(bowtie)) == pytest.approx(np.sort(np.linalg.eigvalsh(_lap(BOWTIE)))[1])
    assert one(spectral.energy(triangle)) == pytest.approx(4)


def _lap(pairs):
    a = np.zeros((6, 6))
    for x, y in pairs:
        a[x - 1, y - 1] = a[y - 1, x - 1] = 1
    return np.diag(a.sum(0)) - a


def test_generators(spark):
    e = gen.kronecker(spark, 8, 4, seed=5)
    assert e.count() == 1024 and e.agg(F.max(F.greatest("src", "dst"))).first()[0] < 256
    assert sorted(map(tuple, e.collect())) == sorted(map(tuple, gen.kronecker(spark.newSession(), 8, 4, seed=5).repartition(3).collect()))
    assert gen.rmat(spark, 7, 4).count() == 512
    ids = spark.range(256).select(gen.scrambled(F.col("id"), 8, 3).alias("x"))
    assert ids.distinct().count() == 256 and ids.agg(F.min("x"), F.max("x")).first()[:] == (0, 255)
    sizes = {"line": 5, "circle": 6, "star": 5, "clique": 15, "btree": 5, "tree": 5, "htree": 8}
    for kind, m in sizes.items():
        assert gen.canonical(spark, 6, kind).count() == 2 * m, kind
    assert gen.canonical(spark, 9, "sqlattice").count() == 24 and gen.canonical(spark, 9, "trilattice").count() == 32
    ring = gen.ring_lattice(spark, 10, 3)
    assert set(by(ring.groupBy("src").count(), "src", "count").values()) == {3}
    assert gen.random_edges(spark, 20, 30).count() == 60
    assert gen.stub_matching(gen.drawn_degrees(spark, 50, "uniform", 4)).count() > 0
    assert gen.modular(spark, 40, 4, 0.2, 0.9).count() > 0 and gen.nested_hierarchies(spark, 32, 2, 2, 4, 0.3).count() > 0
    assert one(predicates.is_tree(gen.growth_tree(spark, 20)))


def test_sequential_models(spark):
    assert sequential.preferential_attachment(spark, 30, 2).count() == 2 * (3 + 27 * 2)
    assert sequential.price_model(spark, 30).count() == 29
    for made in (sequential.trade_off_tree(spark, 25, 4.0), sequential.spatial_distribution(spark, 25, 0.5)):
        assert one(predicates.is_tree(made))
    assert sequential.master_equation_growth(spark, 20, 2, 1.0).count() == 37
    assert sequential.forest_fire(spark, 30, 0.3, 0.2).count() >= 29
    assert sequential.hierarchy_with_shortcuts(spark, 20, 3, 5, 2.0, 2.0).count() >= 38
    d = by(metrics.neighbour_counts(sequential.from_degree_sequence(spark, [3, 3, 2, 2, 2, 2])), "v", "n")
    assert [d[k] for k in range(6)] == [3, 3, 2, 2, 2, 2]
    assert sorted(by(metrics.neighbour_counts(sequential.largest_s_graph(spark, [3, 3, 2, 2, 2, 2])), "v", "n").values()) == [2, 2, 2, 2, 3, 3]
    assert set(by(metrics.neighbour_counts(sequential.uniform_regular(spark, 12, 3)), "v", "n").values()) == {3}


def test_largest_s_equals_a_plain_one():
    """All pairs in order of product and ids, for sequences with many ties; and a size that all pairs would not allow."""

    def plain(degrees):
        by = sorted(range(len(degrees)), key=lambda v: (-degrees[v], v))
        room, e = list(degrees), set()

        def join(a, b):
            e.add((min(a, b), max(a, b)))
            room[a] -= 1
            room[b] -= 1

        for k in range(1, len(degrees)):
            join(by[k], next(x for x in by[:k] if room[x] > 0))
        for _, a, b in sorted((-degrees[a] * degrees[b], a, b) for i, a in enumerate(by) for b in by[i + 1 :]):
            if room[a] > 0 and room[b] > 0 and (min(a, b), max(a, b)) not in e:
                join(a, b)
        return sorted(e)

    r = np.random.default_rng(5)
    for n in (2, 3, 7, 20, 40, 60):
        for high in (3, 5, 9, 13):
            degrees = [int(d) for d in np.maximum(1, r.integers(1, high, n)) + (np.arange(n) < 3) * 3]
            if sum(degrees) >= 2 * (n - 1) and n > 3:
                assert sequential.largest_s(degrees) == plain(degrees)
    degrees = [4 if k % 2 else 2 for k in range(301)]
    assert sequential.largest_s(degrees) == plain(degrees)
    many = [4 if k % 2 else 2 for k in range(60000)]
    assert np.bincount(np.array(sequential.largest_s(many)).ravel()).tolist() == many


def test_largest_s_graph_has_no_bound_of_its_own(spark):
    assert sequential.largest_s_graph(spark, [2] * 5001).count() == 2 * 5001


def test_rewiring_keeps_degrees(spark):
    e = gen.erdos_renyi(spark, 40, 0.15, seed=2)
    before, r0 = by(metrics.neighbour_counts(e), "v", "n"), one(metrics.assortativity(e))
    for toward in (0, 1, -1):
        new = sequential.rewired(e, 20, toward=toward)
        assert by(metrics.neighbour_counts(new), "v", "n") == before
        r = one(metrics.assortativity(new))
        assert toward == 0 or (r - r0) * toward >= -1e-7


def _swapped(pairs, k, seed, toward):
    """k swaps with all edges at hand."""
    r, own, held, d = np.random.default_rng(seed), sorted(pairs), set(pairs), {}
    for v in [v for x in own for v in x]:
        d[v] = d.get(v, 0) + 1
    done = tries = 0
    while done < k and tries < 200 * k + 1000:
        tries += 1
        i, j = (int(x) for x in r.choice(len(own), 2, replace=False))
        (a, b), (x, y) = own[i], own[j]
        if r.random() < 0.5:
            x, y = y, x
        one, two = (min(a, y), max(a, y)), (min(x, b), max(x, b))
        gain = d[a] * d[y] + d[x] * d[b] - d[a] * d[b] - d[x] * d[y]
        if len({a, b, x, y}) == 4 and one not in held and two not in held and not (toward and gain * toward <= 0):
            held = held - {own[i], own[j]} | {one, two}
            own[i], own[j] = one, two
            done += 1
    return {(a, b, 1) for x, y in own for a, b in ((x, y), (y, x))}


def test_rewiring_holds_few_edges_and_equals_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(sequential, "MOST", 60)
    for p, k, toward in ((0.15, 20, 0), (0.15, 20, 1), (0.15, 60, -1), (0.8, 10, 0)):
        e = cut(gen.erdos_renyi(spark, 40, p, seed=2))
        pairs = {(r["src"], r["dst"]) for r in e.collect() if r["src"] < r["dst"]}
        assert len(pairs) > 60
        assert sorted(map(tuple, sequential.rewired(e, k, toward=toward).collect())) == sorted(_swapped(pairs, k, 1, toward))
    with pytest.raises(ValueError):
        sequential.rewired(e, 61)


def test_a_clique_is_made_without_a_shuffle(spark):
    made = gen.canonical(spark, 7, "clique")
    assert sorted(map(tuple, made.collect())) == [(a, b, 1) for a in range(7) for b in range(7) if a != b]
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_partitioners(spark):
    e = gen.modular(spark, 80, 2, 0.2, 0.95, seed=4).drop("w")
    v = spark.range(80).withColumnRenamed("id", "v")
    for parts in (partition.stream_partition(e, 2, v=v, passes=4), partition.ldg_bisection(e, v=v), partition.restreamed(e, 2, v=v, passes=3), partition.by_chunks(v, 2), partition.balanced(v, 2, seed=1)):
        rows = parts.collect()
        assert len(rows) == 80 == len({r["v"] for r in rows}) and {r["part"] for r in rows} == {0, 1}
        assert tuple(partition.counts_of_assignment(v, parts).first()) == (0, 0)
    good = partition.edge_cut(e, partition.stream_partition(e, 2, v=v, passes=6), 2).first()["lambda"]
    assert good < partition.edge_cut(e, partition.by_hash(v, 2), 2).first()["lambda"]
    with pytest.raises(ValueError):
        partition.stream_partition(e, 2, most=10)


def test_a_stream_in_runs_equals_the_whole_one(spark):
    """Runs of few edges against the fold that holds all, on a graph with vertices without edges and on a dense one."""
    for n, p in ((60, 0.02), (60, 0.3)):
        e, v = cut(gen.erdos_renyi(spark, n, p, seed=3).select("src", "dst")), spark.range(n).withColumnRenamed("id", "v")
        whole = by(partition.stream_partition(e, 4, v=v, seed=3), "v", "part")

        def draw(a, b):
            return gen.pair_draw(3, a, b)

        own = partition.pair_degrees(spark, n, draw, [p])[:, 0]
        assert own.sum() == e.count()
        part, kept = partition.stream_over_pairs(spark, n, draw, p, own, 4, seed=3, held=max(1, int(p * 18**2 / 2)))
        assert part.tolist() == [whole[x] for x in range(n)]
        assert own.sum() - 2 * kept == sum(whole[a] != whole[b] for a, b in map(tuple, e.collect()))


def test_fold_equals_a_plain_one():
    r = np.random.default_rng(1)
    ids = np.arange(30)
    nbrs = [r.choice(30, 4, replace=False) for _ in ids]
    alpha, gamma, k = 0.3, 1.5, 3
    part, sizes = {}, [0] * k
    for i in ids.tolist():
        score = [sum(part.get(int(u)) == s for u in nbrs[i]) - 4 - alpha * ((sizes[s] + 10) ** gamma - sizes[s] ** gamma) for s in range(k)]
        part[i] = score.index(max(score))
        sizes[part[i]] += 1
    assert partition.greedy_fold(ids, nbrs, k, alpha, gamma).tolist() == [part[i] for i in range(30)]


def test_statistics(spark):
    x = spark.createDataFrame([(float(v),) for v in (5, 1, 4, 2, 3, 8, 7)], "x double")
    assert tuple(statistics.quartiles_pairs(x, "x").first()) == (2.0, 4.0, 7.0)
    assert tuple(statistics.quartiles_interpolated(x, "x").first()) == (3.0, 5.0, 8.0)
    v = np.array([5, 1, 4, 2, 3, 8, 7.0])
    hm = len(v) / (1 / v).sum()
    got = statistics.harmonic(x, "x").first()
    assert got["hmean"] == pytest.approx(hm) and got["hstd"] == pytest.approx(math.sqrt((((1 / v) - 1 / hm) ** 2).sum()) / 6 * hm * hm)


def test_learning_helpers(spark):
    nodes, edges = gnn.labelled_graphs(spark, 4, 8, 0.4, gnn.neighbour_rule)
    assert nodes.count() == 32
    rows = spark.createDataFrame([(0, 1, 0.5, 1.0, 1.0), (0, 2, -0.5, 1.0, 1.0), (0, 3, 0.2, -1.0, 0.0)], "graph_id long, node_id long, out double, target double, mask double")
    assert one(gnn.squared_error(rows)) == pytest.approx((0.25 + 2.25) / 2) and one(gnn.accuracy(rows)) == 0.5
    assert one(gnn.quadratic_error(rows)) == pytest.approx(0.25) and one(gnn.within_tolerance(rows, 1.0)) == 0.5
    m = gnn.mean_aggregation(edges.select("src", "dst"), 0.5)
    offset = nodes.select(F.col("node_id").alias("idx"), F.lit(1.0).alias("val"))
    y = by(gnn.fixpoint(m, offset, 1e-12), "idx", "val")
    a = np.zeros((32, 32))
    for r in m.collect():
        a[r["row"], r["col"]] = r["val"]
    assert [y[k] for k in range(32)] == pytest.approx(np.linalg.solve(np.eye(32) - a, np.ones(32)).tolist())
    layers = [(np.full((3, 1), 0.1), np.zeros(1))]
    assert gnn.neural_rounds(nodes, edges, layers, 1).count() == 32
    assert gnn.normalized(nodes, nodes, 1).agg(F.min(F.col("labels")[0]), F.max(F.col("labels")[0])).first()[:] == (-1.0, 1.0)
    assert gnn.principal_components(nodes, nodes, 1, 1).count() == 32 and gnn.class_weights(nodes).count() == 32


def test_patterns(spark, bowtie):
    assert gnn.cliques(bowtie, 3).count() == 2 and gnn.cliques(both(spark, [(a, b) for a in range(5) for b in range(a)]), 4).count() == 5
    labels = spark.createDataFrame([(v, 1 if v in (3, 4) else 0) for v in range(1, 7)], "v long, label int")
    found = {tuple(r) for r in gnn.labelled_subgraphs(bowtie, labels, [(0, 1), (1, 0)], [1, 1]).collect()}
    assert found == {(3, 4), (4, 3)}
    cut = both(spark, [e for e in BOWTIE if e != (3, 4)])
    assert one(predicates.is_connected(gnn.connected(cut.select("src", "dst"), representation.vertices(cut)).withColumn("w", F.lit(1))))


def test_markov_clusters(spark):
    cut = both(spark, [e for e in BOWTIE if e != (3, 4)] + [(v, v) for v in range(1, 7)])
    a = cut.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("w").cast("double").alias("val"))
    m = apps.markov_clusters(a, normalize=True)
    assert by(apps.clusters_of(m, representation.vertices(cut)), "v", "component") == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}


def test_similarity(spark, triangle):
    a = triangle.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("w").cast("double").alias("val"))
    assert {round(r["val"], 6) for r in apps.vertex_similarity(a, a).collect()} == {round(1 / 3, 6)}


def test_louvain_rounds_settle(spark):
    """Modules of a ring of cliques after which no single move gains; two rounds leave some."""
    n, size = 12, 5
    e = {(c * size + i, c * size + j) for c in range(n) for i in range(size) for j in range(size) if i != j}
    e |= {x for c in range(n) for a, b in [(c * size, (c + 1) % n * size + 1)] for x in ((a, b), (b, a))}
    near = {}
    for a, b in e:
        near.setdefault(a, []).append(b)
    part = {r["v"]: r["part"] for r in community.louvain_rounds(spark.createDataFrame(sorted(e), "src long, dst long").selectExpr("*", "1.0 as w"), rounds=None).collect()}
    total = {}
    for v, p in part.items():
        total[p] = total.get(p, 0) + len(near[v])
    for v, home in part.items():
        into = {p: sum(part[u] == p for u in near[v]) for p in {part[u] for u in near[v]} | {home}}
        for p in set(into) - {home}:
            assert (into[p] - into[home]) / len(e) <= len(near[v]) * (total[p] - total[home] + len(near[v])) / len(e) ** 2 + 1e-9


def test_registered_rounds_are_the_operators_own(spark, monkeypatch):
    from knotwork import queries

    asked = {}
    monkeypatch.setattr(queries, "graph", lambda *_: spark.createDataFrame([(1, 2, 1)], "src long, dst long, w long"))
    for module, name in ((queries.partition, "restreamed"), (queries.partition, "label_propagation"), (queries.community, "louvain_rounds")):
        monkeypatch.setattr(module, name, lambda e, *k, name=name, **options: asked.update({name: options}) or e)
    for name in ("restream_pass", "label_propagation", "louvain_rounds"):
        queries.QUERIES[name](spark, "")
    assert asked == {"restreamed": {}, "label_propagation": {}, "louvain_rounds": {"rounds": None}}


def test_generators_grow_with_the_table(spark, monkeypatch):
    from knotwork import queries

    asked = []
    monkeypatch.setattr(queries.views, "table", lambda *_: spark.range(1500))
    monkeypatch.setattr(queries, "rounded", lambda df, *_: df)
    monkeypatch.setattr(queries.sequential, "largest_s_graph", lambda s, degrees: asked.append(len(degrees)))
    monkeypatch.setattr(queries.experiments, "lambda_over_factors", lambda s, scale, *_: asked.append(scale))
    queries.QUERIES["largest_s_graph"](spark, "")
    queries.QUERIES["lambda_sweep_kronecker"](spark, "")
    assert asked == [1500, 11]


def test_two_colours_of_each_component(spark):
    e = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 4, 1), (4, 1, 1), (10, 11, 1), (11, 12, 1), (12, 10, 1), (20, 20, 1)], "src long, dst long, w int")
    got = {r["v"]: (r["component"], r["proper"]) for r in predicates.bipartite(e).collect()}
    assert got == {1: (1, True), 2: (1, True), 3: (1, True), 4: (1, True), 10: (10, False), 11: (10, False), 12: (10, False), 20: (20, False)}
    assert predicates.is_bipartite(e.where("src < 5")).first()["answer"] and not predicates.is_bipartite(e).first()["answer"]
    assert predicates.is_bipartite(e.where("src > 99")).first()["answer"]


def test_betweenness_does_not_depend_on_batches(spark):
    e = spark.createDataFrame([(a, b, 1) for a, b in [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6)] for a, b in [(a, b), (b, a)]], "src long, dst long, w int")
    one, many = ({r["v"]: round(r["score"], 9) for r in apps.betweenness(e, batch=k).collect()} for k in (64, 2))
    assert one == many == {1: 0, 2: 0, 3: 12, 4: 12, 5: 0, 6: 0}


def test_dense_likeness_is_refused_beyond_its_bound(spark):
    m = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "row long, col long, val double")
    with pytest.raises(ValueError):
        apps.vertex_similarity(m, m, most=8)


def test_binomial_draws(spark):
    draws = spark.range(4000).select(binomial(F.lit(20), 0.3, 5, "id").alias("k"), binomial(F.lit(0), 0.3, 5, "id").alias("none"))
    mean, sd, most, none = draws.agg(F.avg("k"), F.stddev("k"), F.max("k"), F.max("none")).first()
    assert abs(mean - 6) < 0.15 and abs(sd - math.sqrt(4.2)) < 0.15 and most <= 20 and none == 0


def test_triangles_shuffle_no_paths(spark):
    """The same triangles in one task and in 4 or more classes; what lies two steps away is not shuffled."""
    r = np.random.default_rng(3)
    pairs = {(int(a), int(b)) for a, b in r.integers(0, 40, (260, 2)) if a < b} | {(0, b) for b in range(1, 40)}
    e = both(spark, sorted(pairs)).union(both(spark, [(1, 1), (0, 2)]))
    brute = {(a, b, c) for a, b in pairs for c in range(40) if (a, c) in pairs and (b, c) in pairs}
    for held in (metrics.HELD, 150, 20):
        t = metrics.triangles(e, held)
        assert "Exchange" not in t._jdf.queryExecution().executedPlan().toString()
        got = [tuple(sorted(x)) for x in t.collect()]
        assert len(got) == len(set(got)) and set(got) == brute
    table = pa.table({"src": [a for a, _ in pairs], "dst": [b for _, b in pairs], "mixed": [True] * len(pairs)})
    small = [x for y in metrics.corners(marks=100, paths=7)(iter(table.to_batches(50))) for x in zip(*y.to_pydict().values())]
    assert {tuple(sorted(x)) for x in small} == brute and len(small) == len(brute)
    assert metrics.triangles(e.where("src > 99")).count() == 0


def test_triangles_are_found_by_a_task_for_each_cell(spark):
    """As many tasks as there are sets of one to three classes; and ids that are far apart, negative or texts."""
    r = np.random.default_rng(4)
    pairs = sorted({(int(a), int(b)) for a, b in r.integers(0, 30, (200, 2)) if a < b})
    brute = sum((a, c) in pairs and (b, c) in pairs for a, b in pairs for c in range(30))
    e = both(spark, pairs)
    far = e.select(*[((F.col(c) - 15) * 600_000_000_000_000_000).alias(c) for c in ("src", "dst")])
    for x in (e, far, e.select(F.col("src").cast("string"), F.col("dst").cast("string"))):
        t = metrics.triangles(x, 6 * len(pairs) // 16)
        assert t.rdd.getNumPartitions() >= 4 + 6 + 4
        assert t.count() == brute == metrics.triangles(x).count()


def test_louvain_rounds_are_a_job_each(spark):
    """A round over packed rows is one job, and its moves are those of the joined tables."""
    r = np.random.default_rng(5)
    e = both(spark, sorted({(int(a) - 30, int(b) - 30) for a, b in r.integers(0, 60, (300, 2)) if a < b})).withColumn("w", 1 + F.abs(F.col("src") + F.col("dst")) % 3)
    jobs, context = [], spark.sparkContext
    for rounds in (2, 7):
        context.setJobGroup(f"louvain {rounds}", "")
        held = by(community.louvain_rounds(e, rounds), "v", "part")
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"louvain {rounds}")))
        context.setLocalProperty("spark.jobGroup.id", None)
        assert held == by(community.louvain_rounds(e, rounds, most=0), "v", "part")
    assert jobs[1] - jobs[0] == 5
    assert community.louvain_rounds(e.where("src > 99")).count() == 0


def test_the_entry_is_imported_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(o) > 250"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[1], timeout=120)
