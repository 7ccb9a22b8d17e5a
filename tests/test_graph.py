import math
import random

import pytest

from spatialpanel.operators import graph as G
from spatialpanel.operators import synth

EDGES = "src_zip string, dst_zip string, weight double, seq int"


def mobility(spark, data):
    return spark.createDataFrame([(a, b, w, i) for i, (a, b, w) in enumerate(data)], EDGES)


def pairs(g):
    return {(r.src, r.dst): r.weight for r in g.edges.collect()}


def plain(spark, data, nodes=()):
    both = [(a, b, 1.0) for a, b in data] + [(b, a, 1.0) for a, b in data]
    names = sorted({x for e in data for x in e} | set(nodes))
    return G.Graph(spark.createDataFrame([(n,) for n in names], "zip string"), spark.createDataFrame(both, "src string, dst string, weight double"))


def test_mobility_dedup_first_row_and_symmetry(spark):
    df = mobility(spark, [("A", "B", 1.0), ("B", "A", 9.0), ("A", "C", 0.5), ("C", "A", 0.7), ("A", "A", 5.0), (None, "B", 1.0), ("B", "C", math.nan), ("B", "C", None), ("C", "D", -1.0)])
    g = G.mobility_graph(df, keep_numeric_weights=True, order=["seq"])
    assert pairs(g) == {("A", "B"): 1.0, ("B", "A"): 1.0, ("A", "C"): 0.5, ("C", "A"): 0.5}
    assert set(pairs(G.mobility_graph(df)).values()) == {1.0}
    assert sorted(r.zip for r in g.nodes.collect()) == ["A", "B", "C"]
    assert {(r.zip, r.degree, r.strength) for r in G.node_strength(g).collect()} == {("A", 2, 1.5), ("B", 1, 1.0), ("C", 1, 0.5)}


def test_mobility_without_dedup_sums_and_threshold_is_inclusive_and_monotone(spark):
    df = mobility(spark, [("A", "B", 1.0), ("A", "B", 2.0), ("B", "A", 4.0), ("C", "D", 0.5)])
    assert pairs(G.mobility_graph(df, 0.5, True, False)) == {("A", "B"): 7.0, ("B", "A"): 7.0, ("C", "D"): 0.5, ("D", "C"): 0.5}
    sizes = [len(pairs(G.mobility_graph(df, t))) for t in (0, 0.5, 0.9, 4.0, 99.0)]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == 0
    with pytest.raises(ValueError):
        G.mobility_graph(df.drop("weight"))


def test_permutation_invariance(spark):
    r = random.Random(1)
    data = [(f"z{r.randrange(9)}", f"z{r.randrange(9)}", float(r.randrange(9))) for _ in range(80)]
    df = mobility(spark, data)
    assert pairs(G.mobility_graph(df, 0, True, order=["seq"])) == pairs(G.mobility_graph(df.orderBy("weight").repartition(3), 0, True, order=["seq"]))


def test_align(spark):
    g = plain(spark, [("Z1", "Z2"), ("Z2", "Z3"), ("Z3", "X")])
    order = spark.createDataFrame([("Z3", 0), ("Z1", 1), ("Z2", 2)], "zip string, pos int")
    a = G.align_graph(g, order)
    assert set(pairs(a)) == {("Z1", "Z2"), ("Z2", "Z1"), ("Z2", "Z3"), ("Z3", "Z2")}
    assert [r.zip for r in a.nodes.orderBy("pos").collect()] == ["Z3", "Z1", "Z2"]
    assert [r.zip for r in G.extra_nodes(g, order).collect()] == ["X"] and not G.same_nodes(g, order) and G.same_nodes(a, order)
    with pytest.raises(ValueError, match="Q0"):
        G.align_graph(g, order.union(spark.createDataFrame([(f"Q{i}", 9) for i in range(7)], order.schema)))


@pytest.mark.parametrize("k", [1, 3, 5])
def test_knn_against_brute_force(spark, k):
    r = random.Random(k)
    pts = [(f"p{i:03d}", round(r.gauss(0, 1), 2), round(r.gauss(0, 30), 2)) for i in range(150)] + [(f"town{i:03d}", 5 + r.uniform(0, 1e-3), 7 + r.uniform(0, 1e-3)) for i in range(150)] + [(f"same{i:02d}", -40.0, 10.0) for i in range(40)] + [("far", 80.0, -170.0)]
    df = spark.createDataFrame(pts + [(None, 1.0, 1.0), ("nan", math.nan, 1.0), ("null", None, 1.0)], "geo_id string, latitude double, longitude double")
    want = {(a[0], b) for a in pts for _, b in sorted(((a[1] - q[1]) ** 2 + (a[2] - q[2]) ** 2, q[0]) for q in pts if q[0] != a[0])[:k]}
    got = [tuple(x) for x in G.knn_edges(df, k).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    sym = set(pairs(G.knn_graph(df, k)))
    assert sym == want | {(b, a) for a, b in want}


def test_knn_small_tables_and_errors(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.0, 0.0), ("c", 1.0, 0.0)], "geo_id string, latitude double, longitude double")
    assert len(G.knn_edges(df, 8).collect()) == 6
    assert G.knn_edges(df.limit(1), 8).count() == 0 and G.knn_edges(df.limit(0), 8).count() == 0
    with pytest.raises(ValueError):
        G.knn_edges(df, 0)
    assert set(pairs(G.radius_graph(df, 1.0))) == {(a, b) for a in "abc" for b in "abc" if a != b}
    assert set(pairs(G.radius_graph(df, 0.5))) == {("a", "b"), ("b", "a")}


def test_knn_broadcasts_only_what_is_bounded(spark):
    """Spark's estimate of the exploded cells is that of the table they come from, whatever their number."""
    r = random.Random(7)
    df = spark.createDataFrame([(f"p{i:03d}", r.random(), r.random()) for i in range(300)], "geo_id string, latitude double, longitude double")
    plan = G.knn_graph(df, 4).edges._jdf.queryExecution()
    assert plan.executedPlan().toString().count("BroadcastHashJoin") == plan.optimizedPlan().toString().count("strategy=broadcast") > 0


def test_contiguity_rules(spark):
    square = lambda x, y: [{"x": x + a, "y": y + b} for a, b in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))]
    df = spark.createDataFrame([("a", square(0, 0)), ("b", square(1, 0)), ("c", square(1, 1)), ("island", square(9, 9)), (None, square(0, 1))], "zip string, ring array<struct<x:double,y:double>>")
    assert set(pairs(G.contiguity_graph(df, "Rook"))) == {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")}
    assert ("a", "c") in pairs(G.contiguity_graph(df, "queen"))
    assert G.contiguity_graph(df).nodes.count() == 4
    with pytest.raises(ValueError):
        G.contiguity_graph(df, "bishop")


@pytest.mark.parametrize("local_edges", [200_000, 0])
def test_components(spark, local_edges):
    r = random.Random(3)
    data = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("hub", f"leaf{i:03d}") for i in range(80)] + [(f"r{r.randrange(90):02d}", f"r{r.randrange(90):02d}") for _ in range(60)]
    data = [(a, b) for a, b in data if a != b]
    root = {x: x for e in data for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in data:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {x.zip: x.component for x in G.components(plain(spark, data, ["island"]), local_edges=local_edges).collect()}
    assert got == {**{x: find(x) for x in root}, "island": "island"}


def test_components_of_nothing(spark):
    empty = G.Graph(spark.createDataFrame([], "zip string"), spark.createDataFrame([], "src string, dst string, weight double"))
    assert G.components(empty).count() == 0


def test_lattice(spark):
    nodes, g = synth.lattice_grid(spark, 3, 2)
    assert [r.zip for r in nodes.orderBy("zip").collect()] == ["Z000000", "Z000001", "Z000002", "Z001000", "Z001001", "Z001002"]
    nodes, g = synth.lattice_grid(spark, 4, 4, 2, 2)
    assert nodes.select("block_id").distinct().count() == 4
    _, g = synth.lattice_grid(spark, 3, 3)
    assert {r.degree for r in G.node_strength(g).filter("zip = 'Z001001'").collect()} == {4}
    assert G.components(g).select("component").distinct().count() == 1
    for bad in ((0, 1, 1, 1), (1, 1, 0, 1), (1001, 1, 1, 1)):
        with pytest.raises(ValueError):
            synth.lattice_nodes(spark, *bad)


def test_lattice_embeddings(spark):
    df = spark.createDataFrame([("a", 0, 0), ("b", 1, 1), ("c", 2, 2)], "zip string, row int, col int")
    assert [r.e0 for r in synth.make_embeddings(df, 0.0).orderBy("zip").collect()] == [0.0, 0.5, 1.0]
    a, b = synth.make_embeddings(df, 0.1).collect(), synth.make_embeddings(df.repartition(3), 0.1).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    with pytest.raises(ValueError):
        synth.make_embeddings(df, -1)
    with pytest.raises(ValueError):
        synth.make_embeddings(df.drop("row"))
