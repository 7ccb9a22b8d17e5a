import math

import numpy as np
import pytest

from spatialpanel.operators import metrics
from spatialpanel.operators.graph import Graph


def vectors(spark, x, labels):
    return spark.createDataFrame([(f"z{i:04d}", [float(v) for v in r], int(u)) for i, (r, u) in enumerate(zip(x, labels))], "zip string, vector array<double>, unit_id bigint")


def labelled(spark, pairs):
    return spark.createDataFrame(pairs, "zip string, unit_id bigint")


def graph(spark, edges, nodes):
    rows = [(a, b, 1.0) for a, b in edges] + [(b, a, 1.0) for a, b in edges]
    return Graph(spark.createDataFrame([(n,) for n in nodes], "zip string"), spark.createDataFrame(rows, "src string, dst string, weight double"))


def plain_silhouette(x, u):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        own = u == u[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, u == k].mean() for k in set(u) if k != u[i])
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.array(out)


def plain_davies_bouldin(x, u):
    k = sorted(set(u))
    c = np.array([x[u == i].mean(0) for i in k])
    s = np.array([np.sqrt(((x[u == i] - c[j]) ** 2).sum(1)).mean() for j, i in enumerate(k)])
    return np.mean([max((s[i] + s[j]) / np.linalg.norm(c[i] - c[j]) for j in range(len(k)) if j != i) for i in range(len(k))])


def test_two_blobs_and_brute_force(spark):
    r = np.random.default_rng(42)
    x = np.concatenate([r.normal(0, 0.5, (50, 2)), r.normal(5, 0.5, (50, 2)), r.normal((0, 6), 0.8, (20, 2))])
    u = np.repeat([0, 1, 2], [50, 50, 20])
    q = metrics.quality_scores(vectors(spark, x, u))
    assert q["silhouette"] == pytest.approx(plain_silhouette(x, u).mean(), abs=1e-12) and q["silhouette"] > 0.5
    assert q["davies_bouldin"] == pytest.approx(plain_davies_bouldin(x, u), abs=1e-12) and q["davies_bouldin"] < 1.0


def test_centroids_in_several_passes(spark, monkeypatch):
    r = np.random.default_rng(1)
    x, u = r.normal(size=(60, 3)), np.arange(60) % 12
    monkeypatch.setattr(metrics, "CENTROIDS", 3)
    assert metrics.davies_bouldin(vectors(spark, x, u)).first()[0] == pytest.approx(plain_davies_bouldin(x, u), abs=1e-12)


def test_degenerate_partitions(spark):
    x = [[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]]
    for u, why in (([0, 0, 0], "one cluster"), ([0, 0, 1], "singleton")):
        assert metrics.quality_guard(vectors(spark, x, u)) == why
        assert all(math.isnan(v) for v in metrics.quality_scores(vectors(spark, x, u)).values())
    assert metrics.quality_guard(vectors(spark, [[0.0, math.nan], [1.0, 1.0]], [0, 1])) == "non-finite"
    same = vectors(spark, [[1.0, 1.0]] * 4, [0, 0, 1, 1])
    assert metrics.quality_scores(same) == {"silhouette": 0.0, "davies_bouldin": 0.0}


def test_sampling_is_exact_and_repeatable(spark):
    df = vectors(spark, np.random.default_rng(0).normal(size=(200, 2)), np.arange(200) % 4)
    a = sorted(r.zip for r in metrics.silhouette_samples(df, 50).collect())
    assert len(a) == 50 and a == sorted(r.zip for r in metrics.silhouette_samples(df.repartition(5), 50).collect())
    assert a != sorted(r.zip for r in metrics.silhouette_samples(df, 50, random_state=1).collect())


def test_contiguity(spark):
    line = graph(spark, [("A", "B"), ("B", "C")], "ABC")
    assert metrics.contiguity_score(labelled(spark, [("A", 0), ("B", 0), ("C", 1)]), line) == {"connected_fraction": 1.0, "violating_clusters": 0, "n_clusters": 2}
    island = graph(spark, [("A", "B")], "ABC")
    got = metrics.contiguity_score(labelled(spark, [("A", 0), ("B", 1), ("C", 0)]), island)
    assert got == {"connected_fraction": 0.5, "violating_clusters": 1, "n_clusters": 2}
    with pytest.raises(ValueError):
        metrics.contiguity_score(labelled(spark, [("A", 0), ("B", 1)]), island)
    with pytest.raises(ValueError):
        metrics.contiguity_score(labelled(spark, [("A", 0), ("B", 1), ("C", 1), ("D", 1)]), island)


def test_stability(spark):
    a = labelled(spark, [(z, i // 2) for i, z in enumerate("ABCDE")])
    assert metrics.partition_stability(a, a) == {"ari": 1.0, "jaccard": 1.0}
    one, single = labelled(spark, [(z, 0) for z in "ABCDE"]), labelled(spark, [(z, i) for i, z in enumerate("ABCDE")])
    got = metrics.partition_stability(one, single)
    assert got["ari"] <= 0 and got["jaccard"] == 0.0
    b = labelled(spark, [("A", 0), ("B", 0), ("C", 0), ("D", 1), ("E", 1)])
    tp = sum(1 for i in "ABCDE" for j in "ABCDE" if i != j and dict(A=0, B=0, C=1, D=1, E=2)[i] == dict(A=0, B=0, C=1, D=1, E=2)[j] and dict(A=0, B=0, C=0, D=1, E=1)[i] == dict(A=0, B=0, C=0, D=1, E=1)[j])
    assert metrics.pair_confusion(a, b).first().tp == tp
    with pytest.raises(ValueError):
        metrics.partition_stability(a, b.filter("zip <> 'E'"))


def test_summary(spark):
    m = labelled(spark, [("A", 1), ("B", 1), ("C", 2), ("D", 2), ("A", None)])
    df = spark.createDataFrame([("A", 100, 1.0, 5), ("B", 200, math.nan, 5), ("C", 150, None, 5), ("D", None, math.nan, 5), ("E", 1, 1.0, 5)], "zip string, population bigint, sales double, unit_id int")
    got = [tuple(r) for r in metrics.cluster_summary(m, df, ["population", "sales"]).collect()]
    assert got == [(1, 2, 300, 1.0), (2, 2, 150, None)]
    assert [r.sales for r in metrics.cluster_summary(m, df, ["sales"], handle_nan_attrs=False).collect()] == [1.0, 0.0]
    assert metrics.cluster_summary(m, df).columns == ["unit_id", "n_zips"]
    with pytest.raises(ValueError, match="D"):
        metrics.cluster_summary(m, df.filter("zip <> 'D'"))
    with pytest.raises(ValueError):
        metrics.cluster_summary(m, df, ["nothing"])
    assert metrics.cluster_summary(m.limit(0), df, ["sales"]).count() == 0


def test_silhouette_of_every_row_in_chunks(spark):
    r = np.random.default_rng(11)
    rows = [(f"z{i:03d}", [float(v) for v in r.normal(i % 4, 0.6, 3)], i % 4) for i in range(130)]
    df = spark.createDataFrame(rows, "zip string, vector array<double>, unit_id bigint")
    whole = {x.zip: x for x in metrics.silhouette_samples(df).collect()}
    for chunk in (7, 60):
        got = metrics.silhouette_samples(df, None, chunk=chunk).collect()
        assert len(got) == 130 and all(x[2:] == pytest.approx(whole[x.zip][2:]) for x in got)
