import math

import numpy as np
import pytest

from spatialpanel.llm import bisect

SCHEMA = "zip string, " + ", ".join(f"e{i} double" for i in range(4)) + ", leaf int, n int, cluster int"


def frame(spark, rows):
    return spark.createDataFrame([(z, *[float(x) for x in v], 1, 2, 3) for z, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def groups():
    r = np.random.default_rng(3)
    rows, truth, i = [], {}, 0
    grid = [(x, y, z) for x in range(7) for y in range(6) for z in range(3)]
    for g, c in enumerate(grid):
        for _ in range(int(r.choice([1, 1, 2, 5, 30])) if g else 400):
            d = r.normal(size=4)
            v = np.array([*c, 0.0]) * 2.2 + 0.45 * r.uniform() * d / np.linalg.norm(d)
            rows.append((f"Z{(i * 7919) % 100003:06d}", v))
            truth[rows[-1][0]] = g
            i += 1
    return rows, truth


@pytest.mark.parametrize("local_rows", [20_000, 60])
def test_clusters_are_the_groups(spark, groups, local_rows):
    rows, truth = groups
    got = {r.zip: r.cluster for r in bisect.clusters(bisect.usable_vectors(frame(spark, rows)), local_rows=local_rows).collect()}
    first = {}
    for z in sorted(truth):
        first.setdefault(truth[z], z)
    assert got == {z: first[g] for z, g in truth.items()}


def test_leaves_are_compact_and_hold_every_row(spark, groups):
    rows, _ = groups
    out = bisect.leaves(bisect.usable_vectors(frame(spark, rows)), radius=0.2, local_rows=100).collect()
    assert sorted(r.zip for r in out) == sorted(z for z, _ in rows)
    by = {}
    for r in out:
        by.setdefault(r.leaf, []).append(r.embedding)
    assert all(np.linalg.norm(np.array(v) - np.mean(v, 0), axis=1).max() <= 0.2 + 1e-9 for v in by.values())


def test_leaves_do_not_depend_on_where_nodes_are_split(spark, groups):
    def parts(**kw):
        by = {}
        for r in bisect.leaves(bisect.usable_vectors(frame(spark, groups[0])), radius=0.2, **kw).collect():
            by.setdefault(r.leaf, set()).add(r.zip)
        return {frozenset(v) for v in by.values()}

    assert parts() == parts(local_rows=60)


@pytest.mark.parametrize("local_rows", [20_000, 10])
def test_leaves_join_through_others_where_heads_are_similar(spark, local_rows, monkeypatch):
    monkeypatch.setattr(bisect, "MOST_RENAMED", 100 if local_rows > 10 else 0)
    rows = [(f"c{i:03d}", (0.35 * i, 0, 0, 0)) for i in range(60)] + [("x", (0, 50, 0, 0))]
    got = bisect.clusters(bisect.usable_vectors(frame(spark, rows)), local_rows=local_rows).collect()
    at = dict(rows)
    leaves = {}
    for r in got:
        leaves.setdefault(r.leaf, []).append(r.zip)
    assert all(math.dist(at[a], at[b]) <= 1 for z in leaves.values() for a in z for b in z)
    head = {leaf: min(z) for leaf, z in leaves.items()}
    root = dict(zip(head, head.values()))
    for _ in head:
        for a in head:
            for b in head:
                if math.dist(at[head[a]], at[head[b]]) <= 1:
                    root[a] = root[b] = min(root[a], root[b])
    assert {r.zip: r.cluster for r in got} == {z: root[leaf] for leaf, zs in leaves.items() for z in zs}
    assert len(set(root.values())) < len(head)


def test_values_next_to_each_other_end():
    x = np.array([[1e16], [1e16 + 2], [1e16], [-1e16], [1e16 + 2]])
    leaf = bisect._bisect(x, 1e-3)
    assert leaf[0] == leaf[2] and leaf[1] == leaf[4] and len(set(leaf.tolist())) == 3
    assert len(set(bisect._bisect(np.zeros((5, 2)), 1e-9).tolist())) == 1 and len(bisect._bisect(np.zeros((0, 2)), 1.0)) == 0


def test_near_finds_all_pairs():
    r = np.random.default_rng(1)
    x, y = r.uniform(0, 9, (300, 3)), r.uniform(0, 9, (700, 3))
    a, b = bisect._near(x, y, 1.0)
    want = np.nonzero(np.linalg.norm(x[:, None] - y[None], axis=-1) <= 1.0)
    assert set(zip(a.tolist(), b.tolist())) == set(zip(*[w.tolist() for w in want]))


def test_dirt_repeats_and_equal_vectors(spark):
    rows = [("a", (0, 0, 0, 0)), ("a", (0, 0, 0, 0)), ("b", (0, 0, 0, 0)), ("c", (0.5, 0, 0, 0)), ("d", (9, 9, 9, 9)), ("d", (math.nan, 0, 0, 0)), ("e", (math.inf, 0, 0, 0)), (None, (0, 0, 0, 0)), ("f", (9, 9, 9, 9.1))]
    got = {r.zip: r.cluster for r in bisect.clusters(bisect.usable_vectors(frame(spark, rows))).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "f": "d"}
    many = frame(spark, [(f"s{i:04d}", (1, 2, 3, 4)) for i in range(500)])
    assert {r.cluster for r in bisect.clusters(bisect.usable_vectors(many), local_rows=10).collect()} == {"s0000"}
    assert bisect.clusters(bisect.usable_vectors(frame(spark, []))).count() == 0


def test_description(spark):
    rows = [("a", (0, 0, 0, 0)), ("b", (0.1, 0, 0, 0)), ("c", (0.2, 0, 0, 0)), ("d", (0.1, 0, 0, 0)), ("x", (5, 5, 5, 5))]
    got = {r.cluster: tuple(r)[1:] for r in bisect.describe(bisect.clusters(bisect.usable_vectors(frame(spark, rows)))).collect()}
    assert got == {"a": (4, "b", "d", "a"), "x": (1, "x", None, None)}
