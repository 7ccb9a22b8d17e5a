"""Similarity clusters of vectors by bisecting k-means.

A node is split in two until it is compact (every member within ``radius`` of
its centre). Splits of different nodes do not touch each other and every node
over the limit is split in the end, so the leaves are the same whether the node
of largest dispersion goes first or all of a level go at once: large nodes are
split level by level across the cluster, nodes of at most ``local_rows`` rows
are finished in one task each. Both split alike: at
the mean along the widest axis, then LLOYD_ROUNDS moves of the two centres.

The tree of the large nodes lies on the driver (at most rows / local_rows inner
nodes) and goes to the tasks, which walk it for every row; so a pass over the
vectors shuffles nothing but sums per node, and no intermediate assignment is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.blocks import distances, matrix
from ..operators.graph import Graph, components
from ..operators.skew import join_group_facts
from ..schema import all_finite, from_wide
from ..session import discard, materialise

LLOYD_ROUNDS = 2
#: Most tasks that finish small nodes; a task takes several nodes beyond that.
MOST_TASKS = 2000
#: Most renamed leaves that are broadcast; beyond that they are joined by shuffle.
MOST_RENAMED = 100_000

#: A split: (mid, w, left, right); x goes right if (x - mid) . w > 0. None is a node without one.
Tree = list


def usable_vectors(df: DataFrame, key: str = "zip", prefix: str = "e") -> DataFrame:
    """Distinct (key, embedding) with a key and finite components only."""
    return from_wide(df, key, prefix).filter(F.col(key).isNotNull() & all_finite(F.col("embedding"))).distinct()


def _square(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _mean(dims: int) -> Column:
    return F.array(*[F.avg(F.get("embedding", F.lit(i))) for i in range(dims)])


def _bisect(x: np.ndarray, radius: float) -> np.ndarray:
    """Leaf number of each row. All nodes over the limit are split at once, level by level, by sums over the rows ordered by node."""
    leaf = np.zeros(len(x), np.int64)
    rows, size, made = np.arange(len(x)), np.array([len(x)]), 0
    while len(rows):
        node, starts = np.repeat(np.arange(len(size)), size), np.r_[0, np.cumsum(size)[:-1]]
        v = x[rows]
        v -= (np.add.reduceat(v, starts) / size[:, None])[node]
        square = v * v
        over = np.maximum.reduceat(square.sum(1), starts) > radius * radius
        var = np.add.reduceat(square, starts)
        along = v[np.arange(len(v)), np.argmax(var, 1)[node]]
        sides = lambda side: np.add.reduceat(side.astype(np.int64), starts)
        both = lambda side: (0 < sides(side)) & (sides(side) < size)
        side = along > 0
        close = over & ~both(side)  # rounding: values next to each other
        if close.any():
            side = np.where(close[node], along > np.minimum.reduceat(along, starts)[node], side)
            over &= both(side)
        done = np.cumsum(~over) - 1
        leaf[rows[~over[node]]] = made + done[node[~over[node]]]
        made += int((~over).sum())
        going = over[node]
        rows, v, side, size = rows[going], v[going], side[going], size[over]
        if not len(rows):
            break
        node, starts = np.repeat(np.arange(len(size)), size), np.r_[0, np.cumsum(size)[:-1]]
        moving = np.ones(len(size), bool)
        for _ in range(LLOYD_ROUNDS):
            right = sides(side)[:, None]
            sum_b = np.add.reduceat(v * side[:, None], starts)
            a, b = -sum_b / (size[:, None] - right), sum_b / right  # the sums of both sides cancel out
            new = ((v - ((a + b) / 2)[node]) * (b - a)[node]).sum(1) > 0
            moving &= both(new)
            side = np.where(moving[node], new, side)
        order = np.argsort(2 * node + side, kind="stable")
        rows = rows[order]
        size = np.stack([size - sides(side), sides(side)], 1).ravel()
    return leaf


def _route(tree: Tree, x: np.ndarray, margin: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, node without split) of every row; with ``margin`` of all nodes that hold a place so near to the row."""
    rows, nodes, todo = [], [], [(0, np.arange(len(x)))]
    while todo:
        node, at = todo.pop()
        if not len(at):
            continue
        if tree[node] is None:
            rows.append(at)
            nodes.append(np.full(len(at), node))
            continue
        mid, w, left, right = tree[node]
        s = (x[at] - mid) @ w
        reach = 0.0 if margin is None else margin * (1 + 1e-9) * float(np.sqrt(w @ w)) + 1e-12
        todo.append((left, at[s <= reach]))
        todo.append((right, at[s > 0] if margin is None else at[s >= -reach]))
    return (np.concatenate(rows), np.concatenate(nodes)) if rows else (np.zeros(0, int), np.zeros(0, int))


@dataclass
class _Growing:
    """A large node on its way to a split: the one being tried and the best so far with its sides' (n, mean, var)."""

    trial: tuple[np.ndarray, np.ndarray]
    kept: tuple[np.ndarray, np.ndarray] | None = None
    sides: tuple | None = None
    rounds: int = 0


def _pass(vectors: DataFrame, tree: Tree, growing: dict[int, _Growing], dims: int) -> dict[int, tuple]:
    """node -> (far, side -> (n, mean, var)): sums over each growing node's sides by its trial split, far the largest squared distance to the split's mid."""
    sent = vectors.sparkSession.sparkContext.broadcast((tree, {k: g.trial for k, g in growing.items()}))
    sums = [f"{c}{i}" for c in "sq" for i in range(dims)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, trials = sent.value
        total: dict[tuple[int, bool], np.ndarray] = {}
        for batch in batches:
            x = matrix(batch.column(0))
            rows, nodes = _route(tree, x)
            for node in np.unique(nodes).tolist():
                if node not in trials:
                    continue
                mid, w = trials[node]
                v = x[rows[nodes == node]] - mid
                right = v @ w > 0
                for side in (False, True):
                    u = v[right == side]
                    if len(u):
                        old = total.setdefault((node, side), np.zeros(2 * dims + 2))
                        old[:-1] += np.r_[len(u), u.sum(0), (u * u).sum(0)]
                        old[-1] = max(old[-1], (u * u).sum(1).max())
        if total:
            flat = np.array(list(total.values()))
            keys = [pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total])]
            yield pa.RecordBatch.from_arrays(keys + [pa.array(flat[:, i]) for i in range(2 * dims + 2)], names=["node", "side", "n", *sums, "far"])

    schema = "node int, side boolean, n double, " + ", ".join(f"{c} double" for c in sums) + ", far double"
    rows = vectors.select("embedding").mapInArrow(run, schema).groupBy("node", "side").agg(F.sum("n"), *[F.sum(c) for c in sums], F.max("far")).collect()
    sent.destroy()
    out: dict[int, tuple] = {}
    for r in rows:
        n, mid = r[2], growing[r[0]].trial[0]
        s, q = np.array(r[3 : 3 + dims]) / n, np.array(r[3 + dims : 3 + 2 * dims]) / n
        far, sides = out.get(r[0], (0.0, {}))
        sides[r[1]] = (int(n), mid + s, q - s * s)
        out[r[0]] = (max(far, r[-1]), sides)
    return out


def grow(vectors: DataFrame, dims: int, radius: float, local_rows: int) -> tuple[Tree, set[int], set[int]]:
    """(tree, its compact large leaves, its nodes of at most ``local_rows`` rows) of (key, embedding)."""
    tree: Tree = [None]
    compact: set[int] = set()
    small: set[int] = set()
    growing: dict[int, _Growing] = {}

    def plant(node: int, side: tuple) -> None:
        n, mean, var = side
        if n <= local_rows:
            small.add(node)
        else:
            growing[node] = _Growing((mean, np.eye(dims)[int(np.argmax(var))]))

    start = np.array(vectors.first()["embedding"], float)
    whole = _pass(vectors, tree, {0: _Growing((start, np.zeros(dims)))}, dims)
    plant(0, whole[0][1][False])
    while growing:
        for node, (far, sides) in _pass(vectors, tree, growing, dims).items():
            g = growing[node]
            if g.kept is None and far <= radius * radius:
                compact.add(node)
                del growing[node]
                continue
            moved = len(sides) == 2
            if moved:
                same = g.sides is not None and all(g.sides[s][0] == sides[s][0] and np.array_equal(g.sides[s][1], sides[s][1]) for s in (False, True))
                g.kept, g.sides = g.trial, sides
            if moved and not same and g.rounds < LLOYD_ROUNDS:
                a, b = sides[False][1], sides[True][1]
                g.trial, g.rounds = ((a + b) / 2, b - a), g.rounds + 1
                continue
            del growing[node]
            if g.kept is None:  # rounding: the values lie next to each other
                compact.add(node)
                continue
            tree[node] = (*g.kept, len(tree), len(tree) + 1)
            tree.extend([None, None])
            for side, child in ((False, len(tree) - 2), (True, len(tree) - 1)):
                plant(child, g.sides[side])
    return tree, compact, small


def _planted(vectors: DataFrame, key: str, tree: Tree) -> DataFrame:
    """Adds ``node``, where the tree leads each row."""
    sent = vectors.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, nodes = _route(sent.value, matrix(batch.column(1)))
            at = np.empty(len(rows), np.int32)
            at[rows] = nodes
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at)], names=[key, "embedding", "node"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, "embedding").mapInArrow(run, f"`{key}` {kind}, embedding array<double>, node int")


def _leaves(vectors: DataFrame, key: str, radius: float, local_rows: int) -> tuple[DataFrame, Tree] | None:
    """((key, embedding, leaf, head, first), tree): head is the leaf's smallest key, first marks its row. Written; None if empty."""
    vectors = materialise(vectors.select(key, F.col("embedding").cast("array<double>")), "vectors")
    one = vectors.select(F.size("embedding").alias("d")).first()
    if one is None:
        return None
    kind = vectors.schema[key].dataType.simpleString()
    tree, compact, small = grow(vectors, one.d, radius, local_rows)
    planted = _planted(vectors, key, tree)
    if compact:
        planted = materialise(planted, "planted")

    def finish(t: pa.Table) -> pa.Table:
        x = matrix(t["embedding"].combine_chunks())
        leaf = _bisect(x, radius)
        keys = t[key].combine_chunks()
        _, rank = np.unique(np.array(keys.to_pylist()), return_inverse=True)
        order = np.lexsort((*x.T[::-1], rank, leaf))
        start = np.r_[True, leaf[order][1:] != leaf[order][:-1]]
        first = np.zeros(len(x), bool)
        first[order[start]] = True
        head = np.empty(len(x), np.int64)
        head[order] = order[start][np.cumsum(start) - 1]
        names = pa.array([f"s{t['node'][0]}_{k}" for k in leaf.tolist()])
        return pa.Table.from_arrays([keys, t["embedding"].combine_chunks(), names, keys.take(pa.array(head)), pa.array(first)], names=[key, "embedding", "leaf", "head", "first"])

    schema = f"`{key}` {kind}, embedding array<double>, leaf string, head {kind}, first boolean"
    local = planted.filter(~F.col("node").isin(sorted(compact))) if compact else planted
    out = local.repartition(max(1, min(len(small), MOST_TASKS)), "node").groupBy("node").applyInArrow(finish, schema)
    if compact:
        large = planted.filter(F.col("node").isin(sorted(compact)))
        heads = large.groupBy("node").agg(F.min(F.struct(key, "embedding")).alias("_h"))  # one row per large leaf
        with_head = large.join(F.broadcast(heads), "node")
        out = out.unionByName(with_head.select(key, "embedding", F.concat(F.lit("t"), "node").alias("leaf"), F.col(f"_h.{key}").alias("head"), (F.struct(key, "embedding") == F.col("_h")).alias("first")))
    written = materialise(out, "leaves")
    discard(planted, vectors)
    return written, tree


def leaves(vectors: DataFrame, key: str = "zip", radius: float = 0.5, local_rows: int = 50_000) -> DataFrame:
    """(key, embedding, leaf STRING): compact leaves of the bisecting tree.

    Members of a leaf lie within ``radius`` of its centre, so within 2 * radius
    of each other. Equal vectors always share a leaf. An empty table gives none.
    """
    found = _leaves(vectors, key, radius, local_rows)
    return vectors.select(key, "embedding", F.lit("").alias("leaf")) if found is None else found[0].select(key, "embedding", "leaf")


def _near(own: np.ndarray, others: np.ndarray, distance: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices (own, other) of pairs at most ``distance`` apart: along the widest axis only what is near is compared."""
    axis = int(np.argmax(others.var(0)))
    order, mine = np.argsort(others[:, axis]), np.argsort(own[:, axis])
    along, found = others[order, axis], []
    for at in range(0, len(own), 128):
        part = mine[at : at + 128]
        lo = np.searchsorted(along, own[part[0], axis] - distance * (1 + 1e-9) - 1e-12)
        hi = np.searchsorted(along, own[part[-1], axis] + distance * (1 + 1e-9) + 1e-12, side="right")
        a, b = np.nonzero(distances(own[part], others[order[lo:hi]]) <= distance)
        found.append((part[a], order[lo + b]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _similar(heads: DataFrame, tree: Tree, distance: float) -> DataFrame:
    """(leaf, other), leaf < other: leaves whose heads (leaf, v) lie at most ``distance`` apart.

    The tree is the search structure: a head goes to its own node and visits
    every node that its surroundings reach; there heads meet.
    """
    sent = heads.sparkSession.sparkContext.broadcast(tree)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            home = np.empty(len(x), np.int64)
            rows, nodes = _route(sent.value, x)
            home[rows] = nodes
            rows, nodes = _route(sent.value, x, distance)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.astype(np.int32)), pa.array(home[rows] == nodes), batch.column(0).take(at), batch.column(1).take(at)], names=["node", "own", "leaf", "v"])

    def meet(t: pa.Table) -> pa.Table:
        x, own = matrix(t["v"].combine_chunks()), np.flatnonzero(t["own"].to_numpy())
        names = np.array(t["leaf"].to_pylist(), object)
        a, b = _near(x[own], x, distance) if len(own) else (own, own)
        u, v = names[own[a]], names[b]
        keep = u != v
        low, high = np.minimum(u, v)[keep], np.maximum(u, v)[keep]
        return pa.Table.from_arrays([pa.array(low, pa.string()), pa.array(high, pa.string())], names=["leaf", "other"])

    routed = heads.select("leaf", "v").mapInArrow(spread, "node int, own boolean, leaf string, v array<double>")
    tasks = max(1, min(sum(n is None for n in tree), MOST_TASKS))
    return routed.repartition(tasks, "node").groupBy("node").applyInArrow(meet, "leaf string, other string").distinct()


def clusters(vectors: DataFrame, key: str = "zip", distance: float = 1.0, local_rows: int = 50_000) -> DataFrame:
    """(key, embedding, leaf, cluster): leaves of members at most ``distance`` apart, with cut clusters rejoined.

    A split can cut through a cluster. The exact check that follows compares the
    leaves' heads (their smallest keys): leaves whose heads are at most
    ``distance`` apart belong together, directly or through others, and the
    cluster is named by the smallest key of them all. Where similarity is an
    equivalence these are exactly its classes. The result is read back from a
    written table.
    """
    found = _leaves(vectors, key, distance / 2, local_rows)
    if found is None:
        return vectors.select(key, "embedding", F.lit("").alias("leaf"), F.col(key).alias("cluster"))
    assigned, tree = found
    heads = assigned.filter("first").select("leaf", "head", F.col("embedding").alias("v"))
    pairs = materialise(_similar(heads, tree, distance), "pairs")
    if pairs.isEmpty():
        return assigned.select(key, "embedding", "leaf", F.col("head").alias("cluster"))
    both = F.explode(F.array(F.struct(F.col("leaf").alias("src"), F.col("other").alias("dst")), F.struct(F.col("other").alias("src"), F.col("leaf").alias("dst"))))
    edges = pairs.select(both.alias("e")).select("e.src", "e.dst")
    joined = components(Graph(edges.select(F.col("src").alias("zip")).distinct(), edges)).select(F.col("zip").alias("leaf"), "component")
    named = materialise(joined.join(heads.select("leaf", "head"), "leaf"), "named")
    best = named.groupBy("component").agg(F.min("head").alias("cluster"))
    renamed = materialise(named.join(best, "component").filter("cluster <> head").select("leaf", "cluster"), "renamed")
    discard(named, pairs)
    if renamed.count() <= MOST_RENAMED:
        out = assigned.join(F.broadcast(renamed), "leaf", "left")
    else:
        sizes = assigned.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).join(renamed, "leaf", "left")
        out = join_group_facts(assigned, sizes, "leaf", "n", assigned.count())
    return out.select(key, "embedding", "leaf", F.coalesce("cluster", "head").alias("cluster"))


def describe(assigned: DataFrame, key: str = "zip", top: int = 3) -> DataFrame:
    """(cluster, size, typical_1 .. typical_top): keys nearest to the cluster's centre.

    Of equally near members (squared distances equal to 9 decimals) the smaller
    key is the more typical. The limit by
    rank is applied before the shuffle too, so a cluster of any size costs each
    task ``top`` rows.
    """
    dims = assigned.select(F.size("embedding").alias("d")).first()
    total = assigned.count()
    centres = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("size"), _mean(dims.d if dims else 1).alias("c"))
    placed = join_group_facts(assigned.select(key, "embedding", "cluster"), centres, "cluster", "n", total)
    near = placed.groupBy("cluster", "size", key).agg(F.round(F.min(_square(F.col("embedding"), F.col("c"))), 9).alias("d2"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("d2", key))
    best = near.withColumn("_rank", rank).filter(F.col("_rank") <= top)
    return best.groupBy("cluster", "size").agg(*[F.max(F.when(F.col("_rank") == i + 1, F.col(key))).alias(f"typical_{i + 1}") for i in range(top)])
