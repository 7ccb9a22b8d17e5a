"""Contiguous units: minimum spanning tree, then cuts (SKATER), and extensions."""

from __future__ import annotations

import heapq
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import normal
from ..functions.vectors import literal, square_distance, times_vector, unit
from ..schema import all_finite, require_unique
from ..session import discard, materialise
from .blocks import matrix
from .graph import HUB, Graph, components, with_fact
from .skew import positions, shuffled


@dataclass(frozen=True)
class SkaterConfig:
    n_clusters: int
    min_size: int = 1
    max_deviation: float | None = None  # of a unit's population from the mean, as a share
    max_nodes: int = 2_000_000  # nodes of the tree that the cutting task holds


def _kruskal(pdf: pd.DataFrame) -> pd.DataFrame:
    """The forest of the contracted edges (ca, cb) in one task, in the order (cost, a, b)."""
    edges = pdf.sort_values(["cost", "a", "b"], ignore_index=True)
    names, place = np.unique(np.concatenate([edges["ca"].to_numpy(str), edges["cb"].to_numpy(str)]), return_inverse=True)
    root = list(range(len(names)))
    keep = np.zeros(len(edges), bool)
    for i, (u, v) in enumerate(zip(place[: len(edges)].tolist(), place[len(edges) :].tolist())):
        while root[u] != u:
            root[u] = root[root[u]]
            u = root[u]
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        if u != v:
            root[max(u, v)] = min(u, v)
            keep[i] = True
    return edges.loc[keep, ["a", "b", "cost"]]


def spanning_forest(g: Graph, vectors: DataFrame, max_rounds: int = 40, local_edges: int = 200_000) -> DataFrame:
    """(a, b, cost): the minimum spanning forest, cost = squared distance of the ends' vectors.

    Boruvka rounds: each component takes its cheapest outgoing edge (ties by the
    ends' names, which makes the forest unique and the only cycles of hooks
    mutual ones), hooks on to the component beyond it, and roots are found by
    pointer jumping. Components at least halve every round; each round is written
    to the shared folder; cheapest edges are partially aggregated minima. Once
    at most ``local_edges`` edges between components are left, one task of that
    bounded size finishes with the same order of edges.
    """
    v = vectors.select("zip", "vector")
    ends = g.edges.filter("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    costs = with_fact(with_fact(ends, v, "a", {"vector": "_va"}), v, "b", {"vector": "_vb"}).select("a", "b", square_distance(F.col("_va"), F.col("_vb")).alias("cost"))
    active = materialise(costs.withColumn("ca", F.col("a")).withColumn("cb", F.col("b")), "costs")
    forest = v.sparkSession.createDataFrame([], "a string, b string, cost double")
    for _ in range(max_rounds):
        n = active.count()
        if n <= local_edges:
            rest = active.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(_kruskal, "a string, b string, cost double")
            return forest.unionByName(rest)
        sided = active.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("cb").alias("p")), F.struct(F.col("cb").alias("c"), F.col("ca").alias("p")))).alias("s"), F.struct("cost", "a", "b").alias("e"))
        taken = materialise(sided.groupBy("s.c").agg(F.min(F.struct("e", "s.p")).alias("m")).select("c", "m.p", "m.e.*"), "forest")
        forest = forest.unionByName(taken.select("a", "b", "cost").distinct())
        up = taken.select("c", "p")
        back = up.select(F.col("c").alias("p"), F.col("p").alias("_pp"))
        up = hooks = materialise(up.join(back, "p").select("c", F.when((F.col("_pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p")), "hooks")
        while True:
            jump = materialise(up.join(up.select(F.col("c").alias("p"), F.col("p").alias("_pp")), "p").select("c", "p", "_pp"), "hooks")
            discard(hooks)
            hooks, up = jump, jump.select("c", F.col("_pp").alias("p"))
            if jump.filter("p <> _pp").isEmpty():
                break
        up = up.withColumnRenamed("c", "zip")  # a component may hold a large share of the edges' ends
        sides = with_fact(with_fact(active, up, "ca", {"p": "_ra"}), up, "cb", {"p": "_rb"})
        before, active = active, materialise(sides.filter("_ra <> _rb").select("a", "b", "cost", F.col("_ra").alias("ca"), F.col("_rb").alias("cb")), "costs")
        discard(before, hooks)
    raise RuntimeError(f"forest not found in {max_rounds} rounds")


class _Tree:
    """A tree in arrays, with the best cut found from subtree sums (count, sum, sum of squares)."""

    # nodes ascend
    def __init__(self, nodes: np.ndarray, edges: np.ndarray, x: np.ndarray, size: np.ndarray):
        self.nodes, self.edges, self.x, self.size = nodes, edges, x, size
        mean = x[nodes].mean(0)
        self.sse = float(((x[nodes] - mean) ** 2).sum())

    def best_cut(self, min_size: int, low: float, high: float, most: int | None) -> tuple[float, int, np.ndarray] | None:
        """(gain, edge, nodes beyond it) of the cut that lowers the dispersion most, among the allowed.

        With ``most`` both sides together must get by with so many units of at most ``high``.
        """
        n = len(self.nodes)
        if n < 2:
            return None
        a, b = np.searchsorted(self.nodes, self.edges[:, 0]), np.searchsorted(self.nodes, self.edges[:, 1])
        half = np.r_[a, b]
        order = np.argsort(half, kind="stable")
        to, via = np.r_[b, a][order], np.r_[np.arange(n - 1), np.arange(n - 1)][order]
        start = np.searchsorted(half[order], np.arange(n + 1))
        parent, edge, walk = np.full(n, -1), np.full(n, -1), [0]
        for u in walk:
            for k in range(start[u], start[u + 1]):
                if to[k] != parent[u]:
                    parent[to[k]], edge[to[k]] = u, via[k]
                    walk.append(to[k])
        v = self.x[self.nodes] - self.x[self.nodes].mean(0)
        s, q, c, w = v.copy(), (v**2).sum(1), np.ones(n), self.size[self.nodes].astype(float)
        for u in reversed(walk[1:]):
            s[parent[u]] += s[u]
            q[parent[u]] += q[u]
            c[parent[u]] += c[u]
            w[parent[u]] += w[u]
        total_s, total_w = s[0], w[0]
        inside = q - (s**2).sum(1) / c
        rest_n = np.maximum(n - c, 1)
        outside = (q[0] - q) - ((total_s - s) ** 2).sum(1) / rest_n
        gain = self.sse - inside - outside
        ok = (c >= min_size) & (n - c >= min_size) & (w >= low) & (total_w - w >= low)
        if most is not None:
            ok &= _units(w, high) + _units(total_w - w, high) <= most
        ok[0] = False
        if not ok.any():
            return None
        u = int(np.argmax(np.where(ok, gain, -np.inf)))
        beyond, stack = np.zeros(n, bool), [u]
        while stack:
            y = stack.pop()
            beyond[y] = True
            stack += [int(to[k]) for k in range(start[y], start[y + 1]) if to[k] != parent[y]]
        return float(gain[u]), int(edge[u]), beyond


def _units(weight: np.ndarray | float, high: float) -> np.ndarray:
    """How many units of at most ``high`` a weight takes at least."""
    return np.maximum(np.ceil(np.asarray(weight) / high - 1e-9), 1)


def _cut(n: int, edges: np.ndarray, root: np.ndarray, x: np.ndarray, size: np.ndarray, c: SkaterConfig) -> np.ndarray:
    by_root, e_root = np.argsort(root, kind="stable"), root[edges[:, 0]]
    by_edge, roots = np.argsort(e_root, kind="stable"), np.unique(root)
    cut = lambda order, keys: np.split(order, np.searchsorted(keys[order], roots)[1:])
    trees = [_Tree(nodes, edges[e], x, size) for nodes, e in zip(cut(by_root, root), cut(by_edge, e_root))]
    if not len(trees) <= c.n_clusters <= n:
        raise ValueError(f"n_clusters must lie between the graph's {len(trees)} components and its {n} nodes")
    share = size.sum() / c.n_clusters
    if c.max_deviation is None or not share:
        return _numbered(n, _greedy(trees, x, size, c, 0.0, None))
    low, high = share * (1 - c.max_deviation), share * (1 + c.max_deviation)
    for part in (1.0, 0.75, 0.5, 0.25, 0.0):  # a tighter aim leaves more ways to cut what is left
        units = _greedy(trees, x, size, c, low, share + part * (high - share))
        if max(size[t.nodes].sum() for t in units) <= high * (1 + 1e-9):
            return _numbered(n, units)
    raise ValueError(f"found no cuts that keep every unit's population within {c.max_deviation:g} of the mean")


def _greedy(trees: list[_Tree], x: np.ndarray, size: np.ndarray, c: SkaterConfig, low: float, high: float | None) -> list[_Tree]:
    """Cuts until there are n_clusters trees or none is allowed; trees of more than ``high`` are cut first."""
    heap, final, made = [], [], 0
    need = lambda t: 1 if high is None else int(_units(size[t.nodes].sum(), high))
    asked = sum(need(t) for t in trees)

    def best_of(t: _Tree) -> tuple[float, int, np.ndarray] | None:
        return t.best_cut(c.min_size, low, high or np.inf, None if high is None else c.n_clusters - asked + need(t))

    def offer(t: _Tree, best: tuple[float, int, np.ndarray] | None) -> None:
        nonlocal made
        made += 1
        if best is None:
            final.append(t)
        else:
            heapq.heappush(heap, (need(t) == 1, -best[0], made, t, best))

    for t in trees:
        offer(t, best_of(t) if high is None else t.best_cut(c.min_size, low, np.inf, None))
    while heap and len(heap) + len(final) < c.n_clusters:
        _, _, _, t, best = heapq.heappop(heap)
        if high is not None and (best := best_of(t)) is None:  # units are left for fewer cuts than when it was offered
            final.append(t)
            continue
        _, edge, beyond = best
        keep = np.arange(len(t.edges)) != edge
        side = beyond[np.searchsorted(t.nodes, t.edges[:, 0])]
        halves = [_Tree(t.nodes[~beyond], t.edges[keep & ~side], x, size), _Tree(t.nodes[beyond], t.edges[keep & side], x, size)]
        asked += sum(need(h) for h in halves) - need(t)
        for h in halves:
            offer(h, best_of(h) if high is None else h.best_cut(c.min_size, low, np.inf, None))
    return [h[3] for h in heap] + final


def _numbered(n: int, units: list[_Tree]) -> np.ndarray:
    unit = np.empty(n, int)
    for i, t in enumerate(sorted(units, key=lambda t: t.nodes.min())):
        unit[t.nodes] = i
    return unit


def run_skater(vectors: DataFrame, g: Graph, config: SkaterConfig, population: DataFrame | None = None, forest: DataFrame | None = None) -> DataFrame:
    """(zip, unit_id 0 .. K-1): a partition into contiguous units.

    ``vectors`` is (zip, vector) with unique zips, finite components and the same
    zips as the graph (ValueError otherwise). The spanning forest is built across
    the cluster; then K - components greedy cuts, each lowering the units'
    summed squared deviations most, are made in one task that holds the reduced
    forest - n - 1 edges, at most ``max_nodes`` nodes, else ValueError. Fewer
    than K units come out only if min_size or max_deviation allow no more cuts.
    max_deviation bounds each unit's population on both sides of the mean over K
    units: no cut goes below, and an error is raised if the cuts found leave a
    unit above - the cuts are greedy, so others may exist. A component below the
    bound from the start stays as it is.
    ``forest`` is that of ``spanning_forest`` where the caller has it already.
    ``population`` (zip, size) is what max_deviation bounds.
    """
    require_unique(vectors, "zip")
    if not vectors.filter(~F.coalesce(all_finite(F.col("vector")), F.lit(False))).isEmpty():
        raise ValueError("vectors must be finite")
    n = vectors.count()
    if not 1 <= config.n_clusters <= n:
        raise ValueError("n_clusters must lie between 1 and the number of zips")
    if n > config.max_nodes:
        raise ValueError(f"more than {config.max_nodes} nodes to cut")
    nodes = g.nodes.select("zip")
    if not vectors.join(nodes, "zip", "left_anti").isEmpty() or not nodes.join(vectors, "zip", "left_anti").isEmpty():
        raise ValueError("vectors and graph must name the same zips")
    forest = materialise(spanning_forest(g, vectors), "forest") if forest is None else forest
    both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    roots = components(Graph(nodes, forest.select(both.alias("e")).select("e.*")))
    sized = vectors.join(population.select("zip", F.col("size").cast("double").alias("size")), "zip", "left") if population is not None else vectors.withColumn("size", F.lit(1.0))
    tagged = sized.join(roots, "zip").select(F.lit(0).alias("g"), "zip", "vector", F.coalesce("size", F.lit(0.0)).alias("size"), "component", F.lit(None).cast("string").alias("b"))
    links = forest.select(F.lit(0).alias("g"), F.col("a").alias("zip"), F.lit(None).cast("array<double>").alias("vector"), F.lit(0.0).alias("size"), F.lit(None).cast("string").alias("component"), "b")

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["b"].isna()].sort_values("zip")
        zips = own["zip"].to_numpy()
        at = {z: i for i, z in enumerate(zips)}
        e = pdf[pdf["b"].notna()]
        edges = np.array([[at[a], at[b]] for a, b in zip(e["zip"], e["b"])], int).reshape(-1, 2)
        root = np.array([at[c] for c in own["component"]])
        unit = _cut(len(zips), edges, root, np.stack(own["vector"].to_numpy()).astype(float), own["size"].to_numpy(float), config)
        return pd.DataFrame({"zip": zips, "unit_id": unit})

    return tagged.unionByName(links).groupBy("g").applyInPandas(cut, "zip string, unit_id bigint")


def relabel(labels: DataFrame) -> DataFrame:
    """Labels as 0 .. K-1 in their order: the distinct labels are numbered by ranges and joined back."""
    return labels.join(positions(labels, "unit_id", "_new"), "unit_id").select("zip", F.col("_new").alias("unit_id"))


def _gram(vec: DataFrame, dims: int) -> np.ndarray:
    """Sum over all rows of vec vec^T: one matrix per task, added up by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            x = matrix(batch.column(0))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "g"])

    rows = vec.select("vec").mapInArrow(run, "cell int, g double").groupBy("cell").agg(F.sum("g").alias("g")).collect()
    gram = np.zeros(dims * dims)
    for r in rows:
        gram[r.cell] = r.g
    return gram.reshape(dims, dims)


def _orthonormal(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(matrix that turns rows into an orthonormal basis of their columns' span, eigenvalues after two rounds from such a basis)."""
    value, basis = np.linalg.eigh(gram)
    return basis / np.sqrt(np.maximum(value, 1e-300)), np.maximum(value, 0.0) ** 0.25


def _iterate(pdf: pd.DataFrame, rounds: int, tolerance: float) -> pd.DataFrame:
    """The rounds of ``spectral_embedding`` on arrays: rows (zip, vec) of nodes and (zip, dst, w) of edges."""
    nodes, edges = pdf[pdf["dst"].isna()].sort_values("zip"), pdf[pdf["dst"].notna()].sort_values("zip", kind="stable")
    zips = nodes["zip"].to_numpy()
    src, dst = np.searchsorted(zips, edges["zip"].to_numpy()), np.searchsorted(zips, edges["dst"].to_numpy())
    starts, w, x = np.flatnonzero(np.r_[True, src[1:] != src[:-1]]), edges["w"].to_numpy(float)[:, None], np.stack(nodes["vec"].to_numpy())
    last, still = None, False
    for turn in range(rounds):
        met = np.zeros_like(x)
        met[src[starts]] = np.add.reduceat(w * x[dst], starts)
        x = (x + met) / 2
        if turn % 2 == 0:
            continue
        turn_to, now = _orthonormal(x.T @ x)
        x = x @ turn_to
        if still := last is not None and np.abs(now - last).max() <= tolerance:
            break
        last = now
    return pd.DataFrame({"zip": zips, "vec": list(x), "still": still})


def spectral_embedding(g: Graph, dims: int, rounds: int = 100, seed: int = 0, tolerance: float = 1e-3, local_edges: int = 400_000) -> DataFrame:
    """(zip, vec): the leading ``dims`` eigenvectors' span of the normalised adjacency, rows of unit length.

    Subspace iteration: vec <- (vec + neighbours' vec by normalised weight) / 2,
    orthonormalised every other round through its dims x dims Gram matrix, the
    only thing that reaches the driver. It ends when no eigenvalue moves by more
    than ``tolerance``, with a warning if that takes over ``rounds`` rounds. Every
    other round is written to the shared folder; at most ``local_edges`` edges go
    through the same rounds in one task of that bounded size. Islands do not come out.
    """
    edges = materialise(g.edges.select("src", "dst", "weight"), "affinities")
    degree = materialise(edges.groupBy(F.col("src").alias("zip")).agg(F.sum("weight").alias("d")), "degrees")
    both = with_fact(with_fact(edges, degree, "src", {"d": "_a"}), degree, "dst", {"d": "_b"})
    step = materialise(both.select("src", "dst", (F.col("weight") / F.sqrt(F.col("_a") * F.col("_b"))).alias("w")), "affinities")
    discard(edges)
    item = lambda c, i: F.get(c, F.lit(i))
    vec, last, held = degree.select("zip", F.array(*[normal(seed, f"spectral{i}", F.col("zip")) for i in range(dims)]).alias("vec")), None, degree
    still = False
    if 0 < step.count() <= local_edges:
        kind = degree.schema["zip"].dataType.simpleString()
        rows = vec.select(F.lit(0).alias("g"), "zip", "vec", F.lit(None).cast(kind).alias("dst"), F.lit(None).cast("double").alias("w"))
        rows = rows.unionByName(step.select(F.lit(0).alias("g"), F.col("src").alias("zip"), F.lit(None).cast("array<double>").alias("vec"), "dst", "w"))
        vec = materialise(rows.groupBy("g").applyInPandas(lambda pdf: _iterate(pdf, rounds, tolerance), f"zip {kind}, vec array<double>, still boolean"), "spectral")
        still, rounds_here = vec.filter("NOT still").isEmpty(), 0
    else:
        rounds_here = rounds
    for turn in range(rounds_here):
        met = with_fact(step, vec, "dst", {"vec": "vec"}).groupBy(F.col("src").alias("zip")).agg(F.array(*[F.sum(F.col("w") * item("vec", i)) for i in range(dims)]).alias("n"))
        vec = vec.join(met, "zip").select("zip", F.zip_with("vec", "n", lambda x, y: (x + y) / 2).alias("vec"))
        if turn % 2 == 0:
            continue
        vec = materialise(vec, "spectral")
        discard(held)
        held = vec
        turn_to, now = _orthonormal(_gram(vec, dims))
        vec = vec.select("zip", times_vector(literal(turn_to.T), F.col("vec")).alias("vec"))
        if still := last is not None and np.abs(now - last).max() <= tolerance:
            break
        last = now
    if not still:
        warnings.warn(f"spectral embedding: eigenvalues still move after {rounds} rounds", RuntimeWarning, stacklevel=2)
    return vec.select("zip", unit(F.col("vec")).alias("vec"))


def spectral_clusters(g: Graph, n_clusters: int, seed: int = 0) -> DataFrame:
    """(zip, unit_id): k-means on the spectral embedding; islands get -1."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = spectral_embedding(g, n_clusters, seed=seed).withColumn("features", array_to_vector("vec"))
    found = KMeans(k=n_clusters, seed=seed).fit(rows).transform(rows).select("zip", F.col("prediction").cast("bigint").alias("unit_id"))
    return g.nodes.select("zip").join(found, "zip", "left").select("zip", F.coalesce("unit_id", F.lit(-1)).alias("unit_id"))


def modularity(g: Graph, labels: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of a labelling (zip, unit_id): two aggregates over the edges."""
    edges = with_fact(with_fact(g.edges, labels, "src", {"unit_id": "_a"}), labels, "dst", {"unit_id": "_b"})
    per = edges.groupBy("_a").agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("weight")).otherwise(0.0)).alias("i"))
    r = per.agg(F.sum("k").alias("m"), F.sum("i").alias("i"), F.sum(F.col("k") * F.col("k")).alias("q")).first()
    return 0.0 if not r.m else r.i / r.m - resolution * r.q / (r.m * r.m)


def _communities(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, names: list[str], resolution: float) -> np.ndarray:
    """Community name of each node: the rounds of ``louvain`` on arrays, with the same names and the same order of choice."""
    member, total = np.arange(len(names)), weight.sum()

    def score(code: np.ndarray) -> float:
        held = np.bincount(code[src], weight)
        return weight[code[src] == code[dst]].sum() / total - resolution * (held * held).sum() / (total * total)

    while total:
        own = np.array([xxhash.xxh64_intdigest(z.encode(), 42) for z in names], np.uint64).view(np.int64)
        k, apart = np.bincount(src, weight, len(names)), src != dst
        ids, code = np.unique(own, return_inverse=True)
        start = best = score(code)
        turn = failed = 0
        while failed < 2:
            held, width = np.bincount(code, k, len(ids)), len(ids)
            pair, back = np.unique(src[apart] * width + code[dst[apart]], return_inverse=True)
            link, u, c = np.bincount(back, weight[apart], len(pair)), pair // width, pair % width
            mine = c == code[u]
            gain = link - resolution * k[u] * (held[c] - np.where(mine, k[u], 0.0)) / total
            here = np.zeros(len(names))
            here[u[mine]] = gain[mine]
            way = (c < code[u]) if turn % 2 == 0 else (c > code[u])
            order = np.lexsort((c[way], gain[way], u[way]))
            u, c, gain = u[way][order], c[way][order], gain[way][order]
            last = np.r_[u[1:] != u[:-1], True] if len(u) else np.zeros(0, bool)
            last &= gain > here[u] + 1e-12
            new = code.copy()
            new[u[last]] = c[last]
            turn += 1
            now = score(new)
            if now <= best + 1e-9:
                failed += 1
                continue
            failed, best = 0, now
            own = ids[new]
            ids, code = np.unique(own, return_inverse=True)
        if best <= start + 1e-9:
            break
        member, names = code[member], [str(i) for i in ids]
        pair, back = np.unique(code[src] * len(ids) + code[dst], return_inverse=True)
        src, dst, weight = pair // len(ids), pair % len(ids), np.bincount(back, weight)
    return np.array(names, object)[member]


def _finish_louvain(resolution: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, place = np.unique(np.concatenate([pdf["src"].to_numpy(str), pdf["dst"].to_numpy(str)]), return_inverse=True)
        found = _communities(place[: len(pdf)], place[len(pdf) :], pdf["weight"].to_numpy(float), names.tolist(), resolution)
        return pd.DataFrame({"node": names, "unit": found})

    return run


def _links(level: Graph, own: DataFrame, total: float, resolution: float, hubs: bool) -> tuple[DataFrame, float]:
    """(zip, unit_id, k, c, w): each node's summed weight to every community ``c`` around it, loops left out; and the modularity.

    ``own`` is (zip, unit_id, k, s) with a node's strength and the weight of its
    loop. What a round needs of the edges is in the links, so a round reads them once.
    """
    apart, ends = level.edges.filter("src <> dst"), own.select(F.col("zip").alias("dst"), F.col("unit_id").alias("c"))
    met = with_fact(apart, own, "dst", {"unit_id": "c"}) if hubs else apart.join(shuffled(ends), "dst")
    met = met.groupBy(F.col("src").alias("zip"), "c").agg(F.sum("weight").alias("w"))
    links = materialise(shuffled(met).join(own, "zip").select("zip", "unit_id", "k", "c", "w"), "louvain")
    inside = links.filter("c = unit_id").agg(F.sum("w")).first()[0] or 0.0
    r = own.groupBy("unit_id").agg(F.sum("k").alias("t"), F.sum("s").alias("s")).agg(F.sum(F.col("t") * F.col("t")).alias("q"), F.sum("s").alias("s")).first()
    return links, (inside + r.s) / total - resolution * r.q / (total * total)


def louvain(g: Graph, resolution: float = 1.0, local_edges: int = 400_000) -> DataFrame:
    """(zip, unit_id): communities by rounds of local moves, then merging communities into nodes.

    In a round every node may move to the neighbouring community of largest gain
    in modularity; of two communities only the larger-named gives nodes to the
    smaller-named in even rounds and the other way in odd ones, so moves of a
    round cannot swap. A round that does not raise modularity is undone; after
    two of them in a row the communities become nodes, and all ends when that
    raises modularity no more. Every accepted round raises it by over 1e-9, so
    there is no other limit. Once a level has at most ``local_edges`` edges, one
    task of that bounded size goes through the same rounds. Islands are units of
    their own.
    """
    member = g.nodes.select("zip", F.col("zip").alias("node"))
    level = Graph(g.nodes, materialise(g.edges.select("src", "dst", "weight"), "louvain"))  # read again in every round
    while True:
        if level.edges.count() <= local_edges:
            units = level.edges.select("src", "dst", "weight", F.lit(0).alias("_one")).groupBy("_one").applyInPandas(_finish_louvain(resolution), "node string, unit string")
            member = member.join(units, "node", "left").select("zip", F.coalesce("unit", "node").alias("node"))
            break
        loop = F.when(F.col("src") == F.col("dst"), F.col("weight")).otherwise(0.0)
        strength = level.edges.groupBy(F.col("src").alias("zip")).agg(F.sum("weight").alias("k"), F.sum(loop).alias("s"))
        zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("k", "s")]
        own = materialise(level.nodes.join(shuffled(strength), "zip", "left").select("zip", F.xxhash64("zip").alias("unit_id"), *zero), "louvain")
        total = own.agg(F.sum("k")).first()[0] or 0.0
        if not total:
            break
        hubs = not level.edges.groupBy("dst").count().filter(F.col("count") > HUB).isEmpty()  # looked for once, not in every round
        links, best = _links(level, own, total, resolution, hubs)
        start, turn, failed = best, 0, 0
        while failed < 2:
            unit = own.groupBy(F.col("unit_id").alias("c")).agg(F.sum("k").alias("t"))
            here, way = F.col("c") == F.col("unit_id"), F.col("c") < F.col("unit_id") if turn % 2 == 0 else F.col("c") > F.col("unit_id")
            gain = F.col("w") - F.lit(resolution) * F.col("k") * (F.col("t") - F.when(here, F.col("k")).otherwise(0.0)) / F.lit(total)
            scored = links.join(shuffled(unit), "c").withColumn("gain", gain)
            top = scored.groupBy("zip").agg(F.max(F.when(way, F.struct("gain", "c"))).alias("m"), F.max(F.when(here, F.col("gain"))).alias("_here"))
            moves = top.filter(F.col("m.gain") > F.coalesce("_here", F.lit(0.0)) + 1e-12).select("zip", F.col("m.c").alias("_to"))
            new = materialise(own.join(shuffled(moves), "zip", "left").select("zip", F.coalesce("_to", "unit_id").alias("unit_id"), "k", "s"), "louvain")
            seen, score = _links(level, new, total, resolution, hubs)
            turn += 1
            if score <= best + 1e-9:
                failed += 1
                discard(new, seen)
                continue
            discard(own, links)
            own, links, best, failed = new, seen, score, 0
        if best <= start + 1e-9:
            break
        named = shuffled(own.select(F.col("zip").alias("node"), F.col("unit_id").cast("string").alias("_n")))
        member = materialise(member.join(named, "node").select("zip", F.col("_n").alias("node")), "louvain")
        loops = own.filter("s <> 0").select("unit_id", F.col("unit_id").alias("c"), F.col("s").alias("w"))
        merged = links.select("unit_id", "c", "w").unionByName(loops).groupBy(F.col("unit_id").cast("string").alias("src"), F.col("c").cast("string").alias("dst"))
        edges = materialise(merged.agg(F.sum("w").alias("weight")), "louvain")
        discard(level.edges, links)
        level = Graph(own.select(F.col("unit_id").cast("string").alias("zip")).distinct(), edges)
    return member.select("zip", F.xxhash64("node").alias("unit_id"))


def select_best(metrics: DataFrame, target: str, largest: bool = True) -> DataFrame:
    """The row of ``metrics`` (method, ...) with the best ``target``; NULL and NaN never win, ties go to the first method."""
    order = F.col(target).desc_nulls_last() if largest else F.col(target).asc_nulls_last()
    return metrics.filter(F.col(target).isNotNull() & ~F.isnan(target)).orderBy(order, "method").limit(1)
