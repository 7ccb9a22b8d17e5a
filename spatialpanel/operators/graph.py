"""Graphs as two relations: nodes(zip) and edges(src, dst, weight), both directions stored."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import require_columns
from ..session import discard, materialise
from .skew import join_group_facts, salted, shuffled

#: A node with more edges than this is a hub: its edges are dealt over several tasks where they meet a fact of the node.
HUB = 1_000_000


@dataclass(frozen=True)
class Graph:
    """``nodes`` keeps islands; ``edges`` is what is joined."""

    nodes: DataFrame
    edges: DataFrame


def clean_edges(edges: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Edges with both ends, no self-loop and weight >= threshold (NULL and NaN weights dropped)."""
    require_columns(edges, "src_zip", "dst_zip", "weight")
    w = F.col("weight")
    keep = F.col("src_zip").isNotNull() & F.col("dst_zip").isNotNull() & (w >= threshold) & ~F.isnan(w)
    strings = edges.withColumn("src_zip", F.col("src_zip").cast("string")).withColumn("dst_zip", F.col("dst_zip").cast("string"))
    return strings.filter(keep & (F.col("src_zip") != F.col("dst_zip")))


def mobility_graph(edges: DataFrame, threshold: float = 0.0, keep_numeric_weights: bool = False, deduplicate_edges: bool = True, order: list[str] | None = None) -> Graph:
    """The undirected mobility graph.

    With ``deduplicate_edges`` an unordered pair keeps the weight of its first row
    by ``order`` (default: by direction and weight; no file order is assumed);
    without it the weights of a directed pair's rows are summed, in both
    directions. Weights are 1.0 unless ``keep_numeric_weights``. An empty result
    is an empty graph. One partially aggregated shuffle; hot zips are spread over their partners.
    """
    kept = clean_edges(edges, threshold)
    if deduplicate_edges:
        first = F.min(F.struct(*(order or ["src_zip", "dst_zip"]), F.col("weight").alias("_w")))
        pairs = kept.groupBy(F.least("src_zip", "dst_zip").alias("a"), F.greatest("src_zip", "dst_zip").alias("b")).agg(first.alias("f")).select("a", "b", F.col("f._w").alias("weight"))
        both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
        out = pairs.select(both.alias("e"), "weight").select("e.src", "e.dst", "weight")
    else:
        both = F.explode(F.array(F.struct(F.col("src_zip").alias("src"), F.col("dst_zip").alias("dst")), F.struct(F.col("dst_zip").alias("src"), F.col("src_zip").alias("dst"))))
        out = kept.select(both.alias("e"), "weight").groupBy("e.src", "e.dst").agg(F.sum("weight").alias("weight"))
    if not keep_numeric_weights:
        out = out.withColumn("weight", F.lit(1.0))
    return Graph(out.select(F.col("src").alias("zip")).distinct(), out)


def node_strength(g: Graph) -> DataFrame:
    """(zip, degree, strength): neighbours and summed weight of every node, islands with zero."""
    sums = g.edges.groupBy(F.col("src").alias("zip")).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))
    return g.nodes.join(sums, "zip", "left").select("zip", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"))


def missing_nodes(g: Graph, order: DataFrame) -> DataFrame:
    """Requested zips that the graph lacks."""
    return order.select("zip").distinct().join(g.nodes, "zip", "left_anti")


def extra_nodes(g: Graph, order: DataFrame) -> DataFrame:
    """Nodes of the graph that are not requested."""
    return g.nodes.join(order.select("zip").distinct(), "zip", "left_anti")


def same_nodes(g: Graph, order: DataFrame) -> bool:
    """Whether graph and order name the same zips."""
    return missing_nodes(g, order).isEmpty() and extra_nodes(g, order).isEmpty()


def align_graph(g: Graph, order: DataFrame) -> Graph:
    """The graph restricted to the zips of ``order`` (zip, pos); edges to dropped nodes go too.

    ValueError naming the first five requested zips that the graph lacks.
    """
    gone = [r.zip for r in missing_nodes(g, order).orderBy("zip").limit(6).collect()]
    if gone:
        raise ValueError(f"zips not in the graph: {gone[:5]}{' ...' if len(gone) > 5 else ''}")
    keys = order.select("zip")
    edges = g.edges.join(keys.withColumnRenamed("zip", "src"), "src", "left_semi").join(keys.withColumnRenamed("zip", "dst"), "dst", "left_semi")
    return Graph(order.select("zip", "pos"), edges.select("src", "dst", "weight"))


def induced(g: Graph, keys: DataFrame) -> Graph:
    """The graph on all the zips of ``keys``, islands too, with the edges among them."""
    zips = keys.select("zip").distinct()
    edges = g.edges.join(zips.withColumnRenamed("zip", "src"), "src", "left_semi").join(zips.withColumnRenamed("zip", "dst"), "dst", "left_semi")
    return Graph(zips, materialise(edges.select("src", "dst", "weight"), "induced"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    back = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return pairs.select(back.alias("e")).select("e.src", "e.dst").distinct().withColumn("weight", F.lit(1.0))


def knn_edges(points: DataFrame, k: int, key: str = "geo_id", x: str = "latitude", y: str = "longitude") -> DataFrame:
    """(src, dst): each point's k nearest others by plane distance, ties by the smaller key.

    Keys must be unique; rows with a NULL key or a NULL or NaN coordinate are
    left out. With fewer than k others all of them are neighbours.

    Equal coordinates are folded first: only their k + 1 smallest keys can be
    anyone's neighbours. Each distinct place then takes the finest square cell,
    of a ladder of powers of two, that holds more than k candidates besides its
    own keys; its k nearest lie within that cell's diagonal, so in the 5 x 5
    cells around: an equi-join, exact, without a cross join. Places that no cell
    on the ladder serves (tiny tables, far outliers) take the top cell.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    good = points.filter(F.col(key).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select(F.col(key).alias("id"), (F.col(x) + F.lit(0.0)).alias("x"), (F.col(y) + F.lit(0.0)).alias("y"))
    rank = F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))
    near_ids = materialise(good.withColumn("r", rank).filter(F.col("r") <= k + 1).drop("r"), "places")
    places = near_ids.groupBy("x", "y").agg(F.count(F.lit(1)).alias("m"))
    span = near_ids.agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("top")).first().top
    if span is None:
        return good.select(F.col("id").alias("src"), F.col("id").alias("dst")).limit(0)
    top = 2
    while 2.0**top < 2 * span + 1:
        top += 1
    levels = F.explode(F.array(*[F.lit(v) for v in range(top, top - 31, -2)]))
    side = F.pow(F.lit(2.0), F.col("level"))
    cell = lambda df: df.withColumn("ix", F.floor(F.col("x") / side)).withColumn("iy", F.floor(F.col("y") / side))
    laddered = cell(places.withColumn("level", levels))
    counts = laddered.groupBy("level", "ix", "iy").agg(F.sum("m").alias("c")).filter(F.col("c") > 2 * k + 1)
    chosen = laddered.join(shuffled(counts), ["level", "ix", "iy"], "left_semi").groupBy("x", "y").agg(F.min("level").alias("level"))
    within = F.coalesce(F.pow(F.lit(4.0), F.col("level")) * (2 + 1e-9), F.lit(math.inf)).alias("within")
    chosen = places.select("x", "y").join(shuffled(chosen), ["x", "y"], "left").select("x", "y", F.coalesce("level", F.lit(top)).alias("level"), within)
    chosen = materialise(chosen, "cells")
    used = [r.level for r in chosen.select("level").distinct().collect()]
    around = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    asked = cell(chosen).withColumn("ox", around).withColumn("oy", around).select("x", "y", "within", "level", (F.col("ix") + F.col("ox")).alias("ix"), (F.col("iy") + F.col("oy")).alias("iy"))
    offered = cell(near_ids.withColumn("level", F.explode(F.array(*[F.lit(v) for v in used])))).select("level", "ix", "iy", F.col("id").alias("dst"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    d2 = F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2)
    cells = ["level", "ix", "iy"]  # a coarse cell, asked for by far places, offers very many
    many, few = salted(offered, asked, cells, near_ids.count() * len(used))
    met = shuffled(many).join(shuffled(few), [*cells, "_salt"]).filter(d2 <= F.col("within")).select("x", "y", "dst", d2.alias("d2"))
    first = F.row_number().over(Window.partitionBy("x", "y").orderBy("d2", "dst"))
    best = met.withColumn("r", first).filter(F.col("r") <= k + 1).groupBy("x", "y").agg(F.sort_array(F.collect_list(F.struct("r", "dst"))).alias("_near"))
    sized = good.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).join(shuffled(best), ["x", "y"]).select(F.xxhash64("x", "y").alias("h"), F.col("x").alias("_px"), F.col("y").alias("_py"), "n", "_near")
    rows = join_group_facts(good.withColumn("h", F.xxhash64("x", "y")), shuffled(sized), "h", "n", good.count()).filter("x = _px AND y = _py")
    mine = F.slice(F.filter("_near", lambda s: s["dst"] != F.col("id")), 1, k)
    return rows.select(F.col("id").alias("src"), F.explode(mine).alias("e")).select("src", F.col("e.dst").alias("dst"))


def knn_graph(points: DataFrame, k: int = 8, key: str = "geo_id", x: str = "latitude", y: str = "longitude") -> Graph:
    """The symmetric k-nearest-neighbour graph (union of both directions), without self-loops."""
    return Graph(points.filter(F.col(key).isNotNull()).select(F.col(key).alias("zip")).distinct(), _both_ways(knn_edges(points, k, key, x, y)))


def radius_graph(points: DataFrame, radius: float, key: str = "geo_id", x: str = "latitude", y: str = "longitude") -> Graph:
    """Edges between points at plane distance <= radius: equi-join over cells of that side."""
    if radius <= 0:
        raise ValueError("radius must be positive")
    good = points.filter(F.col(key).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select(F.col(key).alias("src"), F.col(x).alias("x"), F.col(y).alias("y")).distinct()
    cells = good.withColumn("ix", F.floor(F.col("x") / radius)).withColumn("iy", F.floor(F.col("y") / radius))
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    near = cells.withColumn("ox", step).withColumn("oy", step).select("src", "x", "y", (F.col("ix") + F.col("ox")).alias("ix"), (F.col("iy") + F.col("oy")).alias("iy"))
    other = cells.select(F.col("src").alias("dst"), F.col("x").alias("_x"), F.col("y").alias("_y"), "ix", "iy")
    close = F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2) <= radius * radius
    many, few = salted(other, near, ["ix", "iy"])
    met = many.join(shuffled(few), ["ix", "iy", "_salt"]).filter(F.col("src") != F.col("dst")).filter(close)
    return Graph(good.select(F.col("src").alias("zip")).distinct(), met.select("src", "dst").distinct().withColumn("weight", F.lit(1.0)))


def contiguity_graph(polygons: DataFrame, rule: str = "rook", digits: int = 9) -> Graph:
    """Polygons (zip, ring, and holes if there are any) that share a side (rook) or a corner (queen).

    Corners are rounded to ``digits`` decimals, sides are unordered pairs of
    neighbouring corners; the equi-join on them is exact for coverages whose
    neighbours use the same corners. A corner shared by very many polygons is a
    hot key whose pairs are all edges, i.e. output.
    """
    kind = rule.lower()
    if kind not in ("rook", "queen"):
        raise ValueError(f"rule must be rook or queen, not {rule!r}")
    if "holes" in polygons.columns:  # a neighbour inside a hole shares its sides
        polygons = polygons.select("zip", F.explode(F.concat(F.array("ring"), F.coalesce("holes", F.array()))).alias("ring"))
    corner = F.transform("ring", lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y")))
    rings = polygons.filter(F.col("zip").isNotNull() & (F.size("ring") >= 3)).select(F.col("zip").cast("string").alias("zip"), corner.alias("c"))
    if kind == "queen":
        keyed = rings.select("zip", F.explode("c").alias("part"))
    else:
        nxt = F.concat(F.slice("c", F.lit(2), F.size("c") - 1), F.slice("c", 1, 1))
        sides = F.zip_with("c", nxt, lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))
        keyed = rings.select("zip", F.explode(F.filter(sides, lambda s: s["a"] != s["b"])).alias("part"))
    keyed = keyed.distinct()
    met = keyed.select(F.col("zip").alias("src"), "part").join(keyed.select(F.col("zip").alias("dst"), "part"), "part").filter("src <> dst")
    return Graph(rings.select("zip").distinct(), met.select("src", "dst").distinct().withColumn("weight", F.lit(1.0)))


def _minimum(edges: DataFrame, key: str, value: str, rows: int) -> DataFrame:
    """edges with ``m``, the smallest ``value`` per ``key``; hot keys are spread."""
    least = edges.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("m"))
    return join_group_facts(edges, least, key, "_n", rows).drop("_n")


def min_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node number in the component of each of n nodes, edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            return label
        label = new[label]


def _finish(pdf: pd.DataFrame) -> pd.DataFrame:
    names, place = np.unique(np.concatenate([pdf["u"].to_numpy(str), pdf["v"].to_numpy(str)]), return_inverse=True)
    a, b = place[: len(pdf)], place[len(pdf) :]
    return pd.DataFrame({"u": names, "v": names[min_labels(a, b, len(names))]})


def components(g: Graph, max_rounds: int = 60, local_edges: int = 200_000) -> DataFrame:
    """(zip, component): the smallest zip reachable from each node; islands name themselves.

    Alternating large-star and small-star rounds: the number of rounds grows as
    the square of the logarithm of the nodes, not with the graph's diameter.
    Every round is written to the shared folder, so no lineage builds up and a
    hub costs no single task. Once at most ``local_edges`` edges are left they are
    finished in one task of that bounded size (keys are compared as text).
    RuntimeError if it has not ended after ``max_rounds``.
    """
    state = materialise(g.edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "components")
    before = None
    for _ in range(max_rounds):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rows = 2 * state.count()
        if not rows:
            break
        if rows <= 2 * local_edges:
            state = state.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(_finish, "u string, v string")
            break
        large = _minimum(both, "u", "v", rows).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u <> v").distinct()
        large = materialise(large, "components")
        discard(state)
        small = _minimum(large, "u", "v", large.count())
        star = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        state = materialise(small.select(star.alias("e")).select("e.u", "e.v").filter("u <> v").distinct(), "components")
        discard(large)
        mark = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components not found in {max_rounds} rounds")
    root = state.select(F.col("u").alias("zip"), F.col("v").alias("_root"))
    return g.nodes.select("zip").join(root, "zip", "left").select("zip", F.coalesce("_root", "zip").alias("component"))


def with_fact(edges: DataFrame, facts: DataFrame, end: str, names: dict[str, str]) -> DataFrame:
    """Edges joined with columns of ``facts`` (zip, ...; one row per zip) at one ``end``, renamed by ``names``; hubs are salted."""
    kept = facts.select(F.col("zip").alias(end), *[F.col(c).alias(n) for c, n in names.items()])
    many, few = salted(edges, kept, [end], least=HUB)
    return many.join(shuffled(few), [end, "_salt"]).drop("_salt")


def neighbour_sum(g: Graph, vectors: DataFrame, dims: int) -> DataFrame:
    """(zip, nbr): the component-wise sum of the neighbours' vectors; islands get zeros."""
    met = with_fact(g.edges.select("src", "dst"), vectors, "dst", {"vec": "vec"})
    sums = met.groupBy(F.col("src").alias("zip")).agg(F.array(*[F.sum(F.get("vec", F.lit(i))) for i in range(dims)]).alias("nbr"))
    zeros = F.array(*[F.lit(0.0)] * dims)
    return vectors.select("zip").join(shuffled(sums), "zip", "left").select("zip", F.coalesce("nbr", zeros).alias("nbr"))


def within_label(g: Graph, labels: DataFrame) -> Graph:
    """The graph of ``labels`` (zip, unit_id): all labelled nodes, edges inside a unit only."""
    edges = with_fact(with_fact(g.edges, labels, "src", {"unit_id": "_a"}), labels, "dst", {"unit_id": "_b"})
    edges = edges.filter("_a = _b").select("src", "dst", "weight")
    return Graph(labels.select("zip"), edges)


