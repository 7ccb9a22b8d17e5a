"""Scores of a partition: separation, contiguity, stability, summaries."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import uniform
from ..functions.vectors import mean_vector, square_distance
from ..schema import all_finite, require_columns
from ..session import materialise
from .blocks import against, matrix
from .graph import Graph, components, within_label

#: Most centroids compared in one broadcast; more are taken in several passes.
CENTROIDS = 4096


def label_counts(df: DataFrame) -> DataFrame:
    """(unit_id, n) of a labelled table."""
    return df.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"))


def quality_guard(vectors: DataFrame) -> str | None:
    """Why metrics are undefined for (zip, vector, unit_id): ``non-finite``, ``one cluster`` or ``singleton``; else None.

    Any non-finite component, fewer than two clusters, or any cluster of one
    member makes them NaN. One aggregate.
    """
    if not vectors.filter(~F.coalesce(all_finite(F.col("vector")), F.lit(False))).isEmpty():
        return "non-finite"
    r = label_counts(vectors).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).first()
    return "one cluster" if r.k < 2 else "singleton" if r.least == 1 else None


def sample(df: DataFrame, n: int, seed: int, key: str = "zip") -> DataFrame:
    """Exactly min(n, rows) rows, the first by a random number of (seed, key): any partitioning gives the same."""
    return df.orderBy(uniform(seed, "sample", F.col(key)), key).limit(n)


def silhouette_samples(vectors: DataFrame, max_samples: int | None = 10_000, random_state: int = 42, chunk: int = 10_000) -> DataFrame:
    """(zip, unit_id, a, b, silhouette) of the sampled rows of (zip, vector, unit_id), of all rows if ``max_samples`` is None.

    a is the mean distance to the other members, b the smallest mean distance to
    another cluster, silhouette (b - a) / max(a, b); 0 for a member alone in the
    sample or if both are 0. The rows are compared with each other in blocks
    against broadcasts of about ``chunk`` vectors; between these each row
    carries its sum of distances to every cluster.
    """
    rows = vectors.select("zip", "vector", "unit_id")
    chosen = materialise((rows if max_samples is None else sample(rows, max_samples, random_state)).withColumn("h", F.pmod(F.xxhash64("zip"), F.lit(1 << 30))), "sample")
    size = {str(r.unit_id): r.n for r in label_counts(chosen).collect()}
    if not size:
        return chosen.selectExpr("zip", "unit_id", "0D AS a", "0D AS b", "0D AS silhouette")
    units, n = np.array(sorted(size)), sum(size.values())
    passes = -(-n // chunk)
    kinds = dict(chosen.dtypes)
    key = f"zip {kinds['zip']}, unit_id {kinds['unit_id']}"
    state = chosen.repartition(max(1, n // 1000 + 1), "zip").withColumn("sums", F.array_repeat(F.lit(0.0), len(units)))

    def add(part: pa.RecordBatch, d: np.ndarray, m: dict) -> list:
        sums = matrix(part.column("sums")) + d @ m["member"]
        return [part.column("zip"), part.column("unit_id"), part.column("vector"), pa.array(list(sums), pa.list_(pa.float64()))]

    def score(part: pa.RecordBatch, d: np.ndarray, m: dict) -> list:
        own = np.searchsorted(m["units"], np.array([str(u) for u in part.column("unit_id").to_pylist()]))
        sums = matrix(part.column("sums")) + d @ m["member"]
        i = np.arange(len(own))
        n = m["size"][own]
        a = sums[i, own] / np.maximum(n - 1, 1)
        mean = sums / m["size"]
        mean[i, own] = np.inf
        b = mean.min(1)
        s = np.where((n > 1) & (np.maximum(a, b) > 0) & np.isfinite(b), (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
        return [part.column("zip"), part.column("unit_id"), a, b, s]

    for turn in range(passes):
        part = chosen.filter(F.pmod("h", F.lit(passes)) == turn).orderBy("zip").collect()
        x = np.array([r.vector for r in part], float)
        if not part:
            x = np.zeros((0, len(chosen.select("vector").first().vector)))
        member = np.zeros((len(part), len(units)))
        member[np.arange(len(part)), np.searchsorted(units, np.array([str(r.unit_id) for r in part], dtype=units.dtype))] = 1.0
        extra = {"units": units, "member": member, "size": np.array([size[u] for u in units.tolist()])}
        if turn == passes - 1:
            return against(state, x, extra, score, f"{key}, a double, b double, silhouette double")
        state = against(state, x, extra, add, f"{key}, vector {kinds['vector']}, sums array<double>")
        if turn % 8 == 7:
            state = materialise(state, "sums")


def davies_bouldin(vectors: DataFrame) -> DataFrame:
    """One row (davies_bouldin): mean over clusters of the worst (s_i + s_j) / |c_i - c_j|.

    s is the mean distance to the centroid. 0 if all spreads or all gaps are
    about 0; a single zero gap counts as infinite. Centroids meet in blocks, at
    most CENTROIDS per pass.
    """
    first = vectors.select(F.size("vector").alias("d")).first()
    dims = first.d if first else 0
    centres = materialise(vectors.groupBy("unit_id").agg(mean_vector("vector", dims).alias("c")), "centres")
    spread = vectors.join(centres, "unit_id").groupBy("unit_id").agg(F.avg(F.sqrt(square_distance(F.col("vector"), F.col("c")))).alias("s"))
    both = materialise(centres.join(spread, "unit_id").select("unit_id", F.col("c").alias("vector"), "s", F.pmod(F.xxhash64("unit_id"), F.lit(1 << 30)).alias("h")), "centres")
    passes = -(-both.count() // CENTROIDS)
    worst = None
    for i in range(passes):
        part = both.filter(F.pmod("h", F.lit(passes)) == i).collect()
        if not part:
            continue
        extra = {"s": np.array([r.s for r in part]), "id": np.array([str(r.unit_id) for r in part])}

        def score(p: pa.RecordBatch, d: np.ndarray, m: dict) -> list:
            s = p.column("s").to_numpy()
            same = np.array([str(u) for u in p.column("unit_id").to_pylist()])[:, None] == m["id"][None]
            ratio = np.where(same | (d == 0), 0.0, (s[:, None] + m["s"][None]) / np.where(d == 0, np.inf, d))
            return [pa.array([str(u) for u in p.column("unit_id").to_pylist()]), ratio.max(1), np.where(same, 0.0, d).max(1), s]

        one = against(both, np.array([r.vector for r in part]), extra, score, "unit string, worst double, gap double, s double")
        worst = one if worst is None else worst.unionByName(one)
    if worst is None:
        return vectors.sparkSession.createDataFrame([(float("nan"),)], "davies_bouldin double")
    per = worst.groupBy("unit").agg(F.max("worst").alias("worst"), F.max("gap").alias("gap"), F.max("s").alias("s"))
    flat = (F.max("s") < 1e-8) | (F.max("gap") < 1e-8)
    return per.agg(F.when(flat, 0.0).otherwise(F.avg("worst")).alias("davies_bouldin"))


def quality_scores(vectors: DataFrame, max_samples: int = 10_000, random_state: int = 42) -> dict[str, float]:
    """{silhouette, davies_bouldin} of (zip, vector, unit_id); both NaN where ``quality_guard`` objects."""
    require_columns(vectors, "zip", "vector", "unit_id")
    if quality_guard(vectors):
        return {"silhouette": math.nan, "davies_bouldin": math.nan}
    s = silhouette_samples(vectors, max_samples, random_state).agg(F.avg("silhouette")).first()[0]
    return {"silhouette": s, "davies_bouldin": davies_bouldin(vectors).first()[0]}


def contiguity(labels: DataFrame, g: Graph) -> DataFrame:
    """(unit_id, n_zips, n_components) of each unit's induced subgraph; labels is (zip, unit_id)."""
    found = components(within_label(g, labels)).join(labels, "zip")
    return found.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_zips"), F.count_distinct("component").alias("n_components"))


def contiguity_score(labels: DataFrame, g: Graph) -> dict[str, float]:
    """{connected_fraction, violating_clusters, n_clusters}; without clusters the fraction is 1.

    ValueError if a labelled zip is not in the graph or the other way round.
    """
    lacking = labels.select("zip").join(g.nodes.select("zip"), "zip", "left_anti")
    if not lacking.isEmpty() or labels.select("zip").distinct().count() != g.nodes.count():
        raise ValueError("labels and graph must name the same zips")
    r = contiguity(labels, g).agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum((F.col("n_components") > 1).cast("bigint")), F.lit(0)).alias("bad")).first()
    return {"connected_fraction": 1.0 if not r.k else (r.k - r.bad) / r.k, "violating_clusters": r.bad, "n_clusters": r.k}


def pair_confusion(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (n, tp, fp, fn, tn) of ordered pairs of zips by co-membership in a and b (zip, unit_id).

    From the contingency table alone: no pair is formed. Exact decimals.
    """
    met = a.select("zip", F.col("unit_id").alias("a")).join(b.select("zip", F.col("unit_id").alias("b")), "zip")
    cells = met.groupBy("a", "b").agg(F.count(F.lit(1)).cast("decimal(19,0)").alias("n"))
    square = lambda df, k: df.groupBy(k).agg(F.sum("n").cast("decimal(19,0)").alias("n")).agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).cast("decimal(38,0)").alias("v"))
    one = cells.agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).cast("decimal(38,0)").alias("both"), F.coalesce(F.sum("n"), F.lit(0)).cast("decimal(19,0)").alias("n"))
    r, ra, rb = one.first(), square(cells, "a").first(), square(cells, "b").first()
    n, both, sa, sb = int(r.n), int(r.both), int(ra.v), int(rb.v)
    row = (n, both - n, sa - both, sb - both, n * n - sa - sb + both)
    return a.sparkSession.createDataFrame([tuple(map(int, row))], "n bigint, tp bigint, fp bigint, fn bigint, tn bigint") if max(map(abs, row)) < 2**63 else a.sparkSession.createDataFrame([tuple(map(str, row))], "n string, tp string, fp string, fn string, tn string").select(*[F.col(c).cast("decimal(38,0)").alias(c) for c in ("n", "tp", "fp", "fn", "tn")])


def partition_stability(a: DataFrame, b: DataFrame) -> dict[str, float]:
    """{ari, jaccard} of two assignments (zip, unit_id) of the same zips; ValueError otherwise."""
    if a.count() != b.count() or not a.select("zip").join(b.select("zip"), "zip", "left_anti").isEmpty():
        raise ValueError("the partitions must assign the same zips")
    r = pair_confusion(a, b).first()
    n_, tp, fp, fn, tn = (int(v) for v in r)
    ari = 1.0 if fp == 0 and fn == 0 else 2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))
    return {"ari": ari, "jaccard": 1.0 if tp + fp + fn == 0 else tp / (tp + fp + fn)}


def cluster_summary(mapping: DataFrame, df: DataFrame, sum_attrs: list[str] | None = None, handle_nan_attrs: bool = True) -> DataFrame:
    """(unit_id, n_zips, *sums) by unit, ordered: one join, one aggregate.

    Every mapped zip must be in ``df`` (ValueError naming up to five that are
    not); zips listed twice in ``df`` count twice. NULL and NaN attributes are
    skipped; a unit with none gets NULL with ``handle_nan_attrs``, else 0. Zips
    without a unit form no row.
    """
    attrs = sum_attrs or []
    require_columns(mapping, "zip", "unit_id")
    require_columns(df, "zip", *attrs)
    lost = [r.zip for r in mapping.join(df.select("zip"), "zip", "left_anti").select("zip").distinct().orderBy("zip").limit(6).collect()]
    if lost:
        raise ValueError(f"zips without attributes: {lost[:5]}{' ...' if len(lost) > 5 else ''}")
    kinds = dict(df.dtypes)
    value = lambda c: F.nanvl(F.col(c), F.lit(None)) if kinds[c] in ("double", "float") else F.col(c)
    total = lambda c: F.sum(value(c)) if handle_nan_attrs else F.coalesce(F.sum(value(c)), F.lit(0))
    met = mapping.filter("unit_id IS NOT NULL").select("zip", "unit_id").join(df.select("zip", *attrs), "zip")
    return met.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_zips"), *[total(c).alias(c) for c in attrs]).orderBy("unit_id")
