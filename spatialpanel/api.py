"""The public operators in one place.

Tables go in and come out as DataFrames keyed by zip or geo_id; metrics come out
as dicts or one-row tables. Names follow what the operators do.
"""

from __future__ import annotations

from .operators.augment import AugmentationLogger, augment, augmented_pair, crop, get_augmentation_logger, jitter, mask
from .operators.encoder import EncoderConfig, encode, fit, graph_layer, load_params, params_frame, temporal_features, validation_losses
from .operators.graph import Graph, align_graph, components, contiguity_graph, extra_nodes, knn_graph, missing_nodes, mobility_graph, node_strength, radius_graph
from .operators.losses import bank_loss, bank_update, mse, new_bank, nt_xent, predictive_loss, reconstruction_loss, weighted_sum
from .operators.metrics import cluster_summary, contiguity_score, davies_bouldin, pair_confusion, partition_stability, quality_guard, quality_scores, silhouette_samples
from .operators.panel import autoregressive_windows, convolve, convolve_channels, dense_series, horizon_split, item, sliding_windows, temporal_split, unstack_targets
from .operators.regionalize import SkaterConfig, louvain, modularity, relabel, run_skater, select_best, spanning_forest, spectral_clusters
from .operators.skew import heavy_keys, join_group_facts, latest_version, percentiles, profiles, two_sided
from .operators.spatial import near_pairs, points_in_regions, triangulate
from .operators.spikes import SpikeModel, flag_readings
from .operators.synth import lattice_grid, make_embeddings
from .operators.timegrid import daily_totals, regular_grid, rolling_totals, usable_readings
from .schema import from_wide, to_wide
from .session import clear_written, discard, materialise
from .sources.shapefile import polygons_shp, write_shp
from .sources.tables import edges_csv, polygons, table, write

__all__ = [n for n in dir() if not n.startswith("_") and n != "annotations"]


def adjacency(points, method: str = "knn", k: int = 8, radius: float | None = None) -> Graph:
    """The symmetric neighbour graph of (geo_id, latitude, longitude): ``knn`` or ``radius``."""
    if method == "knn":
        return knn_graph(points, k)
    if method == "radius" and radius is not None:
        return radius_graph(points, radius)
    raise ValueError("method must be knn, or radius with a radius")


def evaluate_units(assignments: dict, vectors, graph: Graph):
    """One row per method (method, silhouette, davies_bouldin, connected_fraction, n_clusters).

    ``assignments`` maps a method's name to (zip, unit_id), ``vectors`` is (zip, vector).
    """
    rows = []
    for name, units in assignments.items():
        labelled = materialise(vectors.join(units, "zip"), "labelled")
        q, c = quality_scores(labelled), contiguity_score(units, graph)
        rows.append((name, q["silhouette"], q["davies_bouldin"], float(c["connected_fraction"]), c["n_clusters"]))
        discard(labelled)
    return vectors.sparkSession.createDataFrame(rows, "method string, silhouette double, davies_bouldin double, connected_fraction double, n_clusters bigint")


def clear_caches(spark, written: bool = False) -> None:
    """Drops everything that was persisted, with ``written`` also the intermediates in the shared folder."""
    spark.catalog.clearCache()
    if written:
        clear_written(spark)
