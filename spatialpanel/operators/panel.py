"""Panels as series: densify, split, cut into windows, convolve."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import total
from ..schema import PANEL_KEYS, feature_columns
from ..session import materialise
from .blocks import matrix

MOST_DATES = 1_000_000


def dense_series(panel: DataFrame, geo: str = PANEL_KEYS[0], date: str = PANEL_KEYS[1]) -> DataFrame:
    """(geo, feature, xs ARRAY<DOUBLE>): one series per geo and feature over all observed dates.

    The axis are the distinct dates of the whole panel, ascending (calendar gaps
    are not filled); a missing cell and a NULL or NaN value are 0. ValueError for
    an empty panel, no features, NULL keys or a repeated (geo, date).

    The panel is read once, folded by (geo, date) and written; one aggregate by
    date over that gives the axis and all checks. A geo's rows (now at most one
    per date) are then gathered and scattered into its series in Arrow batches:
    the work is proportional to rows and result, and no geo meets all dates.
    """
    features = feature_columns(panel, (geo, date))
    value = lambda f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None)), F.lit(0.0))
    folded = panel.groupBy(geo, date).agg(F.count(F.lit(1)).alias("_n"), F.first(F.array(*[value(f) for f in features])).alias("_v"))
    cells = materialise(folded.select(F.col(geo).alias("_g"), F.col(date).alias("_d"), "_n", "_v"), "panel")
    per = cells.groupBy("_d").agg(F.max("_n").alias("most"), F.max(F.col("_g").isNull()).alias("no_geo")).limit(MOST_DATES + 1).collect()
    if not per:
        raise ValueError("the panel is empty")
    if any(r["_d"] is None or r.most > 1 or r.no_geo for r in per):
        raise ValueError("NULL or repeated (geo, date)")
    if len(per) > MOST_DATES:
        raise ValueError(f"more than {MOST_DATES} dates")
    axis_rows = sorted(r["_d"] for r in per)
    kind, steps = panel.schema[date].dataType.simpleString(), len(axis_rows)
    axis = panel.sparkSession.createDataFrame(list(enumerate(axis_rows)), f"_i int, _d {kind}")
    gathered = cells.join(F.broadcast(axis), "_d").groupBy("_g").agg(F.collect_list(F.struct("_i", "_v")).alias("_c"))
    at_once = max(1, 2_000_000 // (steps * len(features)))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)
                listed = part.column(1)
                row = np.repeat(np.arange(len(listed)), np.diff(listed.offsets.to_numpy()))
                entries = listed.flatten()
                x = np.zeros((len(listed), len(features), steps))
                x[row, :, entries.field("_i").to_numpy()] = matrix(entries.field("_v"))
                each = np.arange(len(listed) * len(features))
                series = pa.ListArray.from_arrays(pa.array(np.arange(len(each) + 1) * steps, pa.int32()), pa.array(x.ravel()))
                names = pa.array(features).take(pa.array(each % len(features)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(each // len(features))), names, series], names=["_g", "feature", "xs"])

    out = gathered.mapInArrow(scatter, f"_g {panel.schema[geo].dataType.simpleString()}, feature string, xs array<double>")
    return out.withColumnRenamed("_g", geo)


def horizon_split(series: DataFrame, horizon: int, column: str = "xs") -> DataFrame:
    """Adds ``input`` and ``target``: all but the last ``horizon`` steps, and those. 0 < horizon < length."""
    size = F.size(column)
    ok = F.assert_true((F.lit(horizon) > 0) & (F.lit(horizon) < size), "horizon must lie between 0 and the length")
    cut = series.withColumn("_ok", ok).filter("_ok IS NULL").drop("_ok")
    return cut.withColumn("input", F.slice(column, F.lit(1), size - horizon)).withColumn("target", F.slice(column, size - horizon + 1, F.lit(horizon)))


def temporal_split(series: DataFrame, input_len: int, target_len: int, overlap: bool = False, column: str = "xs") -> DataFrame:
    """Adds ``input`` (the first input_len steps) and ``target``.

    The target are the next target_len steps, or with ``overlap`` the last ones
    of the series. A series too short for input_len + target_len fails the query
    without overlap; with overlap each part must fit by itself.
    """
    if input_len <= 0 or target_len <= 0:
        raise ValueError("lengths must be positive")
    size = F.size(column)
    need = max(input_len, target_len) if overlap else input_len + target_len
    cut = series.withColumn("_ok", F.assert_true(size >= need, "series too short")).filter("_ok IS NULL").drop("_ok")
    start = size - target_len + 1 if overlap else F.lit(input_len + 1)
    return cut.withColumn("input", F.slice(column, 1, input_len)).withColumn("target", F.slice(column, start, F.lit(target_len)))


def window_count(length: int, window: int, stride: int) -> int:
    """Windows that fit: with P = length - window + 1 start places, (P - 1) // stride + 1.

    ValueError if window or stride is not positive, if no window fits, or if
    stride >= P > 1 (kept from the original behaviour, although one would fit).
    """
    if window <= 0 or stride <= 0:
        raise ValueError("window and stride must be positive")
    places = length - window + 1
    if places <= 0:
        raise ValueError("the window is longer than the series")
    if stride >= places > 1:
        raise ValueError("the stride leaves no second window")
    return (places - 1) // stride + 1


def _length(series: DataFrame, column: str) -> int:
    r = series.agg(F.min(F.size(column)).alias("a"), F.max(F.size(column)).alias("b")).first()
    if r.a is None or r.a != r.b:
        raise ValueError("series must exist and be equally long")
    return r.a


def sliding_windows(series: DataFrame, window: int, stride: int = 1, column: str = "xs") -> DataFrame:
    """One row per window, with window_idx, start_pos and ``window``; incomplete tails are dropped."""
    n = window_count(_length(series, column), window, stride)
    return series.withColumn("window_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("start_pos", F.col("window_idx") * stride).withColumn("window", F.slice(column, F.col("start_pos") + 1, F.lit(window)))


def autoregressive_windows(series: DataFrame, input_len: int, target_len: int = 1, stride: int = 1, column: str = "xs") -> DataFrame:
    """One row per window with window_idx, start_pos, input, target (FLOAT arrays) and the half-open ranges
    input_from/input_to and target_from/target_to; windows of input_len + target_len steps, geo by geo."""
    n = window_count(_length(series, column), input_len + target_len, stride)
    out = series.withColumn("window_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("start_pos", F.col("window_idx") * stride)
    s = F.col("start_pos")
    return out.select(
        *[c for c in series.columns if c != column],
        "window_idx",
        "start_pos",
        s.alias("input_from"),
        (s + input_len).alias("input_to"),
        (s + input_len).alias("target_from"),
        (s + input_len + target_len).alias("target_to"),
        F.slice(column, s + 1, F.lit(input_len)).cast("array<float>").alias("input"),
        F.slice(column, s + input_len + 1, F.lit(target_len)).cast("array<float>").alias("target"),
    )


def unstack_targets(windows: DataFrame, geo: str = PANEL_KEYS[0], feature: str = "feature") -> DataFrame:
    """(geo, window_idx, step, targets): per step the vector over features, in feature order."""
    steps = windows.select(geo, feature, "window_idx", F.posexplode("target").alias("step", "x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(feature, "x"))), lambda s: s["x"])
    return steps.groupBy(geo, "window_idx", "step").agg(ordered.alias("targets"))


def item(windows: DataFrame, positions: DataFrame, idx: int, per_geo: int, geo: str = PANEL_KEYS[0]) -> DataFrame:
    """The window of number ``idx``: geo_pos = idx // per_geo, window_idx = idx % per_geo. positions is (geo, geo_pos)."""
    if idx < 0:
        raise IndexError("negative window number")
    at = windows.join(positions.filter(F.col("geo_pos") == idx // per_geo), geo).filter(F.col("window_idx") == idx % per_geo)
    if at.isEmpty():
        raise IndexError(f"no window {idx}")
    return at


def convolve(xs: Column, kernel: list[float]) -> Column:
    """Cross-correlation with zero padding of k // 2 on both sides; an even k gives one step more."""
    k, pad = len(kernel), len(kernel) // 2
    weights = F.array(*[F.lit(float(w)) for w in kernel])
    steps = F.sequence(F.lit(0), F.size(xs) + 2 * pad - k)
    at = lambda t: F.zip_with(weights, F.sequence(F.lit(0), F.lit(k - 1)), lambda w, j: w * F.coalesce(F.when(t + j - pad >= 0, F.get(xs, t + j - pad)), F.lit(0.0)))
    return F.transform(steps, lambda t: total(at(t)))


def convolve_channels(series: DataFrame, kernels: list[list[list[float]]], bias: list[float], features: list[str], geo: str = PANEL_KEYS[0], column: str = "xs") -> DataFrame:
    """(geo, channel, ys): multi-channel convolution; kernels[out][in] over ``features`` in that order.

    A geo's features are brought together once; its channels are then sums of
    arrays in place. A feature that a geo lacks adds nothing; a geo with none of
    them has no rows.
    """
    picks = [F.first(F.when(F.col("feature") == f, F.col(column)), ignorenulls=True).alias(f"_f{i}") for i, f in enumerate(features)]
    wide = series.filter(F.col("feature").isin(features)).groupBy(geo).agg(*picks)
    longest = F.greatest(F.lit(0), *[F.coalesce(F.size(f"_f{i}"), F.lit(0)) for i in range(len(features))])
    wide = wide.withColumn("_n", longest).select(geo, *[F.coalesce(F.col(f"_f{i}"), F.array_repeat(F.lit(0.0), F.col("_n"))).alias(f"_f{i}") for i in range(len(features))])
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))
    shifted = lambda ys, b: F.transform(ys, lambda y: y + F.lit(b))
    outs = []
    for o, per_in in enumerate(kernels):
        parts = [convolve(F.col(f"_f{i}"), k) for i, k in enumerate(per_in)]
        outs.append(F.struct(F.lit(o).alias("channel"), shifted(reduce(plus, parts), float(bias[o])).alias("ys")))
    return wide.select(geo, F.explode(F.array(*outs)).alias("o")).select(geo, "o.channel", "o.ys")
