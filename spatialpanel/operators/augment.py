"""Augmentation of series columns (ARRAY<DOUBLE>), reproducible per row key."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import integer, normal, uniform

MODES = ("random", "contiguous")


def jitter(xs: Column, key: Column, noise_std: float = 0.01, seed: int = 0, stream: str = "jitter") -> Column:
    """x + noise_std * N(0, 1) per step; 0 changes nothing, a negative value is an error."""
    if noise_std < 0:
        raise ValueError("noise_std must not be negative")
    return F.transform(xs, lambda x, i: x + F.lit(noise_std) * normal(seed, stream, key, i)) if noise_std else xs


def mask(xs: Column, key: Column, mask_prob: float = 0.1, mask_value: float = 0.0, mask_mode: str = "random", seed: int = 0, stream: str = "mask") -> Column:
    """Steps replaced by ``mask_value``: each with probability mask_prob (``random``), or one
    block of max(1, int(T * mask_prob)) steps at a uniform start per series (``contiguous``; none at 0)."""
    if not 0 <= mask_prob <= 1:
        raise ValueError("mask_prob must lie in [0, 1]")
    if mask_mode not in MODES:
        raise ValueError(f"mask_mode must be one of {MODES}")
    if mask_prob == 0:
        return xs
    value = F.lit(float(mask_value))
    if mask_mode == "random":
        return F.transform(xs, lambda x, i: F.when(uniform(seed, stream, key, i) < mask_prob, value).otherwise(x))
    block = F.greatest(F.lit(1), F.floor(F.size(xs) * F.lit(mask_prob)).cast("int"))
    start = integer(seed, stream, F.size(xs) - block + 1, key)
    return bind(F.struct(start.alias("a"), (start + block).alias("b")), lambda m: F.transform(xs, lambda x, i: F.when((i >= m["a"]) & (i < m["b"]), value).otherwise(x)))


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once per row, also where ``then`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def resample(xs: Column, length: Column, start: Column | None = None, part: Column | None = None) -> Column:
    """Linear resampling of the ``part`` steps from ``start`` on (default: all) to ``length`` steps.

    Both ends are kept: step t reads place t * (part - 1) / (length - 1).
    """
    at = F.struct((F.lit(0) if start is None else start).cast("int").alias("s"), ((F.size(xs) if part is None else part) - 1).cast("int").alias("last"), length.cast("int").alias("n"))

    def steps(m: Column) -> Column:
        place = lambda t: F.when(m["n"] > 1, t.cast("double") * m["last"] / F.greatest(m["n"] - 1, F.lit(1))).otherwise(F.lit(0.0))
        low = lambda t: F.least(F.floor(place(t)).cast("int"), m["last"])
        value = lambda i: F.get(xs, m["s"] + i)
        return F.transform(F.sequence(F.lit(0), m["n"] - 1), lambda t: value(low(t)) + (value(F.least(low(t) + 1, m["last"])) - value(low(t))) * (place(t) - low(t)))

    return bind(at, steps)


def crop(xs: Column, crop_ratio: float = 0.8, seed: int = 0, stream: str = "crop") -> Column:
    """A part of int(T * crop_ratio) steps stretched back to T; one start for all series of a length.

    A ratio of 1, or a part of fewer than two or of all T steps, changes nothing.
    """
    if not 0 < crop_ratio <= 1:
        raise ValueError("crop_ratio must lie in (0, 1]")
    if crop_ratio == 1:
        return xs
    size = F.size(xs)
    part = F.floor(size * F.lit(crop_ratio)).cast("int")
    start = integer(seed, stream, F.greatest(size - part + 1, F.lit(1)), F.lit("start"))
    return F.when((part >= 2) & (part < size), resample(xs, size, start, part)).otherwise(xs)


class AugmentationLogger:
    """A log of augmentations on the driver, readable as a table."""

    def __init__(self) -> None:
        self._entries: list[dict] = []

    def log_augmentation(self, method: str, params: dict, input_shape: list[int] | Callable[[], list[int]], output_shape: list[int] | Callable[[], list[int]]) -> None:
        """Append an entry. A shape may be a function: it is asked when the log is first read, so that logging runs no job."""
        self._entries.append({"method": method, "params": {k: str(v) for k, v in params.items()}, "input_shape": input_shape, "output_shape": output_shape})

    def get_logs(self, last: int | None = None) -> list[dict]:
        """A copy of the log, or of its ``last`` entries."""
        found = self._entries[-last:] if last else self._entries if last is None else []
        for e in found:
            for k in ("input_shape", "output_shape"):
                e[k] = list(e[k]() if callable(e[k]) else e[k])
        return [dict(e) for e in found]

    def clear_logs(self) -> None:
        self._entries.clear()

    def to_frame(self, spark: SparkSession, last: int | None = None) -> DataFrame:
        rows = [(e["method"], e["params"], e["input_shape"], e["output_shape"]) for e in self.get_logs(last)]
        return spark.createDataFrame(rows, "method string, params map<string,string>, input_shape array<int>, output_shape array<int>")


def _shape(df: DataFrame, column: str) -> Callable[[], list[int]]:
    """[series, steps of the longest], found once when asked."""

    @lru_cache(maxsize=1)
    def find() -> list[int]:
        r = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(column)).alias("t")).first()
        return [r.n, r.t or 0]

    return find


_LOGGER = AugmentationLogger()
METHODS = {"jitter": ("noise_std",), "mask": ("mask_prob", "mask_value", "mask_mode"), "crop": ("crop_ratio",)}


def get_augmentation_logger() -> AugmentationLogger:
    return _LOGGER


def augment(df: DataFrame, method: str, key: str, column: str = "xs", out: str | None = None, seed: int = 0, stream: str | None = None, **params) -> DataFrame:
    """``column`` augmented by ``jitter``, ``mask`` or ``crop`` into ``out``; parameters of other methods are ignored."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    used = {k: v for k, v in params.items() if k in METHODS[method]}
    xs, name = F.col(column), stream or method
    if method == "jitter":
        new = jitter(xs, F.col(key), seed=seed, stream=name, **used)
    elif method == "mask":
        new = mask(xs, F.col(key), seed=seed, stream=name, **used)
    else:
        new = crop(xs, seed=seed, stream=name, **used)
    if not (method == "crop" and used.get("crop_ratio") == 1):
        shape = _shape(df, column)  # no method changes the number or the length of series
        _LOGGER.log_augmentation(method, used, shape, shape)
    return df.withColumn(out or column, new)


def augmented_pair(df: DataFrame, key: str, column: str = "xs", aug1_method: str = "jitter", aug2_method: str = "crop", seed: int = 0, **params) -> DataFrame:
    """Adds ``view1`` and ``view2`` from the same column and independent streams.

    Parameters carry their method's name as prefix, e.g. ``mask_mask_prob``.
    """
    own = lambda m: {k[len(m) + 1 :]: v for k, v in params.items() if k.startswith(m + "_")}
    one = augment(df, aug1_method, key, column, "view1", seed, "view1", **own(aug1_method))
    return augment(one, aug2_method, key, column, "view2", seed, "view2", **own(aug2_method))


#: The two views of a contrastive loss where nothing else is said.
DEFAULT_VIEWS = {"aug1_method": "jitter", "aug2_method": "crop", "jitter_noise_std": 0.01, "crop_crop_ratio": 0.8}


def augmented_array(x: np.ndarray, method: str, rng: np.random.Generator, noise_std: float = 0.01, mask_prob: float = 0.1, mask_value: float = 0.0, mask_mode: str = "random", crop_ratio: float = 0.8) -> np.ndarray:
    """A training block (geos, channels, steps) augmented as ``augment`` does columns, from numpy's generator."""
    steps = x.shape[-1]
    if method == "jitter":
        return x + noise_std * rng.normal(size=x.shape)
    if method == "mask":
        if mask_mode == "random":
            return np.where(rng.random(x.shape) < mask_prob, mask_value, x)
        size = max(1, int(steps * mask_prob)) if mask_prob else 0
        start = rng.integers(0, steps - size + 1, x.shape[:-1])[..., None]
        at = np.arange(steps)
        return np.where((at >= start) & (at < start + size), mask_value, x)
    if method != "crop":
        raise ValueError(f"unknown method {method!r}")
    part = int(steps * crop_ratio)
    if not 2 <= part < steps:
        return x
    place = int(rng.integers(0, steps - part + 1)) + np.arange(steps) * (part - 1) / (steps - 1)
    low = np.floor(place).astype(int)
    high = np.minimum(low + 1, steps - 1)
    return x[..., low] + (x[..., high] - x[..., low]) * (place - low)


def array_pair(x: np.ndarray, rng: np.random.Generator, aug1_method: str = "jitter", aug2_method: str = "crop", **params) -> list[np.ndarray]:
    """Both views of a training block; parameters carry their method's name as prefix."""
    own = lambda m: {k[len(m) + 1 :]: v for k, v in params.items() if k.startswith(m + "_")}
    return [augmented_array(x, m, rng, **own(m)) for m in (aug1_method, aug2_method)]
