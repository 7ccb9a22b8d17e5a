"""Losses over vectors in tables, as one-row aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import square_distance, unit
from ..session import materialise
from .blocks import matrix

#: Most vectors of a batch or memory bank that are broadcast.
MOST_VECTORS = 65_536
#: Rows compared with all of them at once: 512 x 65,536 similarities are 268 MB.
BLOCK = 512


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def mse(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row (loss): mean squared difference of two array columns of equal sizes (else the query fails)."""
    same = pairs.withColumn("_ok", F.assert_true(F.size(a) == F.size(b), "vectors differ in size")).filter("_ok IS NULL")
    sums = same.agg(F.sum(square_distance(F.col(a), F.col(b))).alias("s"), F.sum(F.size(a)).alias("n"))
    return sums.select(F.try_divide("s", F.col("n").cast("double")).alias("loss"))


reconstruction_loss = mse
predictive_loss = mse


def _vectors(df: DataFrame, cols: list[str]) -> list[np.ndarray]:
    rows = df.select(*cols).limit(MOST_VECTORS + 1).collect()
    if len(rows) > MOST_VECTORS:
        raise ValueError(f"more than {MOST_VECTORS} vectors in a batch")
    return [np.array([r[c] for r in rows], float) for c in cols]


def nt_xent(pairs: DataFrame, key: str, a: str, b: str, temperature: float = 0.1) -> DataFrame:
    """One row (loss): contrastive loss of positive pairs (key, a, b) within one batch.

    The 2B unit vectors are compared with each other in blocks; a vector's loss
    is ln(exp(p) + sum over all others of exp(s)) - p, p the similarity to its
    partner - which so counts twice below, as in the original (B = 1 gives ln 2).
    A batch has at most MOST_VECTORS / 2 pairs; it is what is broadcast.
    """
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    va, vb = F.transform(a, lambda x: x.cast("double")), F.transform(b, lambda x: x.cast("double"))
    both = pairs.select(F.col(key).cast("string").alias("key"), F.explode(F.array(F.struct(F.lit(0).alias("side"), unit(va).alias("vector")), F.struct(F.lit(1).alias("side"), unit(vb).alias("vector")))).alias("v")).select("key", "v.side", "v.vector")
    views = materialise(both, "views")
    rows = views.orderBy("key", "side").limit(MOST_VECTORS + 1).collect()
    if len(rows) > MOST_VECTORS:
        raise ValueError(f"more than {MOST_VECTORS // 2} pairs in a batch")
    z = np.array([r.vector for r in rows], float)
    name = np.array([f"{r.key}|{r.side}" for r in rows])
    sent = views.sparkSession.sparkContext.broadcast((z, name, np.argsort(name)))

    def score(batches):
        z, name, order = sent.value
        for batch in _slices(batches):
            keys, sides = batch.column("key").to_pylist(), batch.column("side").to_pylist()
            find = lambda names: order[np.searchsorted(name, names, sorter=order)]
            own, other = find([f"{k}|{s}" for k, s in zip(keys, sides)]), find([f"{k}|{1 - s}" for k, s in zip(keys, sides)])
            s = matrix(batch.column("vector")) @ z.T / temperature
            i = np.arange(len(own))
            p = s[i, other]
            s[i, own] = -np.inf
            top = s.max(1)
            loss = np.log(np.exp(p - top) + np.exp(s - top[:, None]).sum(1)) + top - p
            yield pa.RecordBatch.from_arrays([pa.array(loss)], names=["loss"])

    return views.mapInArrow(score, "loss double").agg(F.avg("loss").alias("loss"))


def new_bank(spark: SparkSession, dims: int, size: int = 4096, seed: int = 0) -> DataFrame:
    """(slot, vec): a memory bank of random unit vectors from a seeded generator."""
    v = np.random.default_rng(seed).normal(size=(size, dims))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "slot int, vec array<double>")


def bank_loss(pairs: DataFrame, bank: DataFrame, a: str, b: str, temperature: float = 0.1) -> DataFrame:
    """One row (loss): InfoNCE of positive pairs against the bank's vectors, the mean of both views.

    The bank has at most MOST_VECTORS slots and is broadcast.
    """
    rows = _vectors(bank.orderBy("slot"), ["vec"])[0]
    spread = pairs.sparkSession.sparkContext.broadcast(rows)
    doubles = [F.transform(c, lambda x: x.cast("double")) for c in (a, b)]
    units = pairs.select(unit(doubles[0]).alias("a"), unit(doubles[1]).alias("b"))

    def score(batches):
        m = spread.value
        for batch in _slices(batches):
            za, zb = matrix(batch.column("a")), matrix(batch.column("b"))
            p = (za * zb).sum(1) / temperature
            out = []
            for z in (za, zb):
                s = np.concatenate([p[:, None], z @ m.T / temperature], axis=1)
                top = s.max(1)
                out.append(np.log(np.exp(s - top[:, None]).sum(1)) + top - p)
            yield pa.RecordBatch.from_arrays([pa.array((out[0] + out[1]) / 2)], names=["loss"])

    return units.mapInArrow(score, "loss double").agg(F.avg("loss").alias("loss"))


def bank_update(bank: DataFrame, batch: DataFrame, pointer: int, size: int) -> tuple[DataFrame, int]:
    """The ring buffer after writing ``batch`` (pos, vec) from slot ``pointer`` on, and the new pointer.

    pos counts the batch's rows from 0. Of more than ``size`` rows the last ones stay.
    """
    n = batch.count()
    kept = batch.filter(F.col("pos") >= n - size)
    new = kept.select(F.pmod(F.col("pos") + pointer, F.lit(size)).cast("int").alias("slot"), unit(F.transform("vec", lambda x: x.cast("double"))).alias("vec"))
    old = bank.join(new.select("slot"), "slot", "left_anti")
    return old.unionByName(new), (pointer + n) % size


def weighted_sum(parts: dict[str, DataFrame], weights: dict[str, float]) -> float:
    """Sum of the one-row losses by weight."""
    return float(sum(weights.get(k, 1.0) * df.first()["loss"] for k, df in parts.items()))


