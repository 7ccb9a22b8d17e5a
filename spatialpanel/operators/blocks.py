"""All rows against a bounded set of vectors, in blocks, without a join."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def matrix(column: pa.Array) -> np.ndarray:
    """(rows, dims) from an Arrow list column of equal lengths without NULLs."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, by differences in slices: no cancellation, bounded memory."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        out[i : i + step] = np.sqrt(((a[i : i + step, None, :] - b[None]) ** 2).sum(-1))
    return out


def against(rows: DataFrame, others: np.ndarray, extra: dict[str, np.ndarray], score: Callable, schema: str, block: int = 512) -> DataFrame:
    """``rows`` (key, label, vector, ...) with ``score(batch, distances, extra)`` per block of rows.

    ``others`` is broadcast; the caller has bounded it. ``score`` returns the
    output columns in the order of ``schema``.
    """
    sent = rows.sparkSession.sparkContext.broadcast((others, extra))
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, more = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                d = distances(matrix(part.column("vector")), b)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in score(part, d, more)], names=names)

    return rows.mapInArrow(run, schema)
