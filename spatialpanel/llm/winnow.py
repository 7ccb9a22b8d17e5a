"""Test passages leaking into a corpus, found by winnowing.

Of every ``span - k + 1`` consecutive word k-grams the one with the smallest hash
is kept (all of them on a tie). A passage of ``span`` words shared by two texts
is such a window in both, so both keep its minimum: joining the kept
fingerprints misses no shared span. Hits are then extended word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import salted
from ..session import materialise
from .hashing import byte_table, grams, text_bytes, words

WORDS = byte_table()


def selected(h: np.ndarray, doc: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the k-grams that winnowing keeps; windows never cross texts."""
    g = grams(h, k)
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    width = span - k + 1
    low = g[:n].copy()
    for i in range(1, width):
        np.minimum(low, g[i : n + i], out=low)
    whole = doc[:n] == doc[span - 1 :]
    keep = np.zeros(len(g), bool)
    for i in range(width):
        keep[i : n + i] |= whole & (g[i : n + i] == low)
    at = np.flatnonzero(keep)
    return at, g[at]


def fingerprints(texts: DataFrame, key: str, text: str, k: int = 5, span: int = 12, probe: np.ndarray | None = None) -> DataFrame:
    """(key, fp, before, gram, after): kept k-grams with the words around them.

    ``before`` has up to span - k words, nearest first, ``after`` likewise; enough
    to extend a hit to any span that holds it. ``probe`` (sorted hashes) keeps
    only fingerprints that occur in it. Texts are read whole; NULL or short texts
    (under ``span`` words) have none.
    """
    kind = texts.schema[key].dataType.simpleString()
    reach = span - k
    spread = texts.sparkSession.sparkContext.broadcast(probe) if probe is not None else None
    rows = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("before", pa.list_(pa.string())), ("gram", pa.string()), ("after", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = spread.value if spread is not None else None
        for batch in batches:
            keys = batch.column(0)
            raw, offsets = text_bytes(batch.column(1))
            start, end, h, doc = words(raw, offsets, WORDS)
            at, g = selected(h, doc, k, span)
            if wanted is not None:
                place = np.minimum(np.searchsorted(wanted, g), max(len(wanted) - 1, 0))
                hit = wanted[place] == g if len(wanted) else np.zeros(len(g), bool)
                at, g = at[hit], g[hit]
            lower = raw.tobytes()
            word = lambda i: lower[start[i] : end[i]].lower().decode()
            for a in range(0, len(at), 20_000):
                before, gram, after = [], [], []
                part = at[a : a + 20_000]
                for p in part.tolist():
                    lo = p
                    while lo > 0 and p - lo < reach and doc[lo - 1] == doc[p]:
                        lo -= 1
                    hi = p + k
                    while hi < len(doc) and hi - p - k < reach and doc[hi] == doc[p]:
                        hi += 1
                    before.append([word(i) for i in range(p - 1, lo - 1, -1)])
                    gram.append(" ".join(word(i) for i in range(p, p + k)))
                    after.append([word(i) for i in range(p + k, hi)])
                cols = [keys.take(pa.array(doc[part])).cast(pa.int64()), pa.array(g[a : a + 20_000].view(np.int64)), pa.array(before, rows.field(2).type), pa.array(gram, pa.string()), pa.array(after, rows.field(4).type)]
                yield pa.RecordBatch.from_arrays(cols, schema=rows)

    if kind not in ("bigint", "int"):
        raise ValueError(f"{key} must be an integer key")
    picked = texts.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint"), text)
    found = picked.mapInArrow(run, "key bigint, fp bigint, before array<string>, gram string, after array<string>")
    return found.withColumnRenamed("key", key)


def _shared(a: Column, b: Column) -> Column:
    """Number of leading elements two arrays share."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(differs == 0, F.greatest(F.size(a), F.size(b))).otherwise(differs.cast("int") - 1)


def leaks(corpus: DataFrame, tests: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", k: int = 5, span: int = 12, probe_rows: int = 4_000_000, context_rows: int = 100_000) -> DataFrame:
    """(doc, item): every corpus text holding at least ``span`` consecutive words of a test text.

    Words are maximal runs of ASCII letters and digits, compared without case.
    The test side's distinct fingerprints are counted; up to ``probe_rows``
    (32 MB) of them are broadcast, so the corpus emits hits only and is not
    shuffled. Beyond that all kept fingerprints are joined by shuffle, with the
    same result. The test words around the fingerprints are broadcast if they are
    at most ``context_rows`` rows, else the hits are shuffled to them. Keys are integers; repeated ids are treated as one text's parts
    would be: a leak of any row counts.
    """
    own = materialise(fingerprints(tests.select(item, text), item, text, k, span), "test-prints")
    distinct = own.select("fp").distinct()
    probe = None
    if distinct.count() <= probe_rows:
        probe = np.sort(np.array([r.fp for r in distinct.toLocalIterator()], np.int64).view(np.uint64))
    hits = fingerprints(corpus.select(doc, text), doc, text, k, span, probe)
    theirs = own.select(F.col(item), "fp", "gram", F.col("before").alias("_before"), F.col("after").alias("_after"))
    if own.count() <= context_rows:
        met = hits.join(F.broadcast(theirs), ["fp", "gram"])
    else:  # a passage that very many texts hold is dealt over several tasks
        many, few = salted(hits, theirs, ["fp", "gram"], least=100_000)
        met = many.join(few, ["fp", "gram", "_salt"])
    length = F.lit(k) + _shared(F.col("before"), F.col("_before")) + _shared(F.col("after"), F.col("_after"))
    return met.filter(length >= span).select(doc, item).distinct()
