"""Mixing sources to target weights by Poisson replication.

Every document gets a uniform number from a hash of its id and text; the Poisson
distribution with its source's rate, inverted at that number and capped, says
how often it is used. So a document's count depends on nothing but itself and
the plan, and any task can compute it again.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level vocabulary's texts are cut before merging (fixed public pattern).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_SOURCES = 1000
#: About as many characters of one text are handed to the tokenizer at once.
PIECE = 1 << 17
#: Places where PATTERN ends a match whatever stands around them: where a run of letters, of digits or of other signs than blanks is over.
BREAK = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=\S)(?=\s)")


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    """Tokens of a whole text. A long one is handed over in pieces, cut only where no token can reach across, so the count is that of the text at once."""
    encode, n, at = _encoder(path).encode_ordinary, 0, 0
    while len(text) - at > PIECE:
        found = BREAK.search(text, at + PIECE)
        if found is None:
            break
        n, at = n + len(encode(text[at : found.start()])), found.start()
    return n + len(encode(text[at:]))


def plain_source(source: Column) -> Column:
    """Lower case, trimmed, other signs than letters and digits as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(source), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def uniform(seed: int) -> Column:
    """A number in [0, 1) from a hash of (seed, doc_id, text)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 11).cast("double") / float(1 << 53)


def sizes(documents: DataFrame, seed: int = 1, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, u, n_tokens) of every document with a text, written to the shared folder."""
    rows = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("u", pa.float64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([count_tokens(t, tokenizer) for t in b.column(3).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), n], schema=rows)

    picked = documents.filter("text IS NOT NULL").select(F.col("doc_id").cast("bigint"), plain_source(F.col("source")).alias("source"), uniform(seed).alias("u"), "text")
    return materialise(picked.mapInArrow(run, "doc_id bigint, source string, u double, n_tokens bigint"), "sizes")


@dataclass(frozen=True)
class Share:
    source: str
    target_share: float
    max_repeats: int
    tokens: int  # of the source's documents
    wanted: float  # tokens wanted from it
    cuts: tuple[float, ...]  # a document is used at least k + 1 times if u >= cuts[k]


def _cuts(rate: float, most: int) -> tuple[float, ...]:
    """P(X <= 0), P(X <= 1), ... of the Poisson distribution, at most ``most`` of them."""
    if rate <= 0:
        return ()
    if math.isinf(rate):
        return (0.0,) * most
    term = below = math.exp(-rate)
    out = []
    for k in range(1, most + 1):
        if below >= 1.0 - 2.0**-53:
            break
        out.append(below)
        term *= rate / k
        below += term
    return tuple(out)


def _realised(bins: dict[int, int], n_bins: int, rate: float, most: int) -> int:
    """Tokens that the capped Poisson counts of the documents give at a rate."""
    cuts = _cuts(rate, most)
    return sum(t * sum(1 for c in cuts if (b + 0.5) / n_bins >= c) for b, t in bins.items())


def _rate(bins: dict[int, int], n_bins: int, wanted: float, most: int) -> float:
    """The Poisson rate at which the capped counts of the documents give ``wanted`` tokens.

    Realised tokens grow with the rate, so bisection finds it; a source wanted
    to its limit or beyond is used ``most`` times throughout.
    """
    have = sum(bins.values())
    if wanted >= have * most:
        return math.inf
    low, high = 0.0, 700.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if _realised(bins, n_bins, mid, most) < wanted else (low, mid)
    return (low + high) / 2


def plan(sized: DataFrame, targets: DataFrame, total_tokens: float | None = None, n_bins: int = 2048) -> list[Share]:
    """What each source of ``targets`` is to give.

    Shares count over the sources that have documents (a source without any
    cannot give its share; the others keep their proportions). ``total_tokens``
    is the size of the mixture; by default the largest at which every source
    reaches its share at a Poisson rate of at most its max_repeats, so that each
    source's counts are drawn, that of the scarcest too. A larger total is met
    by higher rates, up to every document max_repeats times; a source that
    cannot give what is wanted gives all it may. Only (source, bin of u) sums reach the driver:
    ``n_bins`` rows for each of at most MOST_SOURCES sources. Targets with a NULL
    or repeated name, no positive share or no repeats are left out.
    """
    known = targets.filter("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").select(plain_source(F.col("source")).alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int"))
    wanted = known.groupBy("source").agg(F.first("target_share").alias("s"), F.first("max_repeats").alias("m"), F.count(F.lit(1)).alias("n")).filter("n = 1").limit(MOST_SOURCES + 1).collect()
    if len(wanted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources to mix")
    names = [r.source for r in wanted]
    binned = sized.filter(F.col("source").isin(names)).groupBy("source", F.floor(F.col("u") * n_bins).alias("bin")).agg(F.sum("n_tokens").alias("t"))
    bins: dict[str, dict[int, int]] = {n: {} for n in names}
    for r in binned.collect():
        bins[r.source][r.bin] = r.t
    have = {r.source: sum(bins[r.source].values()) for r in wanted}
    full = sum(r.s for r in wanted if have[r.source])
    total = total_tokens
    if total is None:
        total = min((_realised(bins[r.source], n_bins, r.m, r.m) * full / r.s for r in wanted if have[r.source]), default=0.0)
    out = []
    for r in sorted(wanted, key=lambda r: r.source):
        want = total * r.s / full if have[r.source] else 0.0
        rate = _rate(bins[r.source], n_bins, want, r.m) if want else 0.0
        out.append(Share(r.source, r.s, r.m, have[r.source], want, _cuts(rate, r.m)))
    return out


def _planned(rows: DataFrame, shares: list[Share]) -> DataFrame:
    """Adds copies; the plan has at most MOST_SOURCES rows and is broadcast."""
    small = rows.sparkSession.createDataFrame([(s.source, list(s.cuts)) for s in shares], "source string, _cuts array<double>")
    used = F.size(F.filter("_cuts", lambda c: c <= F.col("u")))
    return rows.join(F.broadcast(small), "source").withColumn("copies", used).filter("copies > 0").drop("_cuts")


def mixture(documents: DataFrame, shares: list[Share], seed: int = 1) -> DataFrame:
    """(shuffle_key, doc_id, source, copy, text): the mixed corpus, globally shuffled.

    Rows are dealt to partitions and ordered in them by a hash of (document,
    copy). Documents of sources outside the plan and NULL texts are not used.
    """
    rows = documents.filter("text IS NOT NULL").select("doc_id", plain_source(F.col("source")).alias("source"), uniform(seed).alias("u"), "text")
    copies = _planned(rows, shares).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    keyed = copies.select(F.xxhash64(F.lit(seed + 1), "doc_id", "u", "copy").alias("shuffle_key"), "doc_id", "source", "copy", "text")
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def shares_report(sized: DataFrame, shares: list[Share]) -> DataFrame:
    """(source, target_share, max_repeats, source_tokens, n_docs_used, most_copies, tokens, actual_share), one row per planned source."""
    per = _planned(sized, shares).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs_used"), F.max("copies").alias("most_copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens")).collect()
    got = {r.source: r for r in per}
    total = sum(r.tokens for r in per)
    rows = []
    for s in shares:
        r = got.get(s.source)
        rows.append((s.source, s.target_share, s.max_repeats, s.tokens, r.n_docs_used if r else 0, r.most_copies if r else 0, r.tokens if r else 0, (r.tokens / total if total else 0.0) if r else 0.0))
    return sized.sparkSession.createDataFrame(rows, "source string, target_share double, max_repeats int, source_tokens bigint, n_docs_used bigint, most_copies int, tokens bigint, actual_share double")
