"""Implausible readings: a hidden Markov model per source plus hard bounds.

States: normal, spike, stuck, out of range. A reading's deviation is log2 of its
value over the median of the 31 in-range readings around it, so weekly rhythm,
busy weeks and lasting changes of level stay small; its scale is the source's own
(upper quartile of the absolute deviations of all its readings), so a quiet source is judged more
strictly than a noisy one. Forward-backward gives each state's probability.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.times import day_number
from ..session import materialise
from .skew import join_group_facts, percentiles

NORMAL, SPIKE, STUCK, OUT = range(4)


@dataclass(frozen=True)
class SpikeModel:
    """Parameters; the deviation at which a lone reading turns into a spike is
    about ``reach`` * (``floor`` + the source's upper quartile of |deviation|)."""

    low: float = 0.0  # values below are impossible
    high: float = 5e6  # values above are impossible for any source
    run: int = 6  # equal consecutive values that count as stuck
    half_window: int = 15
    floor: float = 0.1
    reach: float = 4.4
    z: float = 4.1  # the same deviation in standard deviations of the normal state
    to_spike: float = 0.01
    stay_spike: float = 0.1
    stay_stuck: float = 0.9
    equal: float = 0.03  # how often an ordinary value equals a neighbour
    held: float = 0.999  # how often a stuck one does
    to_out: float = 0.005
    stay_out: float = 0.1
    spike_density: float = 1 / 24  # uniform over 12 doublings either way
    block: int = 4096  # readings of a source judged together
    context: int = 256  # readings of the neighbouring blocks seen with them

    def moves(self) -> np.ndarray:
        """Transition probabilities. A run of equal values turns from normal to stuck between run - 1 and run values: that sets how seldom a source gets stuck."""
        stay, turn = 1 - self.to_spike - self.to_out, self.run - 0.5
        to_stuck = stay ** (turn + 1) / ((self.held / self.equal) ** turn * self.stay_stuck ** (turn - 1) * (1 - self.stay_stuck))
        move = np.array([[stay - to_stuck, self.to_spike, to_stuck, self.to_out], [1 - self.stay_spike, self.stay_spike, 0, 0], [1 - self.stay_stuck, 0, self.stay_stuck, 0], [1 - self.stay_out, 0, 0, self.stay_out]])
        move[SPIKE:, :] = 0.999 * move[SPIKE:, :] + 0.001 * move[NORMAL]
        return move


def _local_median(x: np.ndarray, group: np.ndarray, half: int) -> np.ndarray:
    """Median of up to 2 * half + 1 values around each, within its group (sorted by group)."""
    if not len(x):
        return x
    pad = np.full(half, np.nan)
    values = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, x, pad]), 2 * half + 1)
    groups = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, group, pad]), 2 * half + 1)
    ordered = np.sort(np.where(groups == group[:, None], values, np.nan), axis=1)
    n = np.sum(~np.isnan(ordered), axis=1)
    i = np.arange(len(x))
    return (ordered[i, (n - 1) // 2] + ordered[i, n // 2]) / 2


def _runs(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Length of the run of equal consecutive values each value belongs to."""
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (group[1:] != group[:-1])
    run = np.cumsum(new) - 1
    return np.bincount(run)[run]


def _forward_backward(emission: np.ndarray, linked: np.ndarray, lengths: np.ndarray, m: SpikeModel) -> np.ndarray:
    """Posterior (G, T, 4) of sequences padded to T; vectorised over the sequences.

    Only a value equal to the one before (``linked``) can be stuck with it; else
    a new run begins, as likely as after a normal reading. A sequence begins and
    ends as if normal readings stood around it.
    """
    n, steps, k = emission.shape
    move = m.moves()
    lost = (move[STUCK, STUCK] - move[STUCK, NORMAL] * move[NORMAL, STUCK] / move[NORMAL, NORMAL]) * (1.0 - linked)
    a = np.empty_like(emission)
    now = np.tile(move[NORMAL], (n, 1))
    for t in range(steps):
        if t:
            held = now[:, STUCK] * lost[:, t]
            now = now @ move
            now[:, STUCK] -= held
        now = now * emission[:, t]
        now /= now.sum(1, keepdims=True)
        a[:, t] = now
    b = np.tile(move[:, NORMAL], (n, 1))
    a[:, steps - 1] *= b
    for t in range(steps - 2, -1, -1):
        after = b * emission[:, t + 1]
        b = after @ move.T
        b[:, STUCK] -= after[:, STUCK] * lost[:, t + 1]
        b /= b.sum(1, keepdims=True)
        b[lengths <= t + 1] = move[:, NORMAL]
        a[:, t] *= b
    return a / a.sum(2, keepdims=True)


def deviations(value: np.ndarray, group: np.ndarray, m: SpikeModel) -> tuple[np.ndarray, np.ndarray]:
    """(out of range, deviation) of values ordered by group and time."""
    out = ~((value >= m.low) & (value <= m.high))
    level = np.log2(np.maximum(np.where(out, 1.0, value), 1e-3))
    inside = np.flatnonzero(~out)
    deviation = np.zeros(len(value))
    deviation[inside] = level[inside] - _local_median(level[inside], group[inside].astype(float), m.half_window)
    return out, deviation


def judge(value: np.ndarray, group: np.ndarray, m: SpikeModel, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior (n, 4), run length, deviation) of values ordered by group and time; group counts from 0.

    ``known`` has each group's quartile where it is part of a larger source, else NaN.
    """
    out, deviation = deviations(value, group, m)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    lengths = np.diff(np.r_[starts, len(group)])
    known = np.full(len(starts), np.nan) if known is None else known
    quartile = np.array([k if k == k else np.quantile(q, 0.75) if len(q := np.abs(deviation[s : s + n])[~out[s : s + n]]) else 0.0 for s, n, k in zip(starts, lengths, known)])
    sigma = (m.reach / m.z * (m.floor + quartile))[group]
    runs = _runs(value, group)
    same = runs > 1
    dense = np.exp(-0.5 * np.minimum((deviation / sigma) ** 2, 400.0)) / (sigma * np.sqrt(2 * np.pi))
    e = np.empty((len(value), 4))
    e[:, NORMAL] = dense * np.where(same, m.equal, 1 - m.equal)
    e[:, SPIKE] = m.spike_density * np.where(same, m.equal, 1 - m.equal)
    e[:, STUCK] = dense * np.where(same, m.held, 1 - m.held)
    e[:, OUT] = 1e-12
    e[out] = (1e-12, 1e-12, 1e-12, 1.0)
    e = np.maximum(e, 1e-90)
    padded = np.ones((len(lengths), lengths.max(), 4))
    at = np.arange(len(value)) - starts[group]
    padded[group, at] = e
    linked = np.zeros(padded.shape[:2])
    linked[group, at] = np.r_[False, (value[1:] == value[:-1]) & (group[1:] == group[:-1])] if len(value) else 0.0
    return _forward_backward(padded, linked, lengths, m)[group, at], runs, deviation


SCHEMA = "geo_id string, reading_id bigint, value double, deviation double, p_normal double, p_spike double, p_stuck double, p_out double, flag string"


def _groups(t: pa.Table) -> np.ndarray:
    """Number, from 0, of the (geo_id, block) of each row."""
    geo = t["geo_id"].combine_chunks()
    block = t["block"].to_numpy()
    new = np.ones(len(block), bool)
    new[1:] = (block[1:] != block[:-1]) | pc.not_equal(geo[1:], geo[:-1]).to_numpy(zero_copy_only=False)
    return np.cumsum(new) - 1


def _flagger(m: SpikeModel) -> Callable[[pa.Table], pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def score(t: pa.Table) -> pa.RecordBatch:
        group = _groups(t)
        value = t["value"].to_numpy()
        known = t["quartile"].to_numpy()[np.flatnonzero(np.r_[True, group[1:] != group[:-1]])]
        posterior, runs, deviation = judge(value, group, m, known)
        flag = np.where(posterior[:, SPIKE] > 0.5, "spike", None)
        flag = np.where((posterior[:, STUCK] > 0.5) | (runs >= m.run), "stuck", flag)
        flag = np.where((posterior[:, OUT] > 0.5) | ~((value >= m.low) & (value <= m.high)), "out_of_range", flag)
        cols = [t["geo_id"].combine_chunks(), t["reading_id"].combine_chunks(), pa.array(value), pa.array(deviation), *[pa.array(posterior[:, k]) for k in range(4)], pa.array(flag, pa.string())]
        core = t["core"].combine_chunks()
        return pa.RecordBatch.from_arrays([c.filter(core) for c in cols], names=names)

    return score


def _deviator(m: SpikeModel) -> Callable[[pa.Table], pa.RecordBatch]:
    """(geo_id, size): the absolute deviations of the blocks' own in-range readings."""

    def score(t: pa.Table) -> pa.RecordBatch:
        out, deviation = deviations(t["value"].to_numpy(), _groups(t), m)
        own = pc.and_(t["core"].combine_chunks(), pa.array(~out))
        return pa.RecordBatch.from_arrays([t["geo_id"].combine_chunks().filter(own), pa.array(np.abs(deviation)).filter(own)], names=["geo_id", "size"])

    return score


def _whole_groups(score: Callable[[pa.Table], pa.RecordBatch]):
    """``score`` over batches of rows sorted by (geo_id, block), no group torn apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < 60_000:
                continue
            t = pa.Table.from_batches(held)
            last = pc.and_(pc.equal(t["geo_id"], t["geo_id"][-1]), pc.equal(t["block"], t["block"][-1]))
            cut = t.num_rows - pc.sum(last).as_py()  # the last group may go on
            if cut:
                yield score(t.slice(0, cut))
            held, rows = t.slice(cut).to_batches(), t.num_rows - cut
        if rows:
            yield score(pa.Table.from_batches(held))

    return run


def _quartiles(parts: DataFrame, sizes: DataFrame, m: SpikeModel) -> DataFrame:
    """``sizes`` (geo_id, n) with the upper quartile of |deviation| over all of a source's blocks, as np.quantile has it."""
    size = _sorted(parts).mapInArrow(_whole_groups(_deviator(m)), "geo_id string, size double")
    at = lambda n: (n - 1) * F.lit(0.75)
    q = percentiles(size, "geo_id", "size", {"_lo": lambda n: F.floor(at(n)) + 1, "_hi": lambda n: F.ceil(at(n)) + 1})
    here = at(F.col("n_rows"))
    q = q.select("geo_id", (F.col("_lo") + (here - F.floor(here)) * (F.col("_hi") - F.col("_lo"))).alias("quartile"))
    return sizes.join(q, "geo_id", "left").select("geo_id", "n", F.coalesce("quartile", F.lit(0.0)).alias("quartile"))


def _sorted(parts: DataFrame) -> DataFrame:
    ordered = parts.repartition("geo_id", "block").sortWithinPartitions("geo_id", "block", "date")
    return ordered.select("geo_id", "block", "reading_id", "value", "core", "quartile")


def flag_readings(readings: DataFrame, value: str = "spend", model: SpikeModel | None = None, broadcast_rows: int = 200_000) -> DataFrame:
    """Every reading with its deviation, state probabilities and flag.

    ``readings`` is (geo_id, date, reading_id, value) with unique (geo_id, date)
    and no NULL or NaN values, as ``usable_readings`` gives. flag is the state
    whose probability is over one half, none for normal; the hard bounds stand
    above the model: a value outside [low, high] is ``out_of_range``, one in a run
    of at least ``run`` equal consecutive values is ``stuck`` whatever else it
    may be. The model is set so that it calls shorter runs normal by itself. A
    source with a single reading has deviation 0.

    A source is judged in blocks of ``block`` consecutive readings, each seen
    with ``context`` readings either side, so a source of any size is spread
    over many tasks and no group exceeds block + 2 * context rows; its scale is
    the quartile over all its blocks, taken first. Only sources
    with more than one block need positions; their days are broadcast if at most
    ``broadcast_rows`` rows, and shuffled beyond that.
    """
    m = model or SpikeModel()
    rows = materialise(readings.select("geo_id", "date", "reading_id", F.col(value).cast("double").alias("value")), "readings").withColumn("_day", day_number(F.col("date")))
    w = Window.partitionBy("geo_id")
    days = rows.groupBy("geo_id", "_day").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(w.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    large = days.select("geo_id", "_day", before.alias("_before"), F.sum("_n").over(w).alias("_all")).filter(F.col("_all") > m.block)
    n_large = large.count()
    sizes = large.groupBy("geo_id").agg(F.max("_all").alias("n"))
    large = large.drop("_all")
    if n_large <= broadcast_rows:
        large = F.broadcast(large)
    placed = rows.join(large, ["geo_id", "_day"], "left")
    unknown = F.lit(float("nan")).alias("quartile")
    small = placed.filter("_before IS NULL").select("geo_id", F.lit(0).cast("bigint").alias("block"), "date", "reading_id", "value", F.lit(True).alias("core"), unknown)
    if not n_large:
        return _sorted(small).mapInArrow(_whole_groups(_flagger(m)), SCHEMA)
    rank = F.row_number().over(Window.partitionBy("geo_id", "_day").orderBy("date", "reading_id"))
    blocks = F.sequence(F.expr(f"greatest(_pos - {m.context}, 0L) div {m.block}"), F.expr(f"(_pos + {m.context}) div {m.block}"))
    parts = placed.filter("_before IS NOT NULL").withColumn("_pos", F.col("_before") + rank - 1).withColumn("block", F.explode(blocks))
    parts = parts.select("geo_id", "block", "date", "reading_id", "value", (F.expr(f"_pos div {m.block}") == F.col("block")).alias("core"))
    parts = materialise(parts, "parts")
    known = materialise(_quartiles(parts.withColumn("quartile", F.lit(float("nan"))), sizes, m), "quartiles")
    parts = join_group_facts(parts, known, "geo_id", "n", parts.count()).drop("n")
    return _sorted(small.unionByName(parts)).mapInArrow(_whole_groups(_flagger(m)), SCHEMA)
