"""Irregular readings onto a regular grid, and rolling totals over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.times import DAY_US, day_number, micros
from .skew import latest_version

#: The period of the panel (fixed values).
PANEL_FROM, PANEL_TO = "2024-01-01", "2024-05-30"


def usable_readings(timeseries: DataFrame, keep: list[str]) -> DataFrame:
    """Standing, usable rows of the panel as (geo_id, date, reading_id, *keep).

    Valid rows have a geo_id and a date inside the period; of equal (geo_id,
    date) the latest received stands; it is usable if its spend is neither NULL
    nor NaN. Usability is judged after standing: a withdrawn value withdraws.
    """
    valid = timeseries.filter(F.col("geo_id").isNotNull() & (F.col("date") >= F.lit(PANEL_FROM).cast("timestamp_ntz")) & (F.col("date") < F.lit(PANEL_TO).cast("timestamp_ntz")))
    standing = latest_version(valid, ["geo_id", "date"], ["received_at", "reading_id"], ["spend", *keep])
    rest = [c for c in dict.fromkeys(keep) if c not in ("geo_id", "date", "reading_id")]
    return standing.filter(F.col("spend").isNotNull() & ~F.isnan("spend")).select("geo_id", "date", "reading_id", *rest)


def _explode_span(df: DataFrame, count: Column, name: str) -> DataFrame:
    """One row per 0 .. count-1, in two steps so that no array exceeds a few thousand entries."""
    block = 2048
    outer = df.withColumn("_count", count).withColumn("_block", F.explode(F.sequence(F.lit(0), ((F.col("_count") - 1) / block).cast("bigint"))))
    first = F.col("_block") * block
    return outer.withColumn(name, F.explode(F.sequence(first, F.least(first + (block - 1), F.col("_count") - 1)))).drop("_count", "_block")


def regular_grid(df: DataFrame, key: str, time: str, value: str, step_us: int = DAY_US, gap_us: int = 3 * DAY_US, offset_us: int | None = None) -> DataFrame:
    """As-of merge of a regular grid with irregular readings, by key.

    Cell c of a key spans [c * step, (c + 1) * step) since 1970-01-01; its grid
    instant lies ``offset_us`` after the cell's start (default: the middle).
    Output: (key, cell, n_readings, value, status), one row per cell from the
    key's first to its last reading.

    value: linear between the nearest reading at or before the instant and the
    nearest at or after it, weighted by time, if they lie at most ``gap_us``
    apart; with a neighbour on one side only (ends) that neighbour's value, if
    at most ``gap_us`` away; otherwise NULL. Of readings at the same time the
    largest value counts before, the smallest after.
    status: ``observed`` (the cell has a reading), ``interpolated`` or ``gap``.

    Rows with NULL key, time or value or NaN value are no readings; a key
    without readings has no rows; repeated rows change only n_readings.

    Plan: readings are first reduced per (key, cell) with map-side combine to the
    four readings that can be neighbours, which is exact and bounds a key's
    rows by its number of cells; only these go through the per-key window.
    """
    offset = step_us // 2 if offset_us is None else offset_us
    t, c = F.col("_t"), F.col("_cell")
    rows = df.select(F.col(key).alias("_key"), micros(F.col(time)).alias("_t"), F.col(value).cast("double").alias("_v"))
    rows = rows.filter(F.col("_key").isNotNull() & t.isNotNull() & F.col("_v").isNotNull() & ~F.isnan("_v"))
    rows = rows.withColumn("_cell", F.expr(f"(_t - pmod(_t, {step_us}L)) div {step_us}L"))
    at = c * step_us + offset
    pair = F.struct(t.alias("t"), F.col("_v").alias("v"))
    cells = rows.groupBy("_key", "_cell").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(pair).alias("_first"),
        F.max(pair).alias("_last"),
        F.max(F.when(t <= at, pair)).alias("_before"),
        F.min(F.when(t >= at, pair)).alias("_after"),
    )
    w = Window.partitionBy("_key").orderBy("_cell")
    linked = cells.select(
        "*", F.lead("_cell").over(w).alias("_next_cell"), F.lead("_first").over(w).alias("_next_first"), F.lag("_last").over(w).alias("_prev_last")
    )
    span = F.coalesce(F.col("_next_cell") - c, F.lit(1))
    filled = _explode_span(linked, span, "_i")
    own = F.col("_i") == 0
    merged = filled.select(
        F.col("_key").alias(key),
        (c + F.col("_i")).alias("cell"),
        F.when(own, F.col("_n")).otherwise(0).alias("n_readings"),
        F.when(own, F.coalesce("_before", "_prev_last")).otherwise(F.col("_last")).alias("_p"),
        F.when(own, F.coalesce("_after", "_next_first")).otherwise(F.col("_next_first")).alias("_q"),
    )
    here = F.col("cell") * step_us + offset
    p, q = F.col("_p"), F.col("_q")
    gap = q["t"] - p["t"]
    both = F.when(gap == 0, p["v"]).when(gap <= gap_us, p["v"] + (q["v"] - p["v"]) * ((here - p["t"]).cast("double") / gap.cast("double")))
    one = F.when(q.isNull() & (here - p["t"] <= gap_us), p["v"]).when(p.isNull() & (q["t"] - here <= gap_us), q["v"])
    out = merged.withColumn("value", F.when(p.isNotNull() & q.isNotNull(), both).otherwise(one))
    status = F.when(F.col("n_readings") > 0, "observed").when(F.col("value").isNotNull(), "interpolated").otherwise("gap")
    return out.select(key, "cell", "n_readings", "value", status.alias("status"))


def daily_totals(readings: DataFrame, key: str, time: str, measures: list[str]) -> DataFrame:
    """(key, day, *measures) summed per calendar day; NULL measures count 0.

    Doubles are summed as DECIMAL(38,6), so sums do not depend on the order of
    rows and prefix differences do not cancel. ``<m>_lost`` counts values that
    do not fit (infinite or beyond 10^22).
    """
    kinds = dict(readings.dtypes)
    aggs = []
    for m in measures:
        if kinds[m] in ("double", "float"):
            exact = F.expr(f"try_cast(nanvl(`{m}`, NULL) AS DECIMAL(28,6))")
            aggs += [F.coalesce(F.sum(exact), F.lit(0)).cast("decimal(38,6)").alias(m), F.sum(F.when(F.col(m).isNotNull() & ~F.isnan(m) & exact.isNull(), 1).otherwise(0)).alias(f"{m}_lost")]
        else:
            aggs += [F.coalesce(F.sum(m), F.lit(0)).alias(m)]
    keyed = readings.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn("day", day_number(F.col(time)).cast("bigint"))
    return keyed.groupBy(key, "day").agg(*aggs)


def rolling_totals(daily: DataFrame, key: str, measures: list[str], periods: list[int]) -> DataFrame:
    """Totals and daily averages over the trailing ``periods`` (in days), idle days included.

    ``daily`` is (key, day BIGINT, *measures), one row per key and active day.
    Output: (key, day, day_index, total_<m>_<p>, avg_<m>_<p>) for every day
    from the key's first to its last active day. day_index counts from 0; before
    p days have passed the average divides by the days so far. A window that
    holds a value lost to overflow has NULL totals.

    Plan: prefix sums per key, carried forward over idle days by giving them
    zero; a total is prefix(day) - prefix(day - p), so its cost does not depend
    on p. One shuffle by key; a key has at most one row per calendar day.
    """
    w = Window.partitionBy(key).orderBy("day")
    lost = [f"{m}_lost" for m in measures if f"{m}_lost" in daily.columns]
    names = [*measures, *lost]
    gaps = daily.select(key, "day", *names, F.coalesce(F.lead("day").over(w) - F.col("day"), F.lit(1)).alias("_span"))
    dense = _explode_span(gaps, F.col("_span"), "_i")
    own = F.col("_i") == 0
    dense = dense.select(key, (F.col("day") + F.col("_i")).alias("day"), *[F.when(own, F.col(m)).otherwise(F.lit(0).cast(daily.schema[m].dataType)).alias(m) for m in names])
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    prefix = dense.select(key, "day", (F.row_number().over(w) - 1).alias("day_index"), *[F.sum(m).over(run).alias(m) for m in names])
    exact = {m: F.col(m) if m not in [x[:-5] for x in lost] else F.col(m).cast("decimal(38,6)") for m in measures}
    out = []
    for m in measures:
        for p in periods:
            total = exact[m] - F.coalesce(F.lag(m, p).over(w), F.lit(0).cast(daily.schema[m].dataType))
            if f"{m}_lost" in lost:
                clean = F.col(f"{m}_lost") == F.coalesce(F.lag(f"{m}_lost", p).over(w), F.lit(0))
                total = F.when(clean, total).cast("double")
            out += [total.alias(f"total_{m}_{p}"), (total.cast("double") / F.least(F.lit(p), F.col("day_index") + 1)).alias(f"avg_{m}_{p}")]
    return prefix.select(key, "day", "day_index", *out)
