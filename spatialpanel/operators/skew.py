"""Work by key when a few keys hold most rows.

Value-frequency compression: rows are grouped by (key, value) before they are
grouped by key. The first grouping spreads a hot key over all tasks (and
combines map-side); what is left for the key itself are weighted values, from
which counts, modes and percentiles follow exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import materialise

#: A key with at least this share of all rows is hot; so at most 1000 keys are.
HOT_SHARE = 0.001


def latest_version(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """Of rows with equal ``keys`` the one largest by ``order``.

    Partial aggregation folds copies map-side, so a group of copies of any size
    costs one row per map task. NULL sorts lowest; full ties fall to ``keep``.
    """
    keep = [c for c in dict.fromkeys(keep) if c not in keys and c not in order]
    best = F.max(F.struct(*order, *keep)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}") for c in (*order, *keep)])


def join_group_facts(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row of ``facts`` per key, safe for hot keys.

    ``facts`` has one row per key and, in ``size``, how many of the ``total``
    rows carry the key. Keys with at least HOT_SHARE of the rows are broadcast:
    there are at most 1 / HOT_SHARE = 1000 of them whatever the data. The rows
    they match are given a spread-out key for the shuffled join of the rest, so
    no task gets a hot key. NULL keys match nothing.
    """
    least = max(2, int(total * HOT_SHARE))
    names = [c for c in facts.columns if c != key]
    hot = facts.filter(F.col(size) >= least).select(F.col(key).alias("_hot"), F.struct(*names).alias("_hot_facts"))
    cold = facts.filter(F.col(size) < least).select(F.col(key).alias("_cold"), F.struct(*names).alias("_cold_facts"))
    kind = rows.schema[key].dataType
    spread = F.xxhash64(*[F.col(c) for c in rows.columns if c != key]).cast(kind)
    if isinstance(kind, T.StringType):
        spread = F.concat(F.lit("\x00"), spread)
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn(
        "_probe", F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), spread).otherwise(F.col(key))
    )
    found = F.coalesce("_hot_facts", "_cold_facts")
    both = marked.join(cold, F.col("_probe") == F.col("_cold"), "left").withColumn(
        "_facts", F.when(F.col("_hot").isNotNull(), F.col("_hot_facts")).when(F.col(key).isNotNull(), found)
    )
    return both.filter(F.col("_facts").isNotNull()).select(*rows.columns, *[F.col(f"_facts.{c}").alias(c) for c in names])


def salted(many: DataFrame, few: DataFrame, on: list[str], total: int | None = None, least: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Both tables with a column ``_salt``, to be joined on [*on, "_salt"] with the result of a join on ``on``.

    A key with more than ``least`` rows of ``many`` is dealt over as many salts
    as it takes to have at most about that many in each; its rows of ``few`` are
    repeated for every salt. With ``total``, the rows of ``many``, ``least`` is
    HOT_SHARE of them at least: then at most 1000 keys are hot, and they are
    broadcast. NULL keys match nothing, as in the join.
    """
    rows = max(least, int((total or 0) * HOT_SHARE))
    hot = many.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows).select(*on, F.ceil(F.col("_n") / rows).cast("int").alias("_salts"))
    hot = hot if total is None else F.broadcast(hot)
    own = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*[F.col(c) for c in many.columns]), F.col("_salts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    return many.join(hot, on, "left").withColumn("_salt", own).drop("_salts"), few.join(hot, on, "left").withColumn("_salt", every).drop("_salts")


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, not to be broadcast in its next join.

    Spark estimates a table's size from its compressed files and counts neither
    exploded rows nor long arrays; what it then broadcasts passes through the driver.
    """
    return df.hint("merge")


def positions(df: DataFrame, key: str, name: str = "pos") -> DataFrame:
    """(key, pos): the distinct non-NULL keys numbered 0, 1, ... in ascending order.

    Keys are range-partitioned and numbered within their partition; only the
    partitions' sizes reach the driver. No task sees more than its range.
    """
    ranged = df.filter(F.col(key).isNotNull()).select(key).distinct().repartitionByRange(key)
    parts = materialise(ranged.withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = {r["_part"]: r["count"] for r in parts.groupBy("_part").count().collect()}
    before, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, before))
        before += sizes[p]
    base = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part int, _before bigint"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return parts.join(base, "_part").select(key, (F.col("_before") + within).alias(name))


def compress(df: DataFrame, keys: list[str], total: Column | None = None) -> DataFrame:
    """Distinct combinations of ``keys`` with their number of rows ``n`` (and ``total`` summed)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if total is not None:
        aggs.append(F.sum(total).alias("total"))
    return df.groupBy(*keys).agg(*aggs)


def two_sided(df: DataFrame, left: str, right: str, total: Column | None = None) -> DataFrame:
    """(side, key, value, n[, total]) of both columns from ONE compression by (left, right).

    The pair is at once (key, value) of either side, so the edges are shuffled
    once, not once per side, and a hot zip is spread over its partners.
    """
    pairs = compress(df, [left, right], total)
    sides = F.explode(
        F.array(
            F.struct(F.lit(left).alias("side"), F.col(left).alias("key"), F.col(right).alias("value")),
            F.struct(F.lit(right).alias("side"), F.col(right).alias("key"), F.col(left).alias("value")),
        )
    )
    rest = [c for c in pairs.columns if c not in (left, right)]
    return pairs.select(sides.alias("_s"), *rest).select("_s.side", "_s.key", "_s.value", *rest)


def profiles(weighted: DataFrame) -> DataFrame:
    """Per (side, key): rows, distinct values, the commonest value and its rows, total.

    ``weighted`` is (side, key, value, n, total) from ``two_sided``. NULL values
    count as rows but not as values; of equally common values the smallest is
    the mode; NULL keys are dropped here. Every aggregate combines map-side.
    """
    rank = F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("m"), F.col("value").alias("value")))
    return (
        weighted.filter(F.col("key").isNotNull())
        .groupBy("side", "key")
        .agg(
            F.sum("n").alias("n_rows"),
            F.count("value").alias("n_values"),
            F.min(rank).alias("_mode"),
            F.sum("total").alias("total"),
        )
        .select("side", "key", "n_rows", "n_values", F.col("_mode.value").alias("mode"), (-F.col("_mode.m")).alias("mode_rows"), "total")
    )


def heavy_keys(df: DataFrame, left: str, right: str, share: float = 0.025) -> DataFrame:
    """(side, key, n_rows) of the keys holding at least ``share`` of all rows.

    Rows with a NULL key count in the total but NULL is never reported. An empty
    table gives no rows. The total is a metadata count where the source has one.
    """
    total = df.count()
    return (
        two_sided(df.select(left, right), left, right)
        .filter(F.col("key").isNotNull())
        .groupBy("side", "key")
        .agg(F.sum("n").alias("n_rows"))
        .filter((F.col("n_rows") >= F.lit(share) * F.lit(total)) & (F.lit(total) > 0))
    )


def percentiles(df: DataFrame, key: str, value: str, shares: dict[str, float | Callable[[Column], Column]]) -> DataFrame:
    """Exact nearest-rank percentiles of ``value`` per key, whatever a key's size.

    A share may also be a function from the key's number of rows to the rank, from 1.

    1. compress to (key, value, n); 2. keys with at least HOT_SHARE of the
    compressed rows (so at most 1000) get up to 63 splitters from a mergeable
    sketch, broadcast; 3. cumulate n by value within (key, bucket) and add the
    weight of the key's lower buckets. Splitters only spread the work: ranks are
    exact however they lie. NULL keys and NULL or NaN values are left out.
    """
    valid = F.col(key).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value)
    freq = materialise(compress(df.filter(valid).select(F.col(key).alias("_key"), (F.col(value) + F.lit(0.0)).alias("_value")), ["_key", "_value"]), "frequencies")
    sketch = F.percentile_approx("_value", [i / 64 for i in range(1, 64)], 1000)
    sizes = freq.groupBy("_key").agg(F.count(F.lit(1)).alias("_m"))
    least = max(1000, int(freq.count() * HOT_SHARE))
    hot_keys = sizes.filter(F.col("_m") >= least).select("_key")
    cuts = F.broadcast(freq.join(F.broadcast(hot_keys), "_key", "left_semi").groupBy("_key").agg(F.array_distinct(sketch).alias("_cuts")))
    bucket = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_value"))), F.lit(0))
    spread = freq.join(cuts, "_key", "left").withColumn("_bucket", F.when(F.col("_cuts").isNull(), 0).otherwise(bucket)).drop("_cuts")
    by_bucket = spread.join(F.broadcast(hot_keys), "_key", "left_semi").groupBy("_key", "_bucket").agg(F.sum("n").alias("_bn"))
    lower = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.select(
        "_key", "_bucket", F.coalesce(F.sum("_bn").over(lower), F.lit(0)).alias("_below"), F.sum("_bn").over(Window.partitionBy("_key")).alias("_all")
    )
    within = Window.partitionBy("_key", "_bucket")
    ranked = (
        spread.join(F.broadcast(offsets), ["_key", "_bucket"], "left")
        .withColumn("_cum", F.sum("n").over(within.orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("_below", F.lit(0)))
        .withColumn("_all", F.coalesce("_all", F.sum("n").over(within)))
    )
    out = []
    for name, q in shares.items():
        rank = F.greatest(F.lit(1), q(F.col("_all")) if callable(q) else F.ceil(F.col("_all") * F.lit(q)))
        out.append(F.max(F.when((F.col("_cum") >= rank) & (F.col("_cum") - F.col("n") < rank), F.col("_value"))).alias(name))
    return ranked.groupBy("_key").agg(F.sum("n").alias("n_rows"), *out).withColumnRenamed("_key", key)
