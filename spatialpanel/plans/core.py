"""Registered queries of the general data problems (p1 to p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import day_text
from ..operators import skew, spatial, spikes, timegrid
from ..sources.tables import table

PANEL = ["spend", "impressions", "clicks"]


def _readings(spark: SparkSession, d: str, keep: list[str]) -> DataFrame:
    return timegrid.usable_readings(table(spark, d, "timeseries"), keep)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    grid = timegrid.regular_grid(_readings(spark, d, ["spend"]), "geo_id", "date", "spend")
    return grid.filter("n_readings = 0").select("geo_id", day_text(F.col("cell")).alias("day"))


def p1_grid(spark: SparkSession, d: str) -> DataFrame:
    grid = timegrid.regular_grid(_readings(spark, d, ["spend"]), "geo_id", "date", "spend")
    return grid.select("geo_id", day_text(F.col("cell")).alias("day"), "n_readings", F.col("value").alias("spend"), "status")


def _rolling(spark: SparkSession, d: str) -> DataFrame:
    daily = timegrid.daily_totals(_readings(spark, d, PANEL), "geo_id", "date", PANEL)
    return timegrid.rolling_totals(daily, "geo_id", PANEL, [7, 30])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    busy = (F.col("day_index") >= 29) & (2 * F.col("total_clicks_7") > F.col("total_clicks_30"))
    return _rolling(spark, d).filter(busy).select("geo_id", day_text(F.col("day")).alias("day"))


def p2_rolling(spark: SparkSession, d: str) -> DataFrame:
    df = _rolling(spark, d)
    wide = [c for c in df.columns if c.startswith(("total_", "avg_"))]
    return df.select("geo_id", day_text(F.col("day")).alias("day"), *[F.col(c).cast("double").alias(c) for c in wide])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return spatial.near_pairs(table(spark, d, "geo_df"), 1.0)


def tiles(spark: SparkSession) -> DataFrame:
    """Sample regions: the globe in 30-degree squares, each an L of three quarters and the quarter left."""
    x, y, h = F.col("x0"), F.col("y0"), 15.0
    at = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    base = spark.range(72).select(F.col("id"), (F.col("id") % 12 * 30 - 180.0).alias("x0"), (F.expr("id div 12") * 30 - 90.0).alias("y0"))
    ell = F.array(at(0, 0), at(2 * h, 0), at(2 * h, h), at(h, h), at(h, 2 * h), at(0, 2 * h))
    rest = F.array(at(h, h), at(2 * h, h), at(2 * h, 2 * h), at(h, 2 * h))
    return base.select((F.col("id") * 2).alias("region_id"), ell.alias("ring")).unionByName(base.select((F.col("id") * 2 + 1).alias("region_id"), rest.alias("ring")))


def p3_regions(spark: SparkSession, d: str) -> DataFrame:
    points = spatial.valid_locations(table(spark, d, "geo_df"))
    return spatial.points_in_regions(points, tiles(spark), "geo_id", "region_id", "longitude", "latitude")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_keys(table(spark, d, "mobility_edges"), "src_zip", "dst_zip", 0.025).select("side", F.col("key").alias("zip"))


def p4_totals(spark: SparkSession, d: str) -> DataFrame:
    weight = F.expr("try_cast(nanvl(weight, NULL) AS DECIMAL(20,4))")
    weighted = skew.two_sided(table(spark, d, "mobility_edges"), "src_zip", "dst_zip", weight)
    out = skew.profiles(weighted)
    return out.select("side", F.col("key").alias("zip"), "n_rows", F.col("n_values").alias("n_partners"), F.col("mode").alias("top_partner"), F.col("mode_rows").alias("top_rows"), F.round(F.col("total").cast("double"), 2).alias("total_weight"))


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return skew.percentiles(table(spark, d, "mobility_edges"), "src_zip", "weight", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return spikes.flag_readings(_readings(spark, d, ["spend"])).filter("flag IS NOT NULL")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).select("reading_id")


def p5_flags(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).select("geo_id", "reading_id", F.col("value").alias("spend"), F.round("deviation", 4).alias("deviation"), F.round("p_spike", 4).alias("p_spike"), F.round("p_stuck", 4).alias("p_stuck"), "flag")


def p5_hard(spark: SparkSession, d: str) -> DataFrame:
    """The flags that hard bounds decide."""
    return _flags(spark, d).filter("flag <> 'spike'").select("geo_id", "reading_id", F.col("value").alias("spend"), "flag")


QUERIES = {f.__name__: f for f in (p1_found, p1_grid, p2_found, p2_rolling, p3_found, p3_regions, p4_found, p4_totals, p4_percentiles, p5_found, p5_flags, p5_hard)}

USABLE = """
valid AS (SELECT * FROM timeseries WHERE geo_id IS NOT NULL AND date >= TIMESTAMP '2024-01-01' AND date < TIMESTAMP '2024-05-30'),
standing AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY geo_id, date ORDER BY received_at DESC NULLS LAST, reading_id DESC) = 1),
usable AS (SELECT * FROM standing WHERE spend IS NOT NULL AND NOT isnan(spend))"""
SPANS = USABLE + """,
spans AS (SELECT geo_id, min(date::DATE) AS d0, max(date::DATE) AS d1 FROM usable GROUP BY geo_id),
days AS (SELECT geo_id, d0, d1, unnest(generate_series(d0, d1, INTERVAL 1 DAY))::DATE AS d FROM spans)"""

SQL = {
    "p1_found": f"""WITH {SPANS}
SELECT geo_id, strftime(d, '%Y-%m-%d') AS day FROM days
WHERE NOT EXISTS (SELECT 1 FROM usable u WHERE u.geo_id = days.geo_id AND u.date::DATE = days.d)""",
    "p1_grid": f"""WITH {SPANS},
counts AS (SELECT geo_id, date::DATE AS d, count(*) AS n FROM usable GROUP BY ALL),
noon AS (SELECT geo_id, d, d + INTERVAL 12 HOUR AS g FROM days),
p AS (SELECT n.geo_id, n.d, n.g, u.date AS pt, u.spend AS pv FROM noon n ASOF LEFT JOIN usable u ON n.geo_id = u.geo_id AND n.g >= u.date),
q AS (SELECT p.*, u.date AS qt, u.spend AS qv FROM p ASOF LEFT JOIN usable u ON p.geo_id = u.geo_id AND p.g <= u.date),
v AS (SELECT geo_id, d, CASE
  WHEN pt IS NOT NULL AND qt IS NOT NULL THEN CASE WHEN pt = qt THEN pv WHEN epoch_us(qt) - epoch_us(pt) <= 259200000000
    THEN pv + (qv - pv) * ((epoch_us(g) - epoch_us(pt))::DOUBLE / (epoch_us(qt) - epoch_us(pt))::DOUBLE) END
  WHEN qt IS NULL AND epoch_us(g) - epoch_us(pt) <= 259200000000 THEN pv
  WHEN pt IS NULL AND epoch_us(qt) - epoch_us(g) <= 259200000000 THEN qv END AS value FROM q)
SELECT v.geo_id, strftime(v.d, '%Y-%m-%d') AS day, coalesce(n, 0)::BIGINT AS n_readings, value AS spend,
  CASE WHEN coalesce(n, 0) > 0 THEN 'observed' WHEN value IS NOT NULL THEN 'interpolated' ELSE 'gap' END AS status
FROM v LEFT JOIN counts c ON v.geo_id = c.geo_id AND v.d = c.d""",
    "p3_found": """WITH ok AS (SELECT DISTINCT * FROM geo_df WHERE geo_id IS NOT NULL AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180
  AND NOT isnan(latitude) AND NOT isnan(longitude) AND NOT (latitude = 0 AND longitude = 0))
SELECT DISTINCT a.geo_id AS geo_id_a, b.geo_id AS geo_id_b FROM ok a JOIN ok b ON a.geo_id < b.geo_id AND abs(a.latitude - b.latitude) < 0.01
WHERE 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(b.latitude - a.latitude) / 2), 2)
  + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2)))) <= 1.0""",
    "p3_regions": """WITH ok AS (SELECT DISTINCT * FROM geo_df WHERE geo_id IS NOT NULL AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180
  AND NOT isnan(latitude) AND NOT isnan(longitude) AND NOT (latitude = 0 AND longitude = 0)),
q AS (SELECT (cy * 12 + cx) * 2 + (CASE WHEN qx = 1 AND qy = 1 THEN 1 ELSE 0 END) AS region_id,
  cx * 30 - 180 + qx * 15 AS x0, cy * 30 - 90 + qy * 15 AS y0
  FROM range(12) a(cx), range(6) b(cy), range(2) c(qx), range(2) e(qy))
SELECT geo_id, longitude, latitude, min(region_id)::BIGINT AS region_id FROM ok JOIN q
ON longitude BETWEEN x0 AND x0 + 15 AND latitude BETWEEN y0 AND y0 + 15 GROUP BY geo_id, longitude, latitude""",
    "p5_hard": f"""WITH {USABLE},
n AS (SELECT *, row_number() OVER (PARTITION BY geo_id ORDER BY date) - row_number() OVER (PARTITION BY geo_id, spend ORDER BY date) AS island FROM usable),
r AS (SELECT *, count(*) OVER (PARTITION BY geo_id, spend, island) AS run FROM n)
SELECT geo_id, reading_id, spend, CASE WHEN spend < 0 OR spend > 5e6 THEN 'out_of_range' ELSE 'stuck' END AS flag FROM r WHERE spend < 0 OR spend > 5e6 OR run >= 6""",
    "p4_found": """WITH s AS (SELECT 'src_zip' AS side, src_zip AS zip FROM mobility_edges UNION ALL SELECT 'dst_zip', dst_zip FROM mobility_edges)
SELECT side, zip FROM s WHERE zip IS NOT NULL GROUP BY side, zip HAVING count(*) >= 0.025 * (SELECT count(*) FROM mobility_edges)""",
    "p4_totals": """WITH s AS (SELECT 'src_zip' AS side, src_zip AS zip, dst_zip AS partner, weight FROM mobility_edges
  UNION ALL SELECT 'dst_zip', dst_zip, src_zip, weight FROM mobility_edges),
t AS (SELECT side, zip, count(*) AS n_rows, count(DISTINCT partner) AS n_partners,
  round(sum(CASE WHEN NOT isnan(weight) THEN weight::DECIMAL(20,4) END)::DOUBLE, 2) AS total_weight FROM s WHERE zip IS NOT NULL GROUP BY side, zip),
c AS (SELECT side, zip, partner, count(*) AS n FROM s WHERE zip IS NOT NULL AND partner IS NOT NULL GROUP BY ALL),
m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY side, zip ORDER BY n DESC, partner) = 1)
SELECT t.side, t.zip, n_rows, n_partners, partner AS top_partner, n AS top_rows, total_weight FROM t LEFT JOIN m ON t.side = m.side AND t.zip = m.zip""",
    "p4_percentiles": """SELECT src_zip, count(*) AS n_rows, quantile_disc(weight, 0.5) AS p50, quantile_disc(weight, 0.9) AS p90, quantile_disc(weight, 0.99) AS p99
FROM mobility_edges WHERE src_zip IS NOT NULL AND weight IS NOT NULL AND NOT isnan(weight) GROUP BY src_zip""",
}


def _p2_sql(select: str, where: str) -> str:
    sums = []
    for m in PANEL:
        for p in (7, 30):
            sums.append(f"sum(d_{m}) OVER (PARTITION BY geo_id ORDER BY d ROWS {p - 1} PRECEDING) AS total_{m}_{p}")
    daily = ", ".join(f"coalesce(sum({m}{'::DECIMAL(28,6)' if m == 'spend' else ''}), 0) AS {m}" for m in PANEL)
    return f"""WITH {SPANS},
daily AS (SELECT geo_id, date::DATE AS d, {daily} FROM usable GROUP BY ALL),
dense AS (SELECT days.geo_id, days.d, days.d - d0 AS day_index, {", ".join(f"coalesce({m}, 0) AS d_{m}" for m in PANEL)}
  FROM days LEFT JOIN daily ON days.geo_id = daily.geo_id AND days.d = daily.d),
w AS (SELECT geo_id, d, day_index, {", ".join(sums)} FROM dense)
SELECT geo_id, strftime(d, '%Y-%m-%d') AS day{select} FROM w {where}"""


SQL["p2_found"] = _p2_sql("", "WHERE day_index >= 29 AND 2 * total_clicks_7 > total_clicks_30")
SQL["p2_rolling"] = _p2_sql(
    "".join(f", total_{m}_{p}::VARCHAR::DOUBLE AS total_{m}_{p}, total_{m}_{p}::VARCHAR::DOUBLE / least({p}, day_index + 1) AS avg_{m}_{p}" for m in PANEL for p in (7, 30)), ""
)
