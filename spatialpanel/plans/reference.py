"""Registered queries of the panel, graph, partition, augmentation and model operators."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import doubles, total
from ..operators import augment, encoder, losses, metrics, panel, regionalize, skew, spatial, synth, timegrid
from ..operators import graph as G
from ..schema import all_finite, embedding_columns
from ..session import materialise
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL counterpart if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# graphs ---------------------------------------------------------------------

KEPT = """kept AS (SELECT * FROM mobility_edges WHERE src_zip IS NOT NULL AND dst_zip IS NOT NULL AND src_zip <> dst_zip AND weight >= 10 AND NOT isnan(weight))"""
PAIRS = KEPT + """,
pairs AS (SELECT least(src_zip, dst_zip) AS a, greatest(src_zip, dst_zip) AS b, arg_min(weight, edge_id) AS weight FROM kept GROUP BY 1, 2),
edges AS (SELECT a AS src, b AS dst, weight FROM pairs UNION ALL SELECT b, a, weight FROM pairs)"""


def _mobility(spark: SparkSession, d: str, numeric: bool = True, dedup: bool = True, least: float = 10.0) -> G.Graph:
    return G.mobility_graph(table(spark, d, "mobility_edges"), least, numeric, dedup, ["edge_id"])


@query(f"WITH {PAIRS} SELECT * FROM edges")
def mobility_graph(spark, d):
    return _mobility(spark, d).edges


@query(f"WITH {PAIRS} SELECT src, dst, 1.0::DOUBLE AS weight FROM edges")
def mobility_binary(spark, d):
    return _mobility(spark, d, numeric=False).edges


@query(f"""WITH {KEPT}, b AS (SELECT src_zip AS src, dst_zip AS dst, weight FROM kept UNION ALL SELECT dst_zip, src_zip, weight FROM kept)
SELECT src, dst, round(sum(weight), 4) AS weight FROM b GROUP BY 1, 2""")
def mobility_no_dedup(spark, d):
    return _mobility(spark, d, dedup=False).edges.withColumn("weight", F.round("weight", 4))


@query(f"WITH {PAIRS} SELECT src AS zip, count(*) AS degree, round(sum(weight), 4) AS strength FROM edges GROUP BY 1")
def mobility_nodes(spark, d):
    return G.node_strength(_mobility(spark, d)).withColumn("strength", F.round("strength", 4))


ORDER = "ord AS (SELECT zip, min(unit_id) AS pos FROM mapping WHERE zip IS NOT NULL AND unit_id IS NOT NULL GROUP BY zip)"


def _order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mapping").filter("zip IS NOT NULL AND unit_id IS NOT NULL").groupBy("zip").agg(F.min("unit_id").alias("pos"))


@query(f"WITH {PAIRS}, {ORDER} SELECT src, dst, weight FROM edges WHERE src IN (SELECT zip FROM ord) AND dst IN (SELECT zip FROM ord)")
def align_graph(spark, d):
    g = _mobility(spark, d)
    order = _order(spark, d)
    return G.align_graph(g, order.join(g.nodes, "zip", "left_semi")).edges


@query(f"WITH {PAIRS.replace('>= 10 ', '>= 100 ')}, {ORDER} SELECT zip FROM ord WHERE zip NOT IN (SELECT src FROM edges)")
def graph_missing_ids(spark, d):
    return G.missing_nodes(_mobility(spark, d, least=100.0), _order(spark, d))


@query(f"WITH {PAIRS}, {ORDER} SELECT DISTINCT src AS zip FROM edges WHERE src NOT IN (SELECT zip FROM ord)")
def graph_extra_ids(spark, d):
    return G.extra_nodes(_mobility(spark, d), _order(spark, d))


POINTS = """ok AS (SELECT DISTINCT * FROM geo_df WHERE geo_id IS NOT NULL AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180
  AND NOT isnan(latitude) AND NOT isnan(longitude) AND NOT (latitude = 0 AND longitude = 0)),
pts AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY geo_id ORDER BY latitude, longitude) = 1)"""


def _points(spark: SparkSession, d: str) -> DataFrame:
    first = F.min(F.struct("latitude", "longitude")).alias("p")
    return spatial.valid_locations(table(spark, d, "geo_df")).groupBy("geo_id").agg(first).select("geo_id", "p.latitude", "p.longitude")


@query(f"""WITH {POINTS},
near AS (SELECT a.geo_id AS src, b.geo_id AS dst FROM pts a JOIN pts b ON a.geo_id <> b.geo_id
  QUALIFY row_number() OVER (PARTITION BY a.geo_id ORDER BY pow(a.latitude - b.latitude, 2) + pow(a.longitude - b.longitude, 2), b.geo_id) <= 8)
SELECT src, dst, 1.0::DOUBLE AS weight FROM (SELECT src, dst FROM near UNION SELECT dst, src FROM near)""")
def knn_graph(spark, d):
    return G.knn_graph(_points(spark, d), 8).edges


RADIUS = f"""{POINTS},
edges AS (SELECT a.geo_id AS src, b.geo_id AS dst FROM pts a JOIN pts b ON a.geo_id <> b.geo_id
  AND pow(a.latitude - b.latitude, 2) + pow(a.longitude - b.longitude, 2) <= 0.01 * 0.01)"""


@query(f"WITH {RADIUS} SELECT src, dst, 1.0::DOUBLE AS weight FROM edges")
def radius_graph(spark, d):
    return G.radius_graph(_points(spark, d), 0.01).edges


@query(f"""WITH RECURSIVE {RADIUS}, r(zip, other) AS (SELECT geo_id, geo_id FROM pts UNION SELECT r.zip, e.dst FROM r JOIN edges e ON e.src = r.other)
SELECT zip, min(other) AS component FROM r GROUP BY zip""")
def graph_components(spark, d):
    return G.components(G.radius_graph(_points(spark, d), 0.01))


CELLS = """cells AS (SELECT printf('Z%03d%03d', i // 40, i % 40) AS zip, (i // 40)::INT AS "row", (i % 40)::INT AS col,
  ((i // 40 // 6) * 6 + i % 40 // 7)::INT AS block_id FROM range(1200) t(i))"""


@query(f'WITH {CELLS} SELECT * FROM cells')
def lattice_nodes(spark, d):
    return synth.lattice_nodes(spark, 40, 30, 7, 6)


@query(f'WITH {CELLS} SELECT a.zip AS src, b.zip AS dst, 1.0::DOUBLE AS weight FROM cells a JOIN cells b ON abs(a."row" - b."row") + abs(a.col - b.col) = 1')
def lattice_edges(spark, d):
    return synth.lattice_grid(spark, 40, 30, 7, 6)[1].edges


def _draw(seed: int, stream: str, key: str) -> str:
    """SQL of ``rng.uniform``."""
    return f"(('0x' || substr(md5('{seed}:{stream}:' || {key}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)"


def _draw_normal(seed: int, stream: str, key: str) -> str:
    """SQL of ``rng.normal``."""
    return f"(sqrt(-2.0 * ln(greatest({_draw(seed, stream + 'a', key)}, pow(2.0, -52)))) * cos(2 * pi() * {_draw(seed, stream + 'b', key)}))"


@query(f"""WITH {CELLS} SELECT zip, "row", col, block_id, round("row" / 29.0 + 0.05 * {_draw_normal(42, 'e0', 'zip')}, 6) AS e0,
  round(col / 39.0 + 0.05 * {_draw_normal(42, 'e1', 'zip')}, 6) AS e1 FROM cells""")
def lattice_embeddings(spark, d):
    df = synth.make_embeddings(synth.lattice_nodes(spark, 40, 30, 7, 6), use_float32=False)
    return df.withColumn("e0", F.round("e0", 6)).withColumn("e1", F.round("e1", 6))


def _squares(spark: SparkSession) -> DataFrame:
    at = lambda dx, dy: F.struct((F.col("col") + float(dx)).alias("x"), (F.col("row") + float(dy)).alias("y"))
    return synth.lattice_nodes(spark, 20, 15, 5, 5).select("zip", F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1)).alias("ring"))


SQUARES = """sq AS (SELECT printf('Z%03d%03d', i // 20, i % 20) AS zip, i // 20 AS r, i % 20 AS c FROM range(300) t(i))"""


@query(f"WITH {SQUARES} SELECT a.zip AS src, b.zip AS dst, 1.0::DOUBLE AS weight FROM sq a JOIN sq b ON abs(a.r - b.r) + abs(a.c - b.c) = 1")
def contiguity_rook(spark, d):
    return G.contiguity_graph(_squares(spark), "rook").edges


@query(f"WITH {SQUARES} SELECT a.zip AS src, b.zip AS dst, 1.0::DOUBLE AS weight FROM sq a JOIN sq b ON greatest(abs(a.r - b.r), abs(a.c - b.c)) = 1")
def contiguity_queen(spark, d):
    return G.contiguity_graph(_squares(spark), "Queen").edges


# partitions -----------------------------------------------------------------


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("zip"), doubles(F.col("embedding")).alias("vector"), F.col("label").alias("unit_id"))


@query("""WITH v AS (SELECT vec_id AS i, label, embedding::DOUBLE[] AS e FROM embeddings),
d AS (SELECT a.i, a.label AS own, b.label AS other, sum(list_distance(a.e, b.e)) AS s, count(*) AS n FROM v a JOIN v b ON true GROUP BY 1, 2, 3),
p AS (SELECT i, own, max(CASE WHEN other = own THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN other <> own THEN s / n END) AS b FROM d GROUP BY 1, 2)
SELECT i AS zip, own AS unit_id, round(a, 6) AS a, round(b, 6) AS b, round((b - a) / greatest(a, b), 6) AS silhouette FROM p""")
def silhouette(spark, d):
    s = metrics.silhouette_samples(_vectors(spark, d), max_samples=None)
    return s.select("zip", "unit_id", *[F.round(c, 6).alias(c) for c in ("a", "b", "silhouette")])


@query("""WITH x AS (SELECT vec_id, label, unnest(range(64)) AS j, unnest(embedding::DOUBLE[]) AS x FROM embeddings),
c AS (SELECT label, j, avg(x) AS m FROM x GROUP BY 1, 2),
s AS (SELECT label, avg(r) AS s FROM (SELECT vec_id, x.label, sqrt(sum(pow(x - m, 2))) AS r FROM x JOIN c ON x.label = c.label AND x.j = c.j GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT a.label AS i, b.label AS k, sqrt(sum(pow(a.m - b.m, 2))) AS g FROM c a JOIN c b ON a.j = b.j AND a.label <> b.label GROUP BY 1, 2)
SELECT round(avg(w), 6) AS davies_bouldin FROM (SELECT i, max((si.s + sk.s) / g) AS w FROM g JOIN s si ON si.label = i JOIN s sk ON sk.label = k GROUP BY i)""")
def davies_bouldin(spark, d):
    return metrics.davies_bouldin(_vectors(spark, d)).select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


@query("SELECT label AS unit_id, count(*) AS n FROM embeddings GROUP BY label")
def label_counts(spark, d):
    return metrics.label_counts(_vectors(spark, d))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return _order(spark, d).select("zip", F.col("pos").alias("unit_id"))


@query(f"""WITH RECURSIVE {PAIRS}, {ORDER}, w AS (SELECT e.src, e.dst FROM edges e JOIN ord a ON e.src = a.zip JOIN ord b ON e.dst = b.zip AND a.pos = b.pos),
r(zip, other) AS (SELECT zip, zip FROM ord UNION SELECT r.zip, w.dst FROM r JOIN w ON w.src = r.other),
c AS (SELECT zip, min(other) AS comp FROM r GROUP BY zip)
SELECT pos AS unit_id, count(*) AS n_zips, count(DISTINCT comp) AS n_components FROM ord JOIN c ON ord.zip = c.zip GROUP BY pos""")
def contiguity_units(spark, d):
    return metrics.contiguity(_labels(spark, d), _mobility(spark, d))


@query("""WITH m AS (SELECT zip, min(unit_id) AS a, max(unit_id) // 2 AS b FROM mapping WHERE zip IS NOT NULL AND unit_id IS NOT NULL GROUP BY zip),
c AS (SELECT a, b, count(*) AS n FROM m GROUP BY 1, 2),
s AS (SELECT (SELECT sum(n) FROM c) AS n, (SELECT sum(n * n) FROM c) AS ab,
  (SELECT sum(k * k) FROM (SELECT sum(n) AS k FROM c GROUP BY a)) AS aa, (SELECT sum(k * k) FROM (SELECT sum(n) AS k FROM c GROUP BY b)) AS bb)
SELECT n::BIGINT AS n, (ab - n)::BIGINT AS tp, (aa - ab)::BIGINT AS fp, (bb - ab)::BIGINT AS fn, (n * n - aa - bb + ab)::BIGINT AS tn FROM s""")
def pair_confusion(spark, d):
    m = table(spark, d, "mapping").filter("zip IS NOT NULL AND unit_id IS NOT NULL").groupBy("zip").agg(F.min("unit_id").alias("a"), F.expr("max(unit_id) div 2").alias("b"))
    return metrics.pair_confusion(m.select("zip", F.col("a").alias("unit_id")), m.select("zip", F.col("b").alias("unit_id")))


SUMMARY = """SELECT unit_id, count(*) AS n_zips, {p} AS population, {s} AS sales FROM mapping JOIN zip_attributes USING (zip) WHERE unit_id IS NOT NULL GROUP BY unit_id"""


def _summary(spark: SparkSession, d: str, keep_missing: bool) -> DataFrame:
    attributes = table(spark, d, "zip_attributes")
    mapping = table(spark, d, "mapping").join(attributes.select("zip"), "zip", "left_semi")
    return metrics.cluster_summary(mapping, attributes, ["population", "sales"], keep_missing)


@query(SUMMARY.format(p="sum(population)::BIGINT", s="sum(sales)::BIGINT"))
def cluster_summary(spark, d):
    return _summary(spark, d, True)


@query(SUMMARY.format(p="coalesce(sum(population), 0)::BIGINT", s="coalesce(sum(sales), 0)::BIGINT"))
def cluster_summary_zero(spark, d):
    return _summary(spark, d, False)


@query(f"WITH {ORDER} SELECT zip, dense_rank() OVER (ORDER BY pos) - 1 AS unit_id FROM ord")
def relabel(spark, d):
    return regionalize.relabel(_labels(spark, d))


# panel ----------------------------------------------------------------------

DENSE = """valid AS (SELECT * FROM timeseries WHERE geo_id IS NOT NULL AND date >= TIMESTAMP '2024-01-01' AND date < TIMESTAMP '2024-05-30'),
standing AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY geo_id, date ORDER BY received_at DESC NULLS LAST, reading_id DESC) = 1),
daily AS (SELECT geo_id, date::DATE AS d, count(*)::DOUBLE AS readings, coalesce(sum(clicks), 0)::DOUBLE AS clicks FROM standing WHERE spend IS NOT NULL AND NOT isnan(spend) GROUP BY ALL),
axis AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS t FROM (SELECT DISTINCT d FROM daily)),
long AS (SELECT g.geo_id, f.feature, a.t, coalesce(CASE WHEN f.feature = 'clicks' THEN p.clicks ELSE p.readings END, 0.0) AS x
  FROM (SELECT DISTINCT geo_id FROM daily) g JOIN axis a ON true JOIN (VALUES ('readings'), ('clicks')) f(feature) ON true
  LEFT JOIN daily p ON p.geo_id = g.geo_id AND p.d = a.d),
series AS (SELECT geo_id, feature, list(x ORDER BY t) AS xs FROM long GROUP BY 1, 2)"""
FEATURES = ["readings", "clicks"]


def _series(spark: SparkSession, d: str) -> DataFrame:
    usable = timegrid.usable_readings(table(spark, d, "timeseries"), ["clicks"])
    daily = usable.groupBy("geo_id", F.col("date").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("readings"), F.coalesce(F.sum("clicks"), F.lit(0)).alias("clicks"))
    return panel.dense_series(daily)


def _steps(df: DataFrame, column: str = "xs") -> DataFrame:
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(column).alias("t", "x"))


@query(f"WITH {DENSE} SELECT geo_id, feature, t::INT AS t, x FROM long")
def panel_dense(spark, d):
    return _steps(_series(spark, d))


def _parts(df: DataFrame) -> DataFrame:
    i, t = F.col("input"), F.col("target")
    return df.select("geo_id", "feature", F.size(i).alias("n_input"), total(i).alias("sum_input"), F.element_at(i, -1).alias("last_input"), F.size(t).alias("n_target"), total(t).alias("sum_target"), F.get(t, F.lit(0)).alias("first_target"))


def _parts_sql(i: str, t: str) -> str:
    return f"""WITH {DENSE}, cut AS (SELECT geo_id, feature, {i} AS i, {t} AS t FROM series)
SELECT geo_id, feature, len(i)::INT AS n_input, list_sum(i) AS sum_input, i[-1] AS last_input, len(t)::INT AS n_target, list_sum(t) AS sum_target, t[1] AS first_target FROM cut"""


@query(_parts_sql("xs[1:len(xs) - 28]", "xs[len(xs) - 27:]"))
def horizon_split(spark, d):
    return _parts(panel.horizon_split(_series(spark, d), 28))


@query(_parts_sql("xs[1:60]", "xs[61:90]"))
def temporal_split(spark, d):
    return _parts(panel.temporal_split(_series(spark, d), 60, 30))


@query(_parts_sql("xs[1:120]", "xs[len(xs) - 59:]"))
def temporal_split_overlap(spark, d):
    return _parts(panel.temporal_split(_series(spark, d), 120, 60, overlap=True))


@query(f"""WITH {DENSE}, w AS (SELECT geo_id, feature, xs, unnest(range((len(xs) - 14) // 7 + 1)) AS k FROM series)
SELECT geo_id, feature, k::INT AS window_idx, (k * 7)::INT AS start_pos, list_sum(xs[k * 7 + 1:k * 7 + 14]) AS total, xs[k * 7 + 1] AS first_value FROM w""")
def sliding_windows(spark, d):
    w = panel.sliding_windows(_series(spark, d), 14, 7)
    return w.select("geo_id", "feature", "window_idx", "start_pos", total(F.col("window")).alias("total"), F.get("window", F.lit(0)).alias("first_value"))


AR = f"{DENSE}, w AS (SELECT geo_id, feature, xs, unnest(range((len(xs) - 12) // 5 + 1)) AS k FROM series)"


@query(f"""WITH {AR} SELECT geo_id, feature, k::INT AS window_idx, (k * 5)::INT AS start_pos, (k * 5)::INT AS input_from, (k * 5 + 10)::INT AS input_to,
  (k * 5 + 10)::INT AS target_from, (k * 5 + 12)::INT AS target_to, list_sum(xs[k * 5 + 1:k * 5 + 10])::DOUBLE AS input_sum, list_sum(xs[k * 5 + 11:k * 5 + 12])::DOUBLE AS target_sum FROM w""")
def autoregressive_windows(spark, d):
    w = panel.autoregressive_windows(_series(spark, d), 10, 2, 5)
    return w.select("geo_id", "feature", "window_idx", "start_pos", "input_from", "input_to", "target_from", "target_to", total(doubles(F.col("input"))).alias("input_sum"), total(doubles(F.col("target"))).alias("target_sum"))


@query(f"""WITH {AR}, s AS (SELECT geo_id, feature, k, unnest([0, 1]) AS step, xs FROM w)
SELECT geo_id, k::INT AS window_idx, step::INT AS step, max(CASE WHEN feature = 'clicks' THEN xs[k * 5 + 11 + step] END) AS clicks,
  max(CASE WHEN feature = 'readings' THEN xs[k * 5 + 11 + step] END) AS readings FROM s GROUP BY 1, 2, 3""")
def autoregressive_unstacked(spark, d):
    u = panel.unstack_targets(panel.autoregressive_windows(_series(spark, d), 10, 2, 5))
    return u.select("geo_id", "window_idx", "step", F.get("targets", F.lit(0)).cast("double").alias("clicks"), F.get("targets", F.lit(1)).cast("double").alias("readings"))


KERNEL = [0.25, 0.5, 0.25]


@query(f"""WITH {DENSE} SELECT geo_id, feature, t::INT AS t, 0.25 * coalesce(lag(x) OVER w, 0) + 0.5 * x + 0.25 * coalesce(lead(x) OVER w, 0) AS x
FROM long WINDOW w AS (PARTITION BY geo_id, feature ORDER BY t)""")
def convolve(spark, d):
    return _steps(_series(spark, d).withColumn("xs", panel.convolve(F.col("xs"), KERNEL)))


KERNELS, BIAS = [[[0.5, 0.25], [-0.5, 1.0]], [[1.0, 0.0], [0.0, -1.0]]], [0.125, -0.5]


@query(f"""WITH {DENSE}, p AS (SELECT geo_id, t, max(CASE WHEN feature = 'readings' THEN x END) AS r, max(CASE WHEN feature = 'clicks' THEN x END) AS c FROM long GROUP BY 1, 2),
n AS (SELECT geo_id, max(t) + 1 AS n FROM p GROUP BY 1),
s AS (SELECT n.geo_id, unnest(range(n + 1)) AS t FROM n),
v AS (SELECT s.geo_id, s.t, coalesce(a.r, 0) AS r0, coalesce(a.c, 0) AS c0, coalesce(b.r, 0) AS r1, coalesce(b.c, 0) AS c1 FROM s
  LEFT JOIN p a ON a.geo_id = s.geo_id AND a.t = s.t - 1 LEFT JOIN p b ON b.geo_id = s.geo_id AND b.t = s.t)
SELECT geo_id, 0 AS channel, t::INT AS t, 0.5 * r0 + 0.25 * r1 - 0.5 * c0 + c1 + 0.125 AS x FROM v
UNION ALL SELECT geo_id, 1, t::INT, r0 - c1 - 0.5 FROM v""")
def convolve_channels(spark, d):
    return _steps(panel.convolve_channels(_series(spark, d), KERNELS, BIAS, FEATURES), "ys")


# augmentation ---------------------------------------------------------------


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return _series(spark, d).withColumn("key", F.concat_ws("/", "geo_id", "feature"))


def _augmented(spark: SparkSession, d: str, method: str, **params) -> DataFrame:
    out = augment.augment(_keyed(spark, d), method, "key", seed=7, **params).drop("key")
    return _steps(out).withColumn("x", F.round("x", 6))


LONG = f"{DENSE}, k AS (SELECT *, geo_id || '/' || feature AS key, count(*) OVER (PARTITION BY geo_id, feature) AS n FROM long)"
STEP = "key || ':' || t::VARCHAR"


@query(f"WITH {LONG} SELECT geo_id, feature, t::INT AS t, round(x + 0.1 * {_draw_normal(7, 'jitter', STEP)}, 6) AS x FROM k")
def jitter(spark, d):
    return _augmented(spark, d, "jitter", noise_std=0.1)


@query(f"WITH {LONG} SELECT geo_id, feature, t::INT AS t, CASE WHEN {_draw(7, 'mask', STEP)} < 0.3 THEN -1.0 ELSE x END AS x FROM k")
def mask_random(spark, d):
    return _augmented(spark, d, "mask", mask_prob=0.3, mask_value=-1.0)


@query(f"""WITH {LONG}, b AS (SELECT *, greatest(1, floor(n * 0.2)) AS block FROM k), s AS (SELECT *, floor({_draw(7, 'mask', 'key')} * (n - block + 1)) AS s FROM b)
SELECT geo_id, feature, t::INT AS t, CASE WHEN t >= s AND t < s + block THEN -1.0 ELSE x END AS x FROM s""")
def mask_contiguous(spark, d):
    return _augmented(spark, d, "mask", mask_prob=0.2, mask_value=-1.0, mask_mode="contiguous")


CROPPED = f"""c AS (SELECT geo_id, feature, xs, len(xs) AS n, floor(len(xs) * 0.8)::BIGINT AS part FROM series),
s AS (SELECT *, xs[floor({{draw}} * (n - part + 1))::BIGINT + 1:floor({{draw}} * (n - part + 1))::BIGINT + part] AS p, unnest(range(n)) AS t FROM c),
l AS (SELECT geo_id, feature, t, p, part, t::DOUBLE * (part - 1) / (n - 1) AS place FROM s),
crop AS (SELECT geo_id, feature, t, p[floor(place)::BIGINT + 1] + (p[least(floor(place)::BIGINT + 1, part - 1) + 1] - p[floor(place)::BIGINT + 1]) * (place - floor(place)) AS x FROM l)"""


@query(f"WITH {DENSE}, {CROPPED.format(draw=_draw(7, 'crop', chr(39) + 'start' + chr(39)))} SELECT geo_id, feature, t::INT AS t, round(x, 6) AS x FROM crop")
def crop(spark, d):
    return _augmented(spark, d, "crop", crop_ratio=0.8)


@query(f"""WITH {LONG}, {CROPPED.format(draw=_draw(7, 'view2', chr(39) + 'start' + chr(39)))}
SELECT k.geo_id, k.feature, k.t::INT AS t, CASE WHEN {_draw(7, 'view1', STEP.replace('t::', 'k.t::'))} < 0.3 THEN 0.0 ELSE k.x END AS view1, round(c.x, 6) AS view2
FROM k JOIN crop c ON k.geo_id = c.geo_id AND k.feature = c.feature AND k.t = c.t""")
def augmented_pair(spark, d):
    pair = augment.augmented_pair(_keyed(spark, d), "key", aug1_method="mask", aug2_method="crop", seed=7, mask_mask_prob=0.3, crop_crop_ratio=0.8)
    both = pair.select("geo_id", "feature", F.posexplode(F.arrays_zip("view1", "view2")).alias("t", "v"))
    return both.select("geo_id", "feature", "t", "v.view1", F.round("v.view2", 6).alias("view2"))


# losses ---------------------------------------------------------------------

HALVES = "p AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b FROM embeddings)"


def _halves(spark: SparkSession, d: str) -> DataFrame:
    e = doubles(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.slice(e, 1, 32).alias("a"), F.slice(e, 33, 32).alias("b"))


@query(f"WITH {HALVES} SELECT round(avg(pow(x, 2)), 6) AS loss FROM (SELECT unnest(a) - unnest(b) AS x FROM p)")
def mse_loss(spark, d):
    return losses.mse(_halves(spark, d), "a", "b").select(F.round("loss", 6).alias("loss"))


@query(f"""WITH {HALVES}, v AS (SELECT vec_id, 0 AS side, a AS x FROM p UNION ALL SELECT vec_id, 1, b FROM p),
s AS (SELECT a.vec_id, a.side, list_cosine_similarity(a.x, b.x) / 0.5 AS s, a.vec_id = b.vec_id AS pos FROM v a JOIN v b ON a.vec_id <> b.vec_id OR a.side <> b.side)
SELECT round(avg(l), 6) AS loss FROM (SELECT ln(sum(CASE WHEN pos THEN 2 ELSE 1 END * exp(s))) - max(CASE WHEN pos THEN s END) AS l FROM s GROUP BY vec_id, side)""")
def nt_xent(spark, d):
    return losses.nt_xent(_halves(spark, d), "vec_id", "a", "b", 0.5).select(F.round("loss", 6).alias("loss"))


def _bank(spark: SparkSession, size: int) -> DataFrame:
    """A bank of unit vectors along the axes, so that SQL can name it."""
    return spark.range(size).select(F.col("id").cast("int").alias("slot"), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: F.when(j == F.col("id") % 32, 1.0).otherwise(0.0)).alias("vec"))


@query(f"""WITH {HALVES}, n AS (SELECT vec_id, list_cosine_similarity(a, b) / 0.2 AS p, list_transform(a, lambda x: x / sqrt(list_dot_product(a, a))) AS u, list_transform(b, lambda x: x / sqrt(list_dot_product(b, b))) AS w FROM p),
l AS (SELECT p, list_sum(list_transform(u, lambda x: 2 * exp(x / 0.2))) AS s, list_sum(list_transform(w, lambda x: 2 * exp(x / 0.2))) AS r FROM n)
SELECT round(avg((ln(s + exp(p)) - p + ln(r + exp(p)) - p) / 2), 6) AS loss FROM l""")
def memory_bank_loss(spark, d):
    return losses.bank_loss(_halves(spark, d), _bank(spark, 64), "a", "b", 0.2).select(F.round("loss", 6).alias("loss"))


@query("""WITH b AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n, embedding[1:32]::DOUBLE[] AS a FROM embeddings),
w AS (SELECT (pos + 40) % 64 AS slot, round(a[1] / sqrt(list_dot_product(a, a)), 6) AS first_value FROM b WHERE pos >= n - 64)
SELECT slot::INT AS slot, first_value FROM w UNION ALL SELECT s::INT, CASE WHEN s % 32 = 0 THEN 1.0 ELSE 0.0 END FROM range(64) t(s) WHERE s NOT IN (SELECT slot FROM w)""")
def memory_bank_update(spark, d):
    halves = _halves(spark, d)
    batch = halves.join(skew.positions(halves, "vec_id"), "vec_id").select("pos", F.col("a").alias("vec"))
    bank, _ = losses.bank_update(_bank(spark, 64), batch, 40, 64)
    return bank.select("slot", F.round(F.get("vec", F.lit(0)), 6).alias("first_value"))


# model and regions ----------------------------------------------------------

OWN, NBR = [[0.5, -0.25], [-1.0, 0.125], [0.25, 0.5]], [[0.125, 0.0], [0.25, -0.5], [-0.125, 0.25]]


def _relu_sql(i: int) -> str:
    (a, b), (c, e) = OWN[i], NBR[i]
    return f"round(greatest(0, {a} * x + {b} * y + {c} * sx + {e} * sy), 9) AS z{i}"


@query(f"""WITH {POINTS}, k AS (SELECT geo_id AS zip, latitude AS x, longitude AS y FROM pts), edges AS (SELECT a.zip AS src, b.zip AS dst FROM k a JOIN k b ON a.zip <> b.zip AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 0.01 * 0.01),
s AS (SELECT k.zip, k.x, k.y, coalesce(sum(o.x), 0) AS sx, coalesce(sum(o.y), 0) AS sy FROM k LEFT JOIN edges e ON e.src = k.zip LEFT JOIN k o ON o.zip = e.dst GROUP BY 1, 2, 3)
SELECT zip, {", ".join(_relu_sql(i) for i in range(3))} FROM s""")
def graph_layer(spark, d):
    import numpy as np

    points = _points(spark, d)
    vectors = points.select(F.col("geo_id").alias("zip"), F.array("latitude", "longitude").alias("vec"))
    z = encoder.graph_layer(vectors, G.radius_graph(points, 0.01), {"own": np.array(OWN), "nbr": np.array(NBR)})
    return z.select("zip", *[F.round(F.get("embedding", F.lit(i)), 9).alias(f"z{i}") for i in range(3)])


@lru_cache(maxsize=4)
def _params(channels: int):
    return encoder.initial_params(encoder.EncoderConfig(channels))


def _geo_graph(spark: SparkSession, d: str) -> G.Graph:
    return G.knn_graph(_points(spark, d), 4)


def _scaled(spark: SparkSession, d: str) -> DataFrame:
    """Series divided by their largest value, so that training is well-scaled."""
    top = F.greatest(F.array_max("xs"), F.lit(1.0))
    return _series(spark, d).withColumn("xs", F.transform("xs", lambda x: x / top))


@query()
def encode(spark, d):
    z = encoder.encode(_scaled(spark, d), _geo_graph(spark, d), _params(2), FEATURES)
    return z.select("zip", *[F.round(F.get("embedding", F.lit(i)), 6).alias(f"z{i}") for i in range(8)])


@query()
def embedding_fit(spark, d):
    c = encoder.EncoderConfig(2, epochs=20)
    _, history = encoder.fit(_scaled(spark, d), _geo_graph(spark, d), c, FEATURES)
    return spark.createDataFrame(list(enumerate(history)), "epoch int, loss double")


def _zip_graph(spark: SparkSession, d: str) -> tuple[DataFrame, G.Graph]:
    """(zip, vector) of every zip with a usable vector, the smallest where there are several, and the mobility graph of these zips."""
    raw = table(spark, d, "zip_embeddings")
    vector = F.array(*[F.col(c).cast("double") for c in embedding_columns(raw)])
    usable = raw.filter("zip IS NOT NULL").select("zip", vector.alias("vector")).filter(F.coalesce(all_finite(F.col("vector")), F.lit(False)))
    v = materialise(usable.groupBy("zip").agg(F.min("vector").alias("vector")), "vectors")
    return v, G.induced(_mobility(spark, d), v)


def _skater(v: DataFrame, g: G.Graph) -> DataFrame:
    """SKATER with 16 units more than the graph has components, so that cuts are possible whatever the data."""
    forest = materialise(regionalize.spanning_forest(g, v), "forest")
    pieces = v.count() - forest.count()
    return regionalize.run_skater(v, g, regionalize.SkaterConfig(pieces + 16, min_size=10), forest=forest)


@query()
def skater_units(spark, d):
    return _skater(*_zip_graph(spark, d))


@query()
def spectral_units(spark, d):
    return regionalize.spectral_clusters(G.radius_graph(_points(spark, d), 0.01), 8)


@query()
def louvain_units(spark, d):
    return regionalize.louvain(G.radius_graph(_points(spark, d), 0.01))


@query()
def unit_evaluation(spark, d):
    """Method comparison (one row per method), best first by silhouette."""
    v, g = _zip_graph(spark, d)
    ways = {"skater": materialise(_skater(v, g), "units"), "mapping": _labels(spark, d).join(v, "zip", "left_semi")}
    rows = []
    for name, units in ways.items():
        labelled = materialise(v.join(units, "zip"), "labelled")
        units = labelled.select("zip", "unit_id")
        q = metrics.quality_scores(labelled)
        c = metrics.contiguity_score(units, G.induced(g, units))
        rows.append((name, q["silhouette"], q["davies_bouldin"], float(c["connected_fraction"])))
    return spark.createDataFrame(rows, "method string, silhouette double, davies_bouldin double, connected_fraction double")
