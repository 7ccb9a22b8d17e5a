"""Registered queries of sources, checks, sampling, stability, the encoder and the forest, each with its SQL."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api, schema
from ..operators import augment, encoder, metrics, panel, regionalize, skew
from ..operators import graph as G
from ..session import materialise, scratch
from ..sources import shapefile, tables
from ..sources.tables import table
from ..streaming import edges as stream
from .reference import BIAS, DENSE, FEATURES, KERNELS, NBR, ORDER, OWN, PAIRS, POINTS, RADIUS, _draw, _labels, _mobility, _order, _points, _scaled, _series, _zip_graph

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# sources --------------------------------------------------------------------


@query("SELECT src_zip, dst_zip, weight FROM mobility_edges WHERE weight IS NULL OR NOT isnan(weight)")
def edges_csv(spark, d):
    """The edges written as CSV with the columns in another order, read back by name."""
    path = scratch(spark, "edges-csv")
    table(spark, d, "mobility_edges").filter("weight IS NULL OR NOT isnan(weight)").select("weight", "dst_zip", "src_zip").write.option("header", True).csv(path)
    return tables.edges_csv(spark, path)


@query("SELECT edge_id, src_zip, dst_zip, weight FROM mobility_edges WHERE src_zip IS NOT NULL AND dst_zip IS NOT NULL AND src_zip <> dst_zip AND weight >= 0 AND NOT isnan(weight)")
def edge_stream(spark, d):
    """All edge files taken in as a stream, filtered, appended to a table."""
    out, mark = scratch(spark, "edge-stream"), scratch(spark, "edge-stream-mark")
    kept = G.clean_edges(stream.read_edges(spark, f"{d}/mobility_edges.parquet")).select("edge_id", "src_zip", "dst_zip", "weight")
    stream.write_flows(kept, out, mark).awaitTermination()
    return spark.read.schema(kept.schema).parquet(out)


@query("""SELECT strftime(observed_at, '%Y-%m-%d') AS day, src_zip, dst_zip, count(*) AS n, round(sum(weight), 4) AS weight FROM mobility_edges
WHERE src_zip IS NOT NULL AND dst_zip IS NOT NULL AND src_zip <> dst_zip AND weight >= 10 AND NOT isnan(weight) AND observed_at IS NOT NULL GROUP BY 1, 2, 3""")
def edge_flows(spark, d):
    flows = stream.windowed_flows(table(spark, d, "mobility_edges"), threshold=10.0)
    return flows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "src_zip", "dst_zip", "n", F.round("weight", 4).alias("weight"))


def _coverage(spark: SparkSession) -> DataFrame:
    """A shapefile of 12 x 9 squares, each with a square hole that another shape fills, read back."""
    path = scratch(spark, "shapes")
    box = lambda x, y, a, b: [(x + a, y + a), (x + a, y + b), (x + b, y + b), (x + b, y + a)]
    shapes = []
    for i in range(108):
        x, y = float(i % 12), float(i // 12)
        shapes += [(f"S{i:03d}", [box(x, y, 0.0, 1.0), box(x, y, 0.25, 0.75)[::-1]]), (f"T{i:03d}", [box(x, y, 0.25, 0.75)])]
    shapefile.write_shp(spark, f"{path}/cover", shapes)
    return shapefile.polygons_shp(spark, f"{path}/cover.shp", "ZIP")


COVER = "s AS (SELECT i, i // 12 AS r, i % 12 AS c FROM range(108) t(i))"


@query(f"""WITH {COVER} SELECT printf('S%03d', i) AS zip, 4 AS corners, 1 AS holes FROM s UNION ALL SELECT printf('T%03d', i), 4, 0 FROM s""")
def shapefile_polygons(spark, d):
    return _coverage(spark).select("zip", F.size("ring").alias("corners"), F.size("holes").alias("holes"))


@query(f"""WITH {COVER} SELECT printf('S%03d', a.i) AS src, printf('S%03d', b.i) AS dst, 1.0::DOUBLE AS weight FROM s a JOIN s b ON abs(a.r - b.r) + abs(a.c - b.c) = 1
UNION ALL SELECT printf('S%03d', i), printf('T%03d', i), 1.0 FROM s UNION ALL SELECT printf('T%03d', i), printf('S%03d', i), 1.0 FROM s""")
def shapefile_contiguity(spark, d):
    return G.contiguity_graph(_coverage(spark), "rook").edges


# checks ---------------------------------------------------------------------


@query("SELECT zip, count(*) AS n FROM zip_embeddings GROUP BY zip HAVING count(*) > 1")
def repeated_zips(spark, d):
    return schema.repeated(table(spark, d, "zip_embeddings"), "zip")


USABLE = "zip IS NOT NULL AND isfinite(e0) AND isfinite(e1) AND isfinite(e2) AND isfinite(e3) AND isfinite(e4) AND isfinite(e5) AND isfinite(e6) AND isfinite(e7)"
ATTRIBUTES = "attr AS (SELECT zip, max(population) AS population, max(sales) AS sales FROM zip_attributes GROUP BY zip HAVING max(population) IS NOT NULL AND max(sales) IS NOT NULL)"


@query(f"""WITH {ATTRIBUTES}, v AS (SELECT DISTINCT * FROM zip_embeddings WHERE {USABLE})
SELECT v.zip, {", ".join(f"e{i}" for i in range(8))}, population::DOUBLE AS e8, sales::DOUBLE AS e9 FROM v JOIN attr ON v.zip = attr.zip""")
def embedding_attributes(spark, d):
    """Embeddings with the attributes appended, unscaled."""
    attributes = table(spark, d, "zip_attributes").groupBy("zip").agg(F.max("population").alias("population"), F.max("sales").alias("sales")).filter("population IS NOT NULL AND sales IS NOT NULL")
    wide = table(spark, d, "zip_embeddings").filter("zip IS NOT NULL").distinct().join(attributes, "zip")
    rows = schema.from_wide(wide, extra=("population", "sales")).filter(schema.all_finite(F.col("embedding")))
    return schema.to_wide(rows, 10)


@query(f"""WITH {PAIRS.replace('>= 10 ', '>= 100 ')}, {ORDER}, gone AS (SELECT zip, row_number() OVER (ORDER BY zip) AS r, count(*) OVER () AS n FROM ord WHERE zip NOT IN (SELECT src FROM edges))
SELECT zip, n AS n_missing FROM gone WHERE r <= 5""")
def first_missing_ids(spark, d):
    """The zips that an error names: the first five that the graph lacks."""
    gone = G.missing_nodes(_mobility(spark, d, least=100.0), _order(spark, d))
    return gone.orderBy("zip").limit(5).crossJoin(F.broadcast(gone.agg(F.count(F.lit(1)).alias("n_missing"))))


@query(f"""WITH {PAIRS}, {ORDER}, n AS (SELECT DISTINCT src AS zip FROM edges)
SELECT NOT EXISTS (SELECT zip FROM ord EXCEPT SELECT zip FROM n) AND NOT EXISTS (SELECT zip FROM n EXCEPT SELECT zip FROM ord) AS as_listed, true AS as_itself""")
def graph_same_nodes(spark, d):
    g = _mobility(spark, d)
    return spark.createDataFrame([(G.same_nodes(g, _order(spark, d)), G.same_nodes(g, g.nodes))], "as_listed boolean, as_itself boolean")


def _refusal(run) -> str:
    try:
        run()
    except ValueError as e:
        return str(e)
    return "accepted"


@query(f"""WITH {PAIRS.replace('>= 10 ', '>= 100 ')}, {ORDER},
gone AS (SELECT zip FROM ord WHERE zip NOT IN (SELECT src FROM edges) ORDER BY zip LIMIT 5),
lost AS (SELECT DISTINCT zip FROM mapping m WHERE zip IS NOT NULL AND NOT EXISTS (SELECT 1 FROM zip_attributes a WHERE a.zip = m.zip AND a.sales >= 0)),
five AS (SELECT zip FROM lost ORDER BY zip LIMIT 5)
SELECT 'missing column' AS check_name, 'missing columns: [''elsewhere'']' AS refusal
UNION ALL SELECT 'text column', 'columns must be numeric: [''lang'']'
UNION ALL SELECT 'repeated zip', 'zip is not unique'
UNION ALL SELECT 'empty panel', 'the panel is empty'
UNION ALL SELECT 'no unit', 'n_clusters must lie between 1 and the number of zips'
UNION ALL SELECT 'other zips', 'vectors and graph must name the same zips'
UNION ALL SELECT 'zips not in the graph', (SELECT 'zips not in the graph: [' || string_agg('''' || zip || '''', ', ' ORDER BY zip) || '] ...' FROM gone)
UNION ALL SELECT 'zips without attributes', (SELECT 'zips without attributes: [' || string_agg('''' || zip || '''', ', ' ORDER BY zip) || ']' || (SELECT CASE WHEN count(*) > 5 THEN ' ...' ELSE '' END FROM lost) FROM five)""")
def refusals(spark, d):
    """What the operators refuse, and how they say so."""
    vectors, g = _zip_graph(spark, d)
    skater = lambda v, k: regionalize.run_skater(v, g, regionalize.SkaterConfig(k))
    mapping, attributes = table(spark, d, "mapping").filter("zip IS NOT NULL"), table(spark, d, "zip_attributes").filter("sales >= 0")
    daily = table(spark, d, "timeseries").select("geo_id", "date", "spend")
    runs = {
        "missing column": lambda: schema.require_columns(mapping, "zip", "elsewhere"),
        "text column": lambda: schema.require_numeric(table(spark, d, "documents"), "lang", "n_chars"),
        "repeated zip": lambda: schema.require_unique(table(spark, d, "zip_embeddings"), "zip"),
        "empty panel": lambda: panel.dense_series(daily.limit(0)),
        "no unit": lambda: skater(vectors, 0),
        "other zips": lambda: skater(vectors.filter(F.col("zip") != vectors.agg(F.min("zip")).first()[0]), 2),
        "zips not in the graph": lambda: G.align_graph(_mobility(spark, d, least=100.0), _order(spark, d)),
        "zips without attributes": lambda: metrics.cluster_summary(mapping, attributes),
    }
    return spark.createDataFrame([(name, _refusal(run)) for name, run in runs.items()], "check_name string, refusal string")


# sampling, stability, evaluation --------------------------------------------


@query(f"SELECT vec_id AS zip, label AS unit_id FROM embeddings ORDER BY {_draw(42, 'sample', 'vec_id')}, vec_id LIMIT 100")
def exact_sample(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("zip"), F.col("label").alias("unit_id"))
    return metrics.sample(rows, 100, 42)


STABILITY = """m AS (SELECT zip, min(unit_id) AS a, max(unit_id) // 2 AS b FROM mapping WHERE zip IS NOT NULL AND unit_id IS NOT NULL GROUP BY zip),
c AS (SELECT a, b, count(*)::DOUBLE AS n FROM m GROUP BY 1, 2),
s AS (SELECT (SELECT sum(n) FROM c) AS n, (SELECT sum(n * n) FROM c) AS ab,
  (SELECT sum(k * k) FROM (SELECT sum(n) AS k FROM c GROUP BY a)) AS aa, (SELECT sum(k * k) FROM (SELECT sum(n) AS k FROM c GROUP BY b)) AS bb),
p AS (SELECT ab - n AS tp, aa - ab AS fp, bb - ab AS fn, n * n - aa - bb + ab AS tn FROM s)"""


@query(f"""WITH {STABILITY} SELECT round(2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)), 9) AS ari, round(tp / (tp + fp + fn), 9) AS jaccard,
  1.0::DOUBLE AS own_ari, 1.0::DOUBLE AS own_jaccard FROM p""")
def partition_stability(spark, d):
    m = table(spark, d, "mapping").filter("zip IS NOT NULL AND unit_id IS NOT NULL").groupBy("zip").agg(F.min("unit_id").alias("a"), F.expr("max(unit_id) div 2").alias("b"))
    a, b = m.select("zip", F.col("a").alias("unit_id")), m.select("zip", F.col("b").alias("unit_id"))
    two, own = metrics.partition_stability(a, b), metrics.partition_stability(a, a)
    return spark.createDataFrame([(round(two["ari"], 9), round(two["jaccard"], 9), own["ari"], own["jaccard"])], "ari double, jaccard double, own_ari double, own_jaccard double")


def _method_sql(name: str, k: int) -> str:
    """CTEs ``<name>_row``: one row of scores of the assignment pos % k."""
    return f"""{name} AS (SELECT v.zip, e, pos % {k} AS u FROM v JOIN ord ON v.zip = ord.zip),
{name}_d AS (SELECT a.zip, a.u AS own, b.u AS other, sum(list_distance(a.e, b.e)) AS s, count(*) AS n FROM {name} a JOIN {name} b ON true GROUP BY 1, 2, 3),
{name}_p AS (SELECT zip, max(CASE WHEN other = own THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN other <> own THEN s / n END) AS b FROM {name}_d GROUP BY zip),
{name}_x AS (SELECT zip, u, unnest(range(8)) AS j, unnest(e) AS x FROM {name}),
{name}_c AS (SELECT u, j, avg(x) AS m FROM {name}_x GROUP BY 1, 2),
{name}_s AS (SELECT u, avg(r) AS s FROM (SELECT zip, x.u, sqrt(sum(pow(x - m, 2))) AS r FROM {name}_x x JOIN {name}_c c ON x.u = c.u AND x.j = c.j GROUP BY 1, 2) GROUP BY 1),
{name}_g AS (SELECT a.u AS i, b.u AS k, sqrt(sum(pow(a.m - b.m, 2))) AS g FROM {name}_c a JOIN {name}_c b ON a.j = b.j AND a.u <> b.u GROUP BY 1, 2),
{name}_e AS (SELECT e.src, e.dst FROM edges e JOIN {name} a ON e.src = a.zip JOIN {name} b ON e.dst = b.zip AND a.u = b.u),
{name}_r(zip, other) AS (SELECT zip, zip FROM {name} UNION SELECT r.zip, w.dst FROM {name}_r r JOIN {name}_e w ON w.src = r.other),
{name}_k AS (SELECT u, count(DISTINCT o) AS parts FROM (SELECT zip, min(other) AS o FROM {name}_r GROUP BY zip) JOIN {name} USING (zip) GROUP BY u),
{name}_row AS (SELECT '{name}' AS method, (SELECT round(avg((b - a) / greatest(a, b)), 6) FROM {name}_p) AS silhouette,
  (SELECT round(avg(w), 6) FROM (SELECT i, max((si.s + sk.s) / g) AS w FROM {name}_g JOIN {name}_s si ON si.u = i JOIN {name}_s sk ON sk.u = k GROUP BY i)) AS davies_bouldin,
  (SELECT round(avg(CASE WHEN parts = 1 THEN 1.0 ELSE 0.0 END), 6) FROM {name}_k)::DOUBLE AS connected_fraction, (SELECT count(*) FROM {name}_k)::BIGINT AS n_clusters)"""


EVALUATION = f"""WITH RECURSIVE {PAIRS}, {ORDER}, v AS (SELECT zip, min([{", ".join(f"e{i}" for i in range(8))}]) AS e FROM zip_embeddings WHERE {USABLE} GROUP BY zip),
{_method_sql("coarse", 4)}, {_method_sql("fine", 9)}"""


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    v, g = _zip_graph(spark, d)
    labels = materialise(_labels(spark, d).join(v, "zip", "left_semi"), "labels")
    ways = {name: labels.select("zip", (F.col("unit_id") % k).alias("unit_id")) for name, k in (("coarse", 4), ("fine", 9))}
    scores = api.evaluate_units(ways, v, G.induced(g, labels))
    return scores.select("method", *[F.round(c, 6).alias(c) for c in ("silhouette", "davies_bouldin", "connected_fraction")], "n_clusters")


@query(f"{EVALUATION} SELECT * FROM coarse_row UNION ALL SELECT * FROM fine_row")
def assignment_evaluation(spark, d):
    return _evaluated(spark, d)


@query(f"{EVALUATION} SELECT * FROM (SELECT * FROM coarse_row UNION ALL SELECT * FROM fine_row) ORDER BY silhouette DESC, method LIMIT 1")
def best_assignment(spark, d):
    """The best method's scores, written and read back."""
    path = scratch(spark, "best")
    tables.write(regionalize.select_best(_evaluated(spark, d), "silhouette"), path)
    return spark.read.parquet(path)


@query(f"""WITH {PAIRS}, {ORDER}, e AS (SELECT a.pos AS x, b.pos AS y, weight AS w FROM edges JOIN ord a ON src = a.zip JOIN ord b ON dst = b.zip),
k AS (SELECT x, sum(w) AS k, sum(CASE WHEN x = y THEN w ELSE 0 END) AS i FROM e GROUP BY x)
SELECT round(sum(i) / sum(k) - sum(k * k) / (sum(k) * sum(k)), 9) AS modularity FROM k""")
def modularity(spark, d):
    return spark.createDataFrame([(round(regionalize.modularity(_mobility(spark, d), _labels(spark, d)), 9),)], "modularity double")


# forest and units -----------------------------------------------------------


def _boruvka_sql(rounds: int = 9) -> str:
    """CTEs of a spanning forest by rounds of cheapest edges; ``f<rounds>`` has its edges, ``l<rounds>`` each zip's component."""
    costs = " + ".join(f"pow(x.v[{i}] - y.v[{i}], 2)" for i in range(1, 9))
    out = [
        PAIRS,
        f"v AS (SELECT zip, min([{', '.join(f'e{i}' for i in range(8))}]) AS v FROM zip_embeddings WHERE {USABLE} GROUP BY zip)",
        f"e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY c, a, b) AS r, a, b, c FROM (SELECT a, b, {costs} AS c FROM pairs JOIN v x ON a = x.zip JOIN v y ON b = y.zip))",
        "l0 AS MATERIALIZED (SELECT zip, zip AS comp FROM v)",
        "f0 AS MATERIALIZED (SELECT r FROM e WHERE false)",
    ]
    for k in range(rounds):
        out += [
            f"o{k} AS MATERIALIZED (SELECT r, x.comp AS p, y.comp AS q FROM e JOIN l{k} x ON a = x.zip JOIN l{k} y ON b = y.zip WHERE x.comp <> y.comp)",
            f"t{k} AS MATERIALIZED (SELECT DISTINCT r, p, q FROM o{k} WHERE r IN (SELECT min(r) FROM (SELECT p AS z, r FROM o{k} UNION ALL SELECT q, r FROM o{k}) GROUP BY z))",
            f"f{k + 1} AS MATERIALIZED (SELECT r FROM f{k} UNION SELECT r FROM t{k})",
            f"w{k}(z, other) AS (SELECT DISTINCT comp, comp FROM l{k} UNION SELECT w.z, s.q FROM w{k} w JOIN (SELECT p, q FROM t{k} UNION ALL SELECT q, p FROM t{k}) s ON s.p = w.other)",
            f"l{k + 1} AS MATERIALIZED (SELECT zip, m AS comp FROM l{k} JOIN (SELECT z, min(other) AS m FROM w{k} GROUP BY z) ON z = comp)",
        ]
    return "WITH RECURSIVE " + ",\n".join(out)


@query(f"{_boruvka_sql()} SELECT a, b, round(c, 6) AS cost FROM e JOIN f9 USING (r)")
def spanning_forest(spark, d):
    v, g = _zip_graph(spark, d)
    return regionalize.spanning_forest(g, v).withColumn("cost", F.round("cost", 6))


@query(f"""{_boruvka_sql()}, k AS (SELECT count(DISTINCT comp) AS n FROM l9) SELECT (n + 16)::BIGINT AS n_units, (n + 16)::BIGINT AS n_connected, (SELECT count(*) FROM v) AS n_zips, true AS large_enough FROM k""")
def skater_contract(spark, d):
    """What SKATER promises: K units, each connected, all zips, and the cut units (those of components that were cut) of at least min_size."""
    v, g = _zip_graph(spark, d)
    forest = regionalize.spanning_forest(g, v)
    pieces = v.count() - forest.count()
    units = regionalize.run_skater(v, g, regionalize.SkaterConfig(pieces + 16, min_size=10))
    per = metrics.contiguity(units, g)
    parts = G.components(g).join(units, "zip").groupBy("component").agg(F.count_distinct("unit_id").alias("cuts"), F.min("unit_id").alias("one"), F.array_distinct(F.collect_set("unit_id")).alias("units")).filter("cuts > 1")
    cut = parts.select(F.explode("units").alias("unit_id")).join(per, "unit_id").agg(F.coalesce(F.min("n_zips") >= 10, F.lit(True)).alias("large_enough"))
    total = per.agg(F.count(F.lit(1)).alias("n_units"), F.sum((F.col("n_components") == 1).cast("bigint")).alias("n_connected"), F.sum("n_zips").alias("n_zips"))
    return total.crossJoin(cut)


PARTS = f"""WITH RECURSIVE {RADIUS}, r(zip, other) AS (SELECT geo_id, geo_id FROM pts UNION SELECT r.zip, e.dst FROM r JOIN edges e ON e.src = r.other),
comp AS (SELECT zip, min(other) AS first_zip FROM r GROUP BY zip),
size AS (SELECT first_zip, count(*) AS n FROM comp GROUP BY 1),
inner_edges AS (SELECT first_zip, count(*) AS m FROM edges JOIN comp ON src = zip GROUP BY 1)"""


def _radius_parts(spark: SparkSession, d: str) -> tuple[G.Graph, DataFrame, DataFrame]:
    """(radius graph, (zip, first_zip) of its components, their (first_zip, n, m) of nodes and directed edges)."""
    g = G.radius_graph(_points(spark, d), 0.01)
    found = G.components(g).withColumnRenamed("component", "first_zip")
    return g, found, found.join(G.node_strength(g), "zip").groupBy("first_zip").agg(F.count(F.lit(1)).alias("n"), F.sum("degree").alias("m"))


def _first_of_unit(units: DataFrame) -> DataFrame:
    return units.join(units.groupBy("unit_id").agg(F.min("zip").alias("first_zip")), "unit_id").select("zip", "first_zip")


@query(f"{PARTS} SELECT zip, first_zip FROM comp JOIN size USING (first_zip) JOIN inner_edges USING (first_zip) WHERE m = n * (n - 1)")
def louvain_cliques(spark, d):
    """Communities of the components in which all are neighbours: the components, since a cut within would lower modularity."""
    g, found, sizes = _radius_parts(spark, d)
    cliques = found.join(sizes.filter("n > 1 AND m = n * (n - 1)"), "first_zip")
    return _first_of_unit(regionalize.louvain(G.induced(g, cliques)))


@query(f"{PARTS} SELECT zip, first_zip FROM comp WHERE first_zip IN (SELECT first_zip FROM size ORDER BY n DESC, first_zip LIMIT 4)")
def spectral_components(spark, d):
    """Four clusters of the four largest components: the components, the leading eigenvectors being constant on each."""
    g, found, sizes = _radius_parts(spark, d)
    largest = found.join(sizes.orderBy(F.desc("n"), "first_zip").limit(4), "first_zip")
    return _first_of_unit(regionalize.spectral_clusters(G.induced(g, largest), 4))


# windows and augmentation ---------------------------------------------------


@query(f"""WITH {DENSE}, g AS (SELECT geo_id, row_number() OVER (ORDER BY geo_id) - 1 AS p FROM (SELECT DISTINCT geo_id FROM daily))
SELECT s.geo_id, feature, 3 AS window_idx, list_sum(xs[16:25])::DOUBLE AS input_sum, xs[26]::DOUBLE AS next_value FROM series s JOIN g ON s.geo_id = g.geo_id
WHERE p = (2 * ((len(xs) - 11) // 5 + 1) + 3) // ((len(xs) - 11) // 5 + 1)""")
def window_item(spark, d):
    series = _series(spark, d)
    per_geo = panel.window_count(series.select(F.size("xs").alias("n")).first().n, 11, 5)
    windows = panel.autoregressive_windows(series, 10, 1, 5)
    at = panel.item(windows, skew.positions(series, "geo_id", "geo_pos"), 2 * per_geo + 3, per_geo)
    total = F.aggregate(F.col("input").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return at.select("geo_id", "feature", "window_idx", total.alias("input_sum"), F.get("target", F.lit(0)).cast("double").alias("next_value"))


@query(f"""WITH {DENSE}, n AS (SELECT count(*)::BIGINT AS rows_in, max(len(xs))::BIGINT AS steps FROM series),
l AS (SELECT unnest(['jitter', 'mask', 'crop', 'mask', 'jitter']) AS method, unnest(['noise_std=0.2', 'mask_mode=contiguous,mask_prob=0.25', 'crop_ratio=0.5', 'mask_prob=0.5', 'noise_std=0.01']) AS params, unnest(range(5)) AS entry)
SELECT (entry - 1)::INT AS entry, method, params, rows_in::INT AS rows_in, steps::INT AS steps_in, rows_in::INT AS rows_out, steps::INT AS steps_out FROM l, n WHERE entry >= 1""")
def augmentation_log(spark, d):
    """The last four entries of the log after five augmentations of the series."""
    log = augment.get_augmentation_logger()
    log.clear_logs()
    s = _series(spark, d)
    for method, params in (("jitter", {"noise_std": 0.2}), ("mask", {"mask_prob": 0.25, "mask_mode": "contiguous"}), ("crop", {"crop_ratio": 0.5}), ("mask", {"mask_prob": 0.5}), ("jitter", {"noise_std": 0.01})):
        augment.augment(s, method, "geo_id", **params)
    rows = [(i, e["method"], ",".join(f"{k}={v}" for k, v in sorted(e["params"].items())), *e["input_shape"], *e["output_shape"]) for i, e in enumerate(log.get_logs(last=4))]
    log.clear_logs()
    return spark.createDataFrame(rows, "entry int, method string, params string, rows_in int, steps_in int, rows_out int, steps_out int")


# encoder --------------------------------------------------------------------

DEC, DEC_BIAS = [[0.5, -0.25, 0.125], [0.25, 0.5, -0.5]], [0.125, -0.25]
SCALED = f"""{DENSE}, top AS (SELECT geo_id, feature, greatest(max(x), 1.0) AS top FROM long GROUP BY 1, 2),
p AS MATERIALIZED (SELECT geo_id, t, max(CASE WHEN feature = 'readings' THEN x / top END) AS r, max(CASE WHEN feature = 'clicks' THEN x / top END) AS c FROM long JOIN top USING (geo_id, feature) GROUP BY 1, 2),
size AS (SELECT count(*) AS n FROM axis), {POINTS},
near AS (SELECT a.geo_id AS src, b.geo_id AS dst FROM pts a JOIN pts b ON a.geo_id <> b.geo_id
  QUALIFY row_number() OVER (PARTITION BY a.geo_id ORDER BY pow(a.latitude - b.latitude, 2) + pow(a.longitude - b.longitude, 2), b.geo_id) <= 4),
edges AS MATERIALIZED (SELECT src, dst FROM near UNION SELECT dst, src FROM near)"""


def _model_sql(name: str, low: str, n: str) -> str:
    """CTEs ``<name>_t`` (zip, h0, h1) and ``<name>`` (zip, z0, z1, z2) of the steps low .. low + n - 1."""
    row = lambda o: " + ".join(f"({w}) * coalesce({side}.{f}, 0)" for f, ws in zip("rc", KERNELS[o]) for w, side in zip(ws, "ab")) + f" + ({BIAS[o]})"
    z = lambda i: f"greatest(0, ({OWN[i][0]}) * h0 + ({OWN[i][1]}) * h1 + ({NBR[i][0]}) * s0 + ({NBR[i][1]}) * s1) AS z{i}"
    return f"""{name}_s AS (SELECT geo_id, unnest(range({n} + 1)) AS s FROM (SELECT DISTINCT geo_id FROM p), size),
{name}_t AS MATERIALIZED (SELECT k.geo_id AS zip, avg(greatest(0, {row(0)})) AS h0, avg(greatest(0, {row(1)})) AS h1 FROM {name}_s k CROSS JOIN size
  LEFT JOIN p a ON a.geo_id = k.geo_id AND a.t = {low} + s - 1 AND s >= 1 LEFT JOIN p b ON b.geo_id = k.geo_id AND b.t = {low} + s AND s < {n} GROUP BY 1),
{name}_n AS (SELECT src AS zip, sum(h0) AS s0, sum(h1) AS s1 FROM edges JOIN {name}_t ON dst = zip GROUP BY src),
{name} AS MATERIALIZED (SELECT t.zip, h0, h1, {z(0)}, {z(1)}, {z(2)} FROM (SELECT t.zip, h0, h1, coalesce(s0, 0) AS s0, coalesce(s1, 0) AS s1 FROM {name}_t t LEFT JOIN {name}_n n ON t.zip = n.zip) t)"""


WHOLE = f"WITH {SCALED}, {_model_sql('m', '0', 'n')}"


@lru_cache(maxsize=1)
def _model() -> dict:
    import numpy as np

    return {"kernel": np.array(KERNELS), "bias": np.array(BIAS), "own": np.array(OWN), "nbr": np.array(NBR), "dec": np.array(DEC), "dec_bias": np.array(DEC_BIAS)}


def _loaded(spark: SparkSession) -> dict:
    """The model written as a table and loaded back."""
    path = scratch(spark, "model")
    tables.write(encoder.params_frame(spark, _model()), path)
    return encoder.load_params(spark.read.parquet(path))


@query(f"{WHOLE} SELECT zip, round(h0, 6) AS h0, round(h1, 6) AS h1 FROM m_t")
def temporal_features(spark, d):
    t = encoder.temporal_features(_scaled(spark, d), _loaded(spark), FEATURES)
    return t.select("zip", *[F.round(F.get("vec", F.lit(i)), 6).alias(f"h{i}") for i in range(2)])


@query(f"{WHOLE} SELECT zip, round(z0, 6) AS z0, round(z1, 6) AS z1, round(z2, 6) AS z2 FROM m")
def encode_loaded(spark, d):
    """All geos' embeddings by a loaded model: temporal features, then the graph layer over the nearest geos."""
    z = encoder.encode(_scaled(spark, d), G.knn_graph(_points(spark, d), 4), _loaded(spark), FEATURES)
    return z.select("zip", *[F.round(F.get("embedding", F.lit(i)), 6).alias(f"z{i}") for i in range(3)])


LOSSES = f"""{WHOLE}, {_model_sql('past', '0', '(n // 2)')}, {_model_sql('later', '(n // 2)', '(n - n // 2)')},
rec AS (SELECT avg(({" + ".join(f"pow({' + '.join(f'({w}) * z{j}' for j, w in enumerate(DEC[i]))} + ({DEC_BIAS[i]}) - h{i}, 2)" for i in range(2))}) / 2) AS v FROM m),
pre AS (SELECT avg(({" + ".join(f"pow(a.z{i} - b.z{i}, 2)" for i in range(3))}) / 3) AS v FROM past a JOIN later b ON a.zip = b.zip),
parts AS (SELECT 'reconstruction' AS loss, v FROM rec UNION ALL SELECT 'predictive', v FROM pre UNION ALL SELECT 'total', rec.v + 0.5 * pre.v FROM rec, pre)"""


@query(f"{LOSSES} SELECT loss, round(v, 6) AS value FROM parts")
def validation_losses(spark, d):
    c = encoder.EncoderConfig(2, 2, 2, 3, loss_type="multi", loss_weights={"reconstruction": 1.0, "predictive": 0.5})
    found = encoder.validation_losses(_scaled(spark, d), G.knn_graph(_points(spark, d), 4), _model(), c, FEATURES)
    return found.select("loss", F.round("value", 6).alias("value"))
