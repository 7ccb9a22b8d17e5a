"""SQL counterparts of the queries of this subpackage."""

EDGES = r"""low AS (SELECT record_id, lower(record) AS r FROM edge_records WHERE record IS NOT NULL AND record_id IS NOT NULL),
f AS (SELECT record_id,
  regexp_replace(regexp_extract(r, '(?s)src[^a-z0-9]*zip(.*?)(dst[^a-z0-9]*zip|weight|$)', 1), '[^a-z0-9]+', '', 'g') AS src_zip,
  regexp_replace(regexp_extract(r, '(?s)dst[^a-z0-9]*zip(.*?)(src[^a-z0-9]*zip|weight|$)', 1), '[^a-z0-9]+', '', 'g') AS dst_zip,
  replace(regexp_extract(regexp_extract(r, '(?s)weight(.*?)(src[^a-z0-9]*zip|dst[^a-z0-9]*zip|$)', 1), '[-+]?[0-9][0-9,]*(\.[0-9]+)?'), ',', '') AS w FROM low),
e AS (SELECT record_id, src_zip, dst_zip, CASE WHEN w = '' THEN '' ELSE regexp_replace(regexp_replace(w::DECIMAL(38,12)::VARCHAR, '0+$', ''), '\.$', '') END AS weight FROM f)"""

VECTORS = """ok AS (SELECT DISTINCT * FROM zip_embeddings WHERE zip IS NOT NULL AND isfinite(e0) AND isfinite(e1) AND isfinite(e2) AND isfinite(e3)
  AND isfinite(e4) AND isfinite(e5) AND isfinite(e6) AND isfinite(e7)),
near AS (SELECT a.zip, min(b.zip) AS cluster FROM ok a JOIN ok b ON abs(a.e0 - b.e0) <= 1 AND abs(a.e1 - b.e1) <= 1
  AND pow(a.e0-b.e0,2)+pow(a.e1-b.e1,2)+pow(a.e2-b.e2,2)+pow(a.e3-b.e3,2)+pow(a.e4-b.e4,2)+pow(a.e5-b.e5,2)+pow(a.e6-b.e6,2)+pow(a.e7-b.e7,2) <= 1 GROUP BY a.zip)"""

SPANS = """d AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS w FROM documents),
i AS (SELECT item_id, kind, regexp_extract_all(text, '[A-Za-z0-9]+') AS w FROM eval_items),
ds AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda p: lower(array_to_string(w[p:p + 11], ' ')))) AS s FROM d),
items AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda p: lower(array_to_string(w[p:p + 11], ' ')))) AS s FROM i),
leaks AS (SELECT DISTINCT doc_id, item_id FROM ds JOIN items ON ds.s = items.s)"""

SQL = {
    "p6_found": f"""WITH {EDGES}, k AS (SELECT record_id, min(record_id) OVER (PARTITION BY src_zip, dst_zip, weight) AS keep_id FROM e)
SELECT keep_id, record_id FROM k WHERE keep_id <> record_id""",
    "p6_records": f"""WITH {EDGES}
SELECT min(record_id) AS keep_id, src_zip, dst_zip, weight, count(*) AS n_copies FROM e GROUP BY src_zip, dst_zip, weight""",
    "p8_found": f"WITH {SPANS} SELECT * FROM leaks",
    "p8_items": f"WITH {SPANS} SELECT i.item_id, i.kind, count(doc_id) AS n_docs FROM i LEFT JOIN leaks ON i.item_id = leaks.item_id GROUP BY i.item_id, i.kind",
    "p7_units": f"WITH {VECTORS} SELECT DISTINCT zip, dense_rank() OVER (ORDER BY cluster) - 1 AS unit_id FROM near",
    "p7_summary": f"""WITH {VECTORS}, m AS (SELECT ok.*, cluster FROM ok JOIN near ON ok.zip = near.zip),
c AS (SELECT cluster, count(DISTINCT zip) AS size, {", ".join(f"avg(e{i}) AS c{i}" for i in range(8))} FROM m GROUP BY cluster),
t AS (SELECT m.cluster, size, zip, min({" + ".join(f"pow(e{i} - c{i}, 2)" for i in range(8))}) AS d2 FROM m JOIN c ON m.cluster = c.cluster GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(d2, 9), zip) AS k FROM t)
SELECT cluster, size, max(CASE WHEN k = 1 THEN zip END) AS typical_1, max(CASE WHEN k = 2 THEN zip END) AS typical_2, max(CASE WHEN k = 3 THEN zip END) AS typical_3
FROM r GROUP BY cluster, size""",
    "p7_found": f"WITH {VECTORS} SELECT cluster AS cluster_zip, zip FROM near WHERE zip > cluster",
}
