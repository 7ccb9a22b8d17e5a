import datetime as dt

import pytest

from spatialpanel import api
from spatialpanel.streaming import edges


def test_stream_equals_batch_and_drops_late_rows(spark, tmp_path):
    t = lambda d, h: dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h)
    first = [(1, "A", "B", 1.0, t(0, 1), t(0, 2)), (2, "A", "B", 2.0, t(0, 5), t(0, 6)), (2, "A", "B", 2.0, t(0, 5), t(0, 6)), (3, "A", "A", 1.0, t(0, 1), t(0, 1)), (4, "A", "C", float("nan"), t(1, 1), t(1, 1)), (5, "B", "C", 4.0, t(1, 1), t(1, 1))]
    later = [(6, "B", "C", 1.0, t(30, 1), t(30, 1)), (7, "B", "C", 1.0, t(60, 1), t(60, 1))]
    for i, rows in enumerate((first, later, [(8, "A", "B", 100.0, t(0, 3), t(61, 0))])):
        spark.createDataFrame(rows, edges.EDGE_SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    for i in range(3):
        (tmp_path / "flat").mkdir(exist_ok=True)
        next((tmp_path / f"in/{i}").glob("part-*.parquet")).rename(tmp_path / f"flat/{i}.parquet")
        q = edges.write_flows(edges.windowed_flows(edges.read_edges(spark, str(tmp_path / "flat"), files_per_trigger=1)), str(tmp_path / "out"), str(tmp_path / "ck"))
        assert q.awaitTermination(120)
    got = {(str(r.start)[:10], r.src_zip, r.dst_zip): (r.n, r.weight) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("2024-01-01", "A", "B"): (2, 3.0), ("2024-01-02", "B", "C"): (1, 4.0), ("2024-01-31", "B", "C"): (1, 1.0)}
    batch = edges.windowed_flows(spark.createDataFrame(first, edges.EDGE_SCHEMA))
    assert batch.count() == 2


def test_api_names_and_adjacency(spark):
    assert {"mobility_graph", "run_skater", "quality_scores", "near_pairs"} <= set(api.__all__)
    df = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 0.0), ("c", 5.0, 0.0)], "geo_id string, latitude double, longitude double")
    assert api.adjacency(df, "knn", 1).edges.count() == 4 and api.adjacency(df, "radius", radius=2.0).edges.count() == 2
    for bad in ("radius", "other"):
        with pytest.raises(ValueError):
            api.adjacency(df, bad)
