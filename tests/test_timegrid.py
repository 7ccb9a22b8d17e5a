import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from spatialpanel.operators import timegrid as tg

SCHEMA = "reading_id bigint, geo_id string, date timestamp_ntz, spend double, impressions bigint, clicks bigint, received_at timestamp_ntz, value string, _n int"


def at(day, hour=12, minute=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour, minutes=minute)


def rows(spark, data):
    """data: (id, geo, time, spend, clicks, received); with columns of clashing names added."""
    return spark.createDataFrame([(i, g, t, s, 1, c, r, "x", 1) for i, g, t, s, c, r in data], SCHEMA)


def test_standing_row_is_latest_received_then_largest_id(spark):
    df = rows(spark, [(1, "A", at(0), 1.0, 1, at(1)), (2, "A", at(0), 2.0, 1, at(2)), (3, "A", at(0), 3.0, 1, at(2)), (4, "A", at(0), 9.0, 1, None), (5, "A", at(1), 5.0, 1, at(1)), (6, "A", at(1), None, 1, at(3)), (7, None, at(1), 1.0, 1, at(1)), (8, "B", at(-1), 1.0, 1, at(1)), (9, "B", at(150), 1.0, 1, at(1)), (10, "C", at(0), math.nan, 1, at(0))])
    got = [(r.geo_id, r.reading_id, r.spend) for r in tg.usable_readings(df, ["spend"]).collect()]
    assert got == [("A", 3, 3.0)]  # the withdrawn reading of day 1 is not replaced by its older version


def grid(df, **kw):
    return {(r.geo_id, r.cell - 19723): (r.n_readings, r.value, r.status) for r in tg.regular_grid(df, "geo_id", "date", "spend", **kw).collect()}


def test_grid_interpolates_by_time_and_marks_gaps(spark):
    df = rows(spark, [(1, "A", at(0, 12), 10.0, 1, None), (2, "A", at(2, 0), 25.0, 1, None), (3, "A", at(9, 18), 40.0, 1, None), (4, "B", at(3, 18), 7.0, 1, None), (5, None, at(3), 7.0, 1, None), (6, "C", at(3), None, 1, None), (7, "C", None, 1.0, 1, None), (8, "C", at(4), math.nan, 1, None)])
    g = grid(df)
    assert g[("A", 0)] == (1, 10.0, "observed")
    assert g[("A", 1)] == (0, 20.0, "interpolated")  # 24 of 36 hours from 10 to 25
    assert g[("A", 2)][0::2] == (1, "observed") and g[("A", 2)][1] is None  # next reading is over 3 days away
    assert all(g[("A", d)] == (0, None, "gap") for d in range(3, 9))
    assert g[("A", 9)][0] == 1 and len([k for k in g if k[0] == "A"]) == 10
    assert g[("B", 3)] == (1, 7.0, "observed")  # only neighbour, 6 hours away
    assert ("C", 3) not in g and (None, 3) not in g


def test_grid_same_time_and_repeated_rows(spark):
    df = rows(spark, [(1, "A", at(0, 12), 1.0, 1, None), (2, "A", at(0, 12), 3.0, 1, None), (2, "A", at(0, 12), 3.0, 1, None)])
    assert grid(df) == {("A", 0): (3, 3.0, "observed")}


def test_grid_long_gap_and_fine_step(spark):
    df = rows(spark, [(1, "A", at(0, 0), 0.0, 1, None), (2, "A", at(3, 0), 72.0, 1, None)])
    out = tg.regular_grid(df, "geo_id", "date", "spend", step_us=60_000_000, gap_us=4 * tg.DAY_US, offset_us=0)
    assert out.count() == 3 * 1440 + 1
    assert out.filter(F.abs(F.col("value") - (F.col("cell") - 19723 * 1440) / 60.0) > 1e-9).count() == 0


def test_rolling_matches_brute_force(spark):
    import random

    r = random.Random(3)
    days = {g: sorted(r.sample(range(80), r.choice([1, 5, 40]))) for g in "ABCDE"}
    data = [(i, g, at(d, r.randrange(24)), r.choice([1.5, 2.25, 1e15, -3.0]), r.choice([None, 0, 5, 9]), None) for g, ds in days.items() for d in ds for i in range(r.choice([1, 3]))]
    out = tg.rolling_totals(tg.daily_totals(rows(spark, data), "geo_id", "date", ["spend", "clicks"]), "geo_id", ["spend", "clicks"], [7, 30]).collect()
    assert len(out) == sum(ds[-1] - ds[0] + 1 for ds in days.values())
    for x in out:
        d = x.day - 19723
        for p in (7, 30):
            own = [q for q in data if q[1] == x.geo_id and d - p < (q[2] - at(0, 0)).days <= d]
            assert x[f"total_clicks_{p}"] == sum(q[4] or 0 for q in own)
            assert x[f"total_spend_{p}"] == pytest.approx(sum(q[3] for q in own), rel=1e-12)
            assert x[f"avg_clicks_{p}"] == pytest.approx(x[f"total_clicks_{p}"] / min(p, x.day_index + 1))


def test_rolling_overflow_gives_null_totals_only_where_it_counts(spark):
    df = rows(spark, [(1, "A", at(0), math.inf, 1, None), (2, "A", at(10), 1.0, 1, None)])
    out = {r.day - 19723: r.total_spend_7 for r in tg.rolling_totals(tg.daily_totals(df, "geo_id", "date", ["spend"]), "geo_id", ["spend"], [7]).collect()}
    assert out[6] is None and out[7] == 0.0 and out[10] == 1.0


def test_empty_tables(spark):
    df = rows(spark, [])
    assert tg.usable_readings(df, ["spend"]).count() == 0
    assert tg.regular_grid(df, "geo_id", "date", "spend").count() == 0
    assert tg.rolling_totals(tg.daily_totals(df, "geo_id", "date", ["spend"]), "geo_id", ["spend"], [7]).count() == 0
