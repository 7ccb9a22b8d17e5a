import datetime as dt
import random

import numpy as np
import pytest

from spatialpanel.operators.spikes import SpikeModel, flag_readings, judge

SCHEMA = "geo_id string, date timestamp_ntz, reading_id bigint, spend double, flag string, block int"


def series(geo, n, noise, seed, level=100.0, start=0, per_day=1):
    r = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    return [[geo, t0 + dt.timedelta(days=i / per_day), start + i, level * (1 + 0.25 * ((i // per_day) % 7 >= 5)) * (1 + r.uniform(-noise, noise)), "c", 3] for i in range(n)]


def flags(spark, rows, **kw):
    df = spark.createDataFrame([(*r[:3], float(r[3]), *r[4:]) for r in rows], SCHEMA)
    return {r.reading_id: r for r in flag_readings(df, "spend", **kw).collect()}


def planted():
    rows = series("A", 150, 0.02, 1) + series("B", 150, 0.25, 2, 5000, 1000)
    rows[40][3], rows[41][3], rows[90][3], rows[60][3], rows[70][3] = 900, 950, 30, -5.0, 9999999.99
    for i in range(100, 107):
        rows[i][3] = 101.25
    for i in range(20, 25):
        rows[i][3] = 99.5  # five equal values are not stuck
    for i in range(120, 150):
        rows[i][3] *= 1.6  # a lasting change of level
    rows[150 + 30][3] = 80_000
    rows[150 + 31][3] = 9000  # within what the noisy source reports now and then
    return rows


WANT = {40: "spike", 41: "spike", 90: "spike", 60: "out_of_range", 70: "out_of_range", **{i: "stuck" for i in range(100, 107)}, 1030: "spike"}


def test_planted_cases(spark):
    got = flags(spark, planted())
    assert len(got) == 300
    assert {k: r.flag for k, r in got.items() if r.flag} == WANT
    assert all(r.p_normal + r.p_spike + r.p_stuck + r.p_out == pytest.approx(1) for r in got.values())
    assert got[103].p_stuck > 0.9 and got[40].p_spike > 0.99 and got[60].p_out > 0.99


@pytest.mark.parametrize("broadcast_rows", [0, 100_000])
def test_blocks_give_the_same_flags(spark, broadcast_rows):
    rows = series("hot", 3000, 0.05, 3, per_day=40)
    for i in (17, 511, 512, 1025, 2999):
        rows[i][3] = 1500
    for i in range(1020, 1024 + 4):
        rows[i][3] = 77.5
    whole = flags(spark, rows)
    cut = flags(spark, rows, model=SpikeModel(block=512, context=64), broadcast_rows=broadcast_rows)
    assert len(cut) == 3000
    assert {k: r.flag for k, r in cut.items()} == {k: r.flag for k, r in whole.items()}
    assert [k for k, r in sorted(cut.items()) if r.flag == "stuck"] == list(range(1020, 1028))


@pytest.mark.parametrize("broadcast_rows", [0, 100_000])
def test_scale_of_a_source_in_blocks_is_its_own(spark, broadcast_rows):
    quiet, noisy = series("hot", 1024, 0.02, 5, per_day=40), series("hot", 1024, 0.6, 6, start=1024, per_day=40)
    rows = quiet + [[g, t + dt.timedelta(days=26), *rest] for g, t, *rest in noisy] + series("small", 90, 0.1, 7, start=9000)
    rows += [["out", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 20_000 + i, -1.0 - i, None, 0] for i in range(700)]
    for i in (100, 300, 700):
        rows[i][3] *= 1.6  # ordinary by the scale of all its readings, not by its block's own
    whole = flags(spark, rows)
    cut = flags(spark, rows, model=SpikeModel(block=512, context=64), broadcast_rows=broadcast_rows)
    assert {k: r.flag for k, r in cut.items()} == {k: r.flag for k, r in whole.items()} and len(cut) == len(rows)
    assert all(whole[i].flag is None for i in (100, 300, 700)) and whole[20_000].flag == "out_of_range"


def test_small_and_odd_sources(spark):
    rows = [["one", dt.datetime(2024, 1, 1), 1, 5.0, None, 0], ["zero", dt.datetime(2024, 1, 1), 2, 0.0, None, 0], ["zero", dt.datetime(2024, 1, 2), 3, 0.0, None, 0], ["bad", dt.datetime(2024, 1, 1), 4, -1.0, None, 0], ["inf", dt.datetime(2024, 1, 1), 5, float("inf"), None, 0]]
    got = flags(spark, rows)
    assert {k: r.flag for k, r in got.items()} == {1: None, 2: None, 3: None, 4: "out_of_range", 5: "out_of_range"}
    assert flags(spark, []) == {}


def test_the_model_alone_finds_runs_and_impossible_values():
    rng = np.random.default_rng(4)
    value, want = [], []
    for n in [5, 6, 1, 2, 5, 5, 9, 3, 6, 6, 4, 1, 8, 5, 30, 2, 5] * 3:  # runs next to each other
        value += [100 * np.exp(rng.normal(0, 0.05))] * n
        want += [n >= 6] * n
    for lead in (0, 7):  # also at the ends of a source
        v = np.r_[100 * np.exp(rng.normal(0, 0.05, lead)), value]
        p, _, _ = judge(v, np.zeros(len(v), int), SpikeModel())
        assert (p[:, 2] > 0.5).tolist() == [False] * lead + want
        p, _, _ = judge(v[::-1].copy(), np.zeros(len(v), int), SpikeModel())
        assert (p[::-1, 2] > 0.5).tolist() == [False] * lead + want
    p, _, _ = judge(np.array([1.0, -3.0, 1.1, 9e6, 1.05]), np.zeros(5, int), SpikeModel())
    assert (p[:, 3] > 0.5).tolist() == [False, True, False, True, False]


def test_many_sources_in_one_call():
    rng = np.random.default_rng(0)
    value, group = 100 * np.exp(rng.normal(0, 0.05, 5000)), np.repeat(np.arange(50), 100)
    value[1234] *= 9
    p, runs, _ = judge(value, group, SpikeModel())
    assert np.flatnonzero(p[:, 1] > 0.5).tolist() == [1234] and (runs == 1).all()
