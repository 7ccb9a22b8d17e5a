import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from spatialpanel.operators import augment, panel


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def series(spark, xs, feature="f"):
    return spark.createDataFrame([(g, feature, [float(v) for v in x]) for g, x in xs.items()], "geo_id string, feature string, xs array<double>")


def test_dense_series_fills_observed_dates_only(spark):
    df = spark.createDataFrame([("b", day(0), 1.0, 2), ("a", day(0), None, 3), ("a", day(5), float("nan"), 4), ("c", day(5), 9.0, None)], "geo_id string, date date, spend double, clicks bigint")
    got = {(r.geo_id, r.feature): r.xs for r in panel.dense_series(df).collect()}
    assert got == {("a", "spend"): [0, 0], ("a", "clicks"): [3, 4], ("b", "spend"): [1, 0], ("b", "clicks"): [2, 0], ("c", "spend"): [0, 9], ("c", "clicks"): [0, 0]}
    with pytest.raises(ValueError):
        panel.dense_series(df.union(df))
    with pytest.raises(ValueError):
        panel.dense_series(df.limit(0))
    with pytest.raises(ValueError):
        panel.dense_series(df.select("geo_id", "date"))
    with pytest.raises(ValueError):
        panel.dense_series(df.withColumn("geo_id", F.lit(None).cast("string")))


def test_splits(spark):
    s = series(spark, {"a": range(10)})
    r = panel.horizon_split(s, 3).first()
    assert (r.input, r.target) == (list(range(7)), [7, 8, 9])
    r = panel.temporal_split(s, 4, 2).first()
    assert (r.input, r.target) == ([0, 1, 2, 3], [4, 5])
    r = panel.temporal_split(s, 8, 5, overlap=True).first()
    assert (r.input, r.target) == (list(range(8)), [5, 6, 7, 8, 9])
    for bad in (0, 10):
        with pytest.raises(Exception, match="horizon"):
            panel.horizon_split(s, bad).collect()
    with pytest.raises(Exception, match="short"):
        panel.temporal_split(s, 8, 5).collect()
    with pytest.raises(ValueError):
        panel.temporal_split(s, 0, 5)


def test_windows(spark):
    s = series(spark, {"a": range(20)})
    w = panel.sliding_windows(s, 4).orderBy("window_idx").collect()
    assert len(w) == 17 and w[0].window == [0, 1, 2, 3] and w[-1].window == [16, 17, 18, 19]
    assert [r.start_pos for r in panel.sliding_windows(s, 4, 6).orderBy("window_idx").collect()] == [0, 6, 12]
    for bad in ((21, 1), (4, 17), (0, 1), (4, 0)):
        with pytest.raises(ValueError):
            panel.sliding_windows(s, *bad)
    assert panel.sliding_windows(s, 20, 5).count() == 1
    with pytest.raises(ValueError):
        panel.sliding_windows(series(spark, {"a": range(5), "b": range(6)}), 3)


@pytest.mark.parametrize("stride,n", [(1, 24), (2, 12)])
def test_autoregressive_windows(spark, stride, n):
    s = series(spark, {f"g{i}": range(30) for i in range(10)})
    w = panel.autoregressive_windows(s, 5, 2, stride)
    assert w.count() == 10 * n and dict(w.dtypes)["input"] == "array<float>"
    last = w.orderBy(F.desc("window_idx")).first()
    assert last.input[0] == last.input_from == last.start_pos and last.target == [last.target_from, last.target_from + 1] and last.target_to == last.target_from + 2
    pos = spark.createDataFrame([(f"g{i}", i) for i in range(10)], "geo_id string, geo_pos int")
    r = panel.item(w, pos, 3 * n + 4, n).first()
    assert (r.geo_id, r.window_idx) == ("g3", 4)
    for bad in (-1, 10 * n):
        with pytest.raises(IndexError):
            panel.item(w, pos, bad, n)
    with pytest.raises(ValueError):
        panel.autoregressive_windows(series(spark, {"a": range(15)}), 10, 3, 20)


def test_unstacked_targets(spark):
    s = series(spark, {"a": range(8)}, "x").union(series(spark, {"a": range(10, 18)}, "y"))
    u = panel.unstack_targets(panel.autoregressive_windows(s, 3, 2)).orderBy("window_idx", "step").collect()
    assert [list(r.targets) for r in u[:3]] == [[3, 13], [4, 14], [4, 14]]


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5])
def test_convolution_equals_numpy(spark, k):
    r = np.random.default_rng(k)
    x, kernel = r.normal(size=11), r.normal(size=k)
    got = series(spark, {"a": x}).select(panel.convolve(F.col("xs"), list(kernel)).alias("y")).first().y
    assert np.allclose(got, np.correlate(np.pad(x, k // 2), kernel, "valid"))


def test_augmentations(spark):
    s = series(spark, {f"g{i}": np.arange(30) + 1 for i in range(8)})
    run = lambda m, **p: {r.geo_id: np.array(r.xs) for r in augment.augment(s, m, "geo_id", seed=3, **p).collect()}
    base = np.arange(30) + 1.0
    j = run("jitter", noise_std=0.1)
    assert 0.02 < np.std([v - base for v in j.values()]) < 0.2 and not np.allclose(j["g0"] - base, j["g1"] - base)
    assert np.allclose(run("jitter", noise_std=0.0)["g0"], base)
    m = run("mask", mask_prob=0.5, mask_value=-1.0)
    assert 0.3 < np.mean([v == -1 for v in m.values()]) < 0.7
    b = run("mask", mask_prob=0.2, mask_value=-1.0, mask_mode="contiguous")
    assert all((v == -1).sum() == 6 and np.ptp(np.flatnonzero(v == -1)) == 5 for v in b.values())
    assert len({np.flatnonzero(v == -1)[0] for v in b.values()}) > 1
    c = run("crop", crop_ratio=0.5)
    assert all(len(v) == 30 and np.allclose(np.diff(v), 14 / 29) for v in c.values()) and len({v[0] for v in c.values()}) == 1
    assert np.allclose(run("crop", crop_ratio=1.0)["g0"], base) and np.allclose(run("crop", crop_ratio=0.01)["g0"], base)
    again = {r.geo_id: r.xs for r in augment.augment(s.repartition(5), "jitter", "geo_id", seed=3, noise_std=0.1).collect()}
    assert all(np.allclose(again[k], v) for k, v in j.items())
    for bad in (("nothing", {}), ("jitter", {"noise_std": -1}), ("mask", {"mask_prob": 2}), ("mask", {"mask_mode": "x"}), ("crop", {"crop_ratio": 0})):
        with pytest.raises(ValueError):
            augment.augment(s, bad[0], "geo_id", **bad[1])


def test_pair_and_log(spark):
    log = augment.get_augmentation_logger()
    log.clear_logs()
    s = series(spark, {"a": range(20), "b": range(20)})
    r = augment.augmented_pair(s, "geo_id", aug1_method="mask", aug2_method="jitter", seed=1, mask_mask_prob=0.9, jitter_noise_std=0.5, ignored=1).first()
    assert r.view1 != r.xs and r.view2 != r.xs and r.view1.count(0.0) > 10
    assert [e["method"] for e in log.get_logs()] == ["mask", "jitter"] and log.to_frame(spark).first().params == {"mask_prob": "0.9"}
    assert [e["input_shape"] for e in log.get_logs()] == [[2, 20]] * 2 and [e["method"] for e in log.get_logs(last=1)] == ["jitter"]
    log.get_logs()[0]["method"] = "other"
    assert log.get_logs()[0]["method"] == "mask" and log.get_logs(last=0) == []
    log.clear_logs()
    assert log.get_logs() == []
