import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spatialpanel.operators import skew

EDGES = "edge_id bigint, src_zip string, dst_zip string, weight double, n bigint, key string"


def edges(spark, data):
    return spark.createDataFrame([(i, a, b, w, 1, "k") for i, (a, b, w) in enumerate(data)], EDGES)


@pytest.fixture(scope="module")
def data():
    r = random.Random(2)
    out = []
    for _ in range(3000):
        a = "hot" if r.random() < 0.4 else f"z{r.randrange(60)}"
        out.append((r.choice([a, a, a, None]) if r.random() < 0.1 else a, r.choice([f"d{r.randrange(40)}", None, "hot"]), r.choice([None, math.nan, 1.0, 2.5, round(r.uniform(-5, 90), 2), round(r.uniform(0, 9), 2)])))
    return out


def test_heavy_keys(spark, data):
    got = {(r.side, r.key): r.n_rows for r in skew.heavy_keys(edges(spark, data), "src_zip", "dst_zip", 0.05).collect()}
    want = {(s, k): n for s, i in (("src_zip", 0), ("dst_zip", 1)) for k, n in Counter(x[i] for x in data).items() if k is not None and n >= 0.05 * len(data)}
    assert got == want and ("src_zip", "hot") in want
    assert skew.heavy_keys(edges(spark, []), "src_zip", "dst_zip").count() == 0


def test_profiles(spark, data):
    w = skew.two_sided(edges(spark, data), "src_zip", "dst_zip", F.expr("CASE WHEN NOT isnan(weight) THEN weight END"))
    got = {(r.side, r.key): r for r in skew.profiles(w).collect()}
    own = [x for x in data if x[0] == "hot"]
    partners = Counter(x[1] for x in own if x[1] is not None)
    r = got[("src_zip", "hot")]
    assert (r.n_rows, r.n_values) == (len(own), len(partners))
    assert (r["mode"], r.mode_rows) == min(partners.items(), key=lambda p: (-p[1], p[0]))
    assert r.total == pytest.approx(sum(x[2] for x in own if x[2] is not None and not math.isnan(x[2])))


@pytest.mark.parametrize("share", [0.001, 0.0])
def test_percentiles_are_exact_in_the_hot_path_too(spark, monkeypatch, share):
    r = random.Random(4)
    big = [("hot", "d", round(r.gauss(0, 50), 2)) for _ in range(9000)] + [("hot", "d", 1e15), ("hot", "d", -0.0), ("hot", "d", 0.0), ("hot", "d", None), ("hot", "d", math.nan), (None, "d", 1.0)] + [(f"z{i % 50}", "d", float(i % 7)) for i in range(400)]
    monkeypatch.setattr(skew, "HOT_SHARE", share)
    shares = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    got = {x.src_zip: x for x in skew.percentiles(edges(spark, big), "src_zip", "weight", shares).collect()}
    for key in ("hot", "z3", "z49"):
        v = sorted(x[2] for x in big if x[0] == key and x[2] is not None and not math.isnan(x[2]))
        assert got[key].n_rows == len(v)
        for name, q in shares.items():
            assert got[key][name] == v[max(1, math.ceil(len(v) * q)) - 1]
    assert None not in got


def test_join_group_facts_hot_cold_and_null_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else (None if i % 7 == 0 else f"k{i}")) for i in range(3000)], "id bigint, k string")
    facts = rows.filter("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
    got = skew.join_group_facts(rows, facts, "k", "n", 3000).collect()
    assert len(got) == rows.filter("k IS NOT NULL").count() and all(x.low == (0 if x.k == "hot" else x.id) for x in got)


def test_latest_version_order_and_repeats(spark):
    df = spark.createDataFrame([("a", 1, 5, "x"), ("a", 1, 6, "y"), ("a", None, 9, "z"), ("b", None, 1, "w"), ("b", None, 1, "w")], "k string, t int, id int, v string")
    got = sorted(tuple(r) for r in skew.latest_version(df, ["k"], ["t", "id"], ["v", "v", "id"]).collect())
    assert got == [("a", 1, 6, "y"), ("b", None, 1, "w")]


def test_positions_number_distinct_keys_in_order(spark):
    keys = [f"k{(i * 37) % 1000:04d}" for i in range(1000)] * 2 + [None]
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(7)
    assert {r.k: r.pos for r in skew.positions(df, "k").collect()} == {f"k{i:04d}": i for i in range(1000)}
    assert skew.positions(df.limit(0), "k").count() == 0
