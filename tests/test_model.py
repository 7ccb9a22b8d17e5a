import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spatialpanel.operators import encoder, losses, regionalize, synth
from spatialpanel.operators.graph import Graph, min_labels
from spatialpanel.operators.metrics import contiguity_score, partition_stability
from spatialpanel.session import materialise


def pairs(spark, a, b):
    return spark.createDataFrame([(i, [float(v) for v in x], [float(v) for v in y]) for i, (x, y) in enumerate(zip(a, b))], "id bigint, a array<double>, b array<double>")


def plain_nt_xent(a, b, t):
    z = np.concatenate([a, b])
    z = z / np.linalg.norm(z, axis=1, keepdims=True)
    s, n, out = z @ z.T / t, len(a), []
    for i in range(2 * n):
        p = s[i, (i + n) % (2 * n)]
        out.append(math.log(math.exp(p) + sum(math.exp(s[i, j]) for j in range(2 * n) if j != i)) - p)
    return np.mean(out)


def test_losses(spark):
    r = np.random.default_rng(0)
    a, b = r.normal(size=(32, 6)), r.normal(size=(32, 6))
    df = pairs(spark, a, b)
    assert losses.mse(df, "a", "b").first().loss == pytest.approx(((a - b) ** 2).mean())
    assert losses.nt_xent(df, "id", "a", "b", 0.5).first().loss == pytest.approx(plain_nt_xent(a, b, 0.5))
    assert losses.nt_xent(df.limit(1), "id", "a", "b").first().loss == pytest.approx(math.log(2))
    with pytest.raises(Exception, match="size"):
        losses.mse(df.withColumn("b", F.slice("b", 1, 2)), "a", "b").collect()
    with pytest.raises(ValueError):
        losses.nt_xent(df, "id", "a", "b", 0.0)
    assert losses.mse(df.limit(0), "a", "b").first().loss is None


def test_memory_bank(spark):
    bank = losses.new_bank(spark, 8, 32, seed=1)
    m = np.array([r.vec for r in bank.orderBy("slot").collect()])
    assert np.allclose(np.linalg.norm(m, axis=1), 1)
    r = np.random.default_rng(2)
    a, b = r.normal(size=(5, 8)), r.normal(size=(5, 8))
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    want = []
    for u, w in ((unit(a), unit(b)), (unit(b), unit(a))):
        p = (u * w).sum(1) / 0.1
        want.append(np.mean(np.log(np.exp(p) + np.exp(u @ m.T / 0.1).sum(1)) - p))
    assert losses.bank_loss(pairs(spark, a, b), bank, "a", "b").first().loss == pytest.approx(np.mean(want))
    pointer, expect = 30, m.copy()
    for step in range(3):
        v = r.normal(size=(5, 8))
        batch = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "pos bigint, vec array<double>")
        for i, x in enumerate(unit(v)):
            expect[(pointer + i) % 32] = x
        bank, pointer = losses.bank_update(bank, batch, pointer, 32)
    assert pointer == 13 and np.allclose([r.vec for r in bank.orderBy("slot").collect()], expect)
    big = spark.createDataFrame([(i, [float(i + 1)] + [0.0] * 7) for i in range(70)], "pos bigint, vec array<double>")
    assert losses.bank_update(bank, big, 0, 32)[0].count() == 32


def toy(spark, geos=4, features=("f0", "f1"), steps=10, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(geos, len(features), steps))
    rows = [(f"g{i}", f, x[i, j].tolist()) for i in range(geos) for j, f in enumerate(features)]
    ids = [f"g{i}" for i in range(geos)]
    edges = [(a, b, 1.0) for a in ids for b in ids if a != b]
    g = Graph(spark.createDataFrame([(i,) for i in ids], "zip string"), spark.createDataFrame(edges, "src string, dst string, weight double"))
    return spark.createDataFrame(rows, "geo_id string, feature string, xs array<double>"), g, x


@pytest.mark.parametrize("k", [2, 3])
def test_encoding_equals_numpy(spark, k):
    s, g, x = toy(spark)
    c = encoder.EncoderConfig(2, 5, k, 3)
    p = encoder.initial_params(c)
    got = {r.zip: r.embedding for r in encoder.encode(s, g, p, ["f0", "f1"]).collect()}
    t = []
    for i in range(4):
        y = np.array([sum(np.correlate(np.pad(x[i, ch], k // 2), p["kernel"][h, ch], "valid") for ch in range(2)) + p["bias"][h] for h in range(5)])
        t.append(np.maximum(y, 0).mean(1))
    t = np.array(t)
    z = np.maximum(t @ p["own"].T + (t.sum(0) - t) @ p["nbr"].T, 0)
    assert all(np.allclose(got[f"g{i}"], z[i]) for i in range(4))
    back = encoder.load_params(encoder.params_frame(spark, p))
    assert all(np.allclose(back[n], p[n]) for n in p)


@pytest.mark.parametrize("loss", ["reconstruction", "contrastive", "predictive", "multi", "bank"])
def test_gradients(loss, monkeypatch):
    monkeypatch.setattr(encoder, "SLICE", 4)
    r = np.random.default_rng(1)
    c = encoder.EncoderConfig(2, 4, 3, 3, loss_type="multi" if loss == "bank" else loss, temperature=0.5, loss_weights={"reconstruction": 1.0, "contrastive": 0.5, "predictive": 0.25})
    if loss == "bank":
        c = encoder.EncoderConfig(2, 4, 3, 3, loss_type="contrastive", temperature=0.5, use_memory_bank=True, memory_bank_size=7, augmentation={"aug1_method": "mask", "aug2_method": "crop", "mask_mask_prob": 0.3})
    x, p = r.normal(size=(6, 2, 9)), encoder.initial_params(c)
    adj = [np.array([0, 1, 2, 3, 4, 5, 0]), np.array([1, 0, 3, 2, 5, 4, 5])]
    value = lambda: encoder.loss_and_gradients(x, adj, p, c, np.random.default_rng(5))
    _, g = value()
    for name in p:
        for at in list(np.ndindex(p[name].shape))[::3]:
            keep = p[name][at]
            p[name][at] = keep + 1e-6
            up = value()[0]
            p[name][at] = keep - 1e-6
            down = value()[0]
            p[name][at] = keep
            assert g[name][at] == pytest.approx((up - down) / 2e-6, abs=2e-5)


def test_contrast_equals_the_plain_loss_and_the_bank_is_a_ring():
    r = np.random.default_rng(3)
    a, b = r.normal(size=(300, 4)), r.normal(size=(300, 4))
    assert encoder._contrast(a, b, 0.5)[0] == pytest.approx(plain_nt_xent(a, b, 0.5))
    c = encoder.EncoderConfig(2, embedding_dim=4, use_memory_bank=True, memory_bank_size=50)
    bank = encoder.MemoryBank.new(c)
    m, unit = bank.vectors.copy(), lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    want = []
    for u, w in ((unit(a), unit(b)), (unit(b), unit(a))):
        p = (u * w).sum(1) / 0.5
        want.append(np.mean(np.log(np.exp(p) + np.exp(u @ m.T / 0.5).sum(1)) - p))
    assert encoder._bank_contrast(a, b, bank, 0.5)[0] == pytest.approx(np.mean(want))
    assert bank.pointer == 0 and np.allclose(bank.vectors, unit(b)[-50:])
    bank.write(unit(a)[:7])
    assert bank.pointer == 7 and np.allclose(bank.vectors[:7], unit(a)[:7]) and np.allclose(bank.vectors[7:], unit(b)[-43:])


@pytest.mark.parametrize("loss", ["reconstruction", "contrastive", "predictive", "multi"])
def test_validation_equals_the_training_loss(spark, loss):
    s, g, x = toy(spark, geos=6, steps=12)
    c = encoder.EncoderConfig(2, 5, 3, 3, loss_type=loss, loss_weights={"reconstruction": 1.0, "predictive": 0.5}, use_memory_bank=loss == "contrastive", memory_bank_size=16)
    p = encoder.initial_params(c)
    got = {r.loss: r.value for r in encoder.validation_losses(s, g, p, c, ["f0", "f1"]).collect()}
    adj = [np.array([i for i in range(6) for j in range(6) if i != j]), np.array([j for i in range(6) for j in range(6) if i != j])]
    if loss == "contrastive":
        assert set(got) == {loss, "total"} and got["total"] == got[loss] > 0
    else:
        assert got["total"] == pytest.approx(encoder.loss_and_gradients(x, adj, p, c, None)[0])
        assert len(got) == (3 if loss == "multi" else 2)


def test_overfit_and_spread(spark):
    s, g, _ = toy(spark)
    c = encoder.EncoderConfig(2, 8, 3, 4, lr=0.01, epochs=100)
    p, history = encoder.fit(s, g, c, ["f0", "f1"])
    assert history[-1] < 0.01 and history[-1] < history[0]
    z = np.array([r.embedding for r in encoder.encode(s, g, p, ["f0", "f1"]).collect()])
    assert np.isfinite(z).all() and z.std() > 0.001
    with pytest.raises(ValueError):
        encoder.EncoderConfig(2, loss_type="other")
    with pytest.raises(ValueError):
        encoder.fit(s, g, c, ["f0"])


@pytest.mark.parametrize("loss", ["reconstruction", "predictive"])
def test_fit_uses_all_geos_in_blocks(spark, loss):
    s, _, x = toy(spark, geos=30, seed=3)
    ring = [(f"g{i}", f"g{(i + by) % 30}", 1.0) for i in range(30) for by in (1, 2, -1, -2)]
    g = Graph(s.select("geo_id").distinct().withColumnRenamed("geo_id", "zip"), spark.createDataFrame([*ring, ("g0", "gone", 1.0)], "src string, dst string, weight double"))
    c = encoder.EncoderConfig(2, 4, 3, 3, epochs=3, loss_type=loss, max_geos=5)
    p, history = encoder.fit(s, g, c, ["f0", "f1"], block=40)
    adj = [np.array([int(e[i][1:]) for e in ring]) for i in (0, 1)]
    first = encoder.loss_and_gradients(x, adj, encoder.initial_params(c), c, None)[0]
    last = encoder.loss_and_gradients(x, adj, p, c, None)[0]
    assert history[0] == pytest.approx(first) and last < history[-1]
    whole, same = encoder.fit(s, g, c, ["f0", "f1"], block=10_000)
    assert history == pytest.approx(same) and all(np.allclose(p[k], whole[k]) for k in p)
    with pytest.raises(ValueError, match="all pairs"):
        encoder.fit(s, g, encoder.EncoderConfig(2, loss_type="contrastive", max_geos=5), ["f0", "f1"])
    many, _ = encoder.fit(s, g, encoder.EncoderConfig(2, loss_type="contrastive", epochs=1), ["f0", "f1"])
    assert np.isfinite(many["own"]).all()


def blocks(spark, n=12, b=6):
    nodes, g = synth.lattice_grid(spark, n, n, b, b)
    noisy = synth.make_embeddings(nodes, 0.05)
    v = noisy.select("zip", F.array(F.col("block_id") + F.col("e0") - F.col("row") / float(n - 1), F.col("block_id") % 2 + F.col("e1") - F.col("col") / float(n - 1)).alias("vector"))
    return v, g, nodes.select("zip", F.col("block_id").cast("bigint").alias("unit_id"))


def test_forest_distributed_equals_local_and_kruskal(spark):
    v, g, _ = blocks(spark)
    far = regionalize.spanning_forest(g, v, local_edges=0)
    near = regionalize.spanning_forest(g, v)
    rows = sorted(map(tuple, near.collect()))
    assert rows == sorted(map(tuple, far.collect())) and len(rows) == 143


@pytest.mark.parametrize("k", [1, 4, 9])
def test_skater_units(spark, k):
    v, g, truth = blocks(spark)
    units = regionalize.run_skater(v, g, regionalize.SkaterConfig(k))
    assert sorted(r.unit_id for r in units.select("unit_id").distinct().collect()) == list(range(k))
    assert contiguity_score(units, g)["connected_fraction"] == 1.0
    if k == 4:
        assert partition_stability(units, truth)["ari"] == 1.0
        other = regionalize.run_skater(v.orderBy(F.desc("zip")).repartition(3), g, regionalize.SkaterConfig(4))
        assert partition_stability(units, other)["ari"] == 1.0


def test_skater_limits(spark):
    v, g, _ = blocks(spark, 4, 2)
    for bad in (0, 17):
        with pytest.raises(ValueError):
            regionalize.run_skater(v, g, regionalize.SkaterConfig(bad))
    with pytest.raises(ValueError):
        regionalize.run_skater(v.union(v), g, regionalize.SkaterConfig(2))
    with pytest.raises(ValueError):
        regionalize.run_skater(v.limit(3), g, regionalize.SkaterConfig(2))
    with pytest.raises(ValueError):
        regionalize.run_skater(v.withColumn("vector", F.array(F.lit(float("nan")))), g, regionalize.SkaterConfig(2))
    sized = regionalize.run_skater(v, g, regionalize.SkaterConfig(4, min_size=3)).groupBy("unit_id").count()
    assert sized.agg(F.min("count")).first()[0] >= 3
    people = v.select("zip", F.lit(10.0).alias("size"))
    even = regionalize.run_skater(v, g, regionalize.SkaterConfig(4, max_deviation=0.5), people).groupBy("unit_id").count()
    assert even.agg(F.min("count")).first()[0] >= 2


def test_skater_keeps_populations_below_the_bound():
    x = np.r_[np.zeros(24), 10.0, 20.0, 30.0][:, None] + np.linspace(0, 0.1, 27)[:, None]
    edges, root = np.array([[i, i + 1] for i in range(26)]), np.zeros(27, int)
    cut = lambda size, **kw: np.bincount(regionalize._cut(27, edges, root, x, size, regionalize.SkaterConfig(**kw)), size)
    assert cut(np.ones(27), n_clusters=4).max() > 20
    assert len(cut(np.ones(27), n_clusters=3, max_deviation=0.1)) == 3 and cut(np.ones(27), n_clusters=3, max_deviation=0.1).max() <= 9.9
    skewed = np.r_[np.full(24, 3.0), 9.0, 9.0, 9.0]
    got = cut(skewed, n_clusters=5, max_deviation=0.5)
    assert len(got) == 5 and got.max() <= 1.5 * 99 / 5 and got.min() >= 0.5 * 99 / 5
    with pytest.raises(ValueError, match="population"):
        cut(np.r_[100.0, np.ones(26)], n_clusters=3, max_deviation=0.1)


def test_louvain_and_spectral_find_cliques(spark):
    names = [f"{c}{i}" for c in "ab" for i in range(6)]
    edges = [(x, y, 1.0) for x in names for y in names if x != y and x[0] == y[0]] + [("a0", "b0", 1.0), ("b0", "a0", 1.0)]
    g = Graph(spark.createDataFrame([(n,) for n in names + ["island"]], "zip string"), spark.createDataFrame(edges, "src string, dst string, weight double"))
    for units in (regionalize.louvain(g), regionalize.louvain(g, local_edges=0), regionalize.spectral_clusters(g, 2)):
        got = {r.zip: r.unit_id for r in units.collect()}
        assert len(got) == 13 and len({got[f"a{i}"] for i in range(6)}) == 1 and got["a3"] != got["b3"]
    assert regionalize.modularity(g, regionalize.louvain(g)) > 0.4


def test_spectral_embedding_in_one_task_and_across_tasks(spark):
    names = [f"{c}{i}" for c in "abc" for i in range(5)]
    edges = [(x, y, 1.0) for x in names for y in names if x != y and x[0] == y[0]]
    g = Graph(spark.createDataFrame([(n,) for n in names], "zip string"), spark.createDataFrame(edges, "src string, dst string, weight double"))
    for local in (0, 1000):
        v = {r.zip: np.array(r.vec) for r in regionalize.spectral_embedding(g, 3, local_edges=local).collect()}
        same = np.array([[v[a] @ v[b] for b in names] for a in names])
        assert np.allclose(same, [[float(a[0] == b[0]) for b in names] for a in names], atol=1e-3)
    with pytest.warns(RuntimeWarning, match="still move"):
        regionalize.spectral_embedding(g, 3, rounds=2)
    assert regionalize.spectral_embedding(Graph(g.nodes, g.edges.limit(0)), 2).count() == 0


def test_louvain_finds_the_same_units_in_one_task_and_across_tasks(spark):
    r = np.random.default_rng(6)
    names = [f"n{i:02d}" for i in range(48)]
    pairs = {(names[i], names[j]) for i in range(48) for j in range(i) if r.random() < (0.6 if i // 8 == j // 8 else 0.03)}
    edges = [(a, b, 1.0) for x, y in pairs for a, b in ((x, y), (y, x))]
    g = Graph(spark.createDataFrame([(n,) for n in names], "zip string"), spark.createDataFrame(edges, "src string, dst string, weight double"))
    near, far = regionalize.louvain(g), regionalize.louvain(g, local_edges=0)
    assert {x.zip: x.unit_id for x in near.collect()} == {x.zip: x.unit_id for x in far.collect()}
    alone = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "zip string, unit_id bigint")
    assert regionalize.modularity(g, near) > 0.45 > regionalize.modularity(g, alone)


def test_louvain_makes_its_edges_once(spark, tmp_path):
    """A graph's edges may be a costly join, which no round may repeat."""
    seen = str(tmp_path / "seen")

    def run(batches):
        for b in batches:
            with open(seen, "a") as f:
                f.write("x" * b.num_rows)
            yield b

    edges = [(a, b, 1.0) for c in "xy" for a in (c + "1", c + "2", c + "3") for b in (c + "1", c + "2", c + "3") if a != b] + [("x1", "y1", 1.0), ("y1", "x1", 1.0)]
    df = spark.createDataFrame(edges, "src string, dst string, weight double").mapInArrow(run, "src string, dst string, weight double")
    got = {r.zip: r.unit_id for r in regionalize.louvain(Graph(spark.createDataFrame([(z,) for z in ("x1", "x2", "x3", "y1", "y2", "y3")], "zip string"), df), local_edges=0).collect()}
    assert got["x1"] == got["x2"] == got["x3"] != got["y1"] == got["y2"] == got["y3"]
    assert len(open(seen).read()) == len(edges)


def test_encode_broadcasts_no_vectors(spark):
    """Only the two joins with the hubs, of which there are few, may be broadcast."""
    series = spark.createDataFrame([("a", "f", [1.0, 2.0, 3.0]), ("b", "f", [2.0, 2.0, 0.0])], "geo_id string, feature string, xs array<double>")
    series = materialise(series, "series")
    g = Graph(spark.createDataFrame([("a",), ("b",)], "zip string"), materialise(spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, weight double"), "edges"))
    z = encoder.encode(series, g, encoder.initial_params(encoder.EncoderConfig(1)), ["f"])
    assert z._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 2


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 14), st.lists(st.tuples(st.integers(0, 13), st.integers(0, 13), st.integers(1, 9)), max_size=40), st.sampled_from([0.5, 1.0, 2.0]))
def test_communities_never_lower_modularity_and_stay_in_components(n, trips, resolution):
    trips = [(a % n, b % n, w) for a, b, w in trips]
    src, dst = np.array([t[0] for t in trips] + [t[1] for t in trips], int), np.array([t[1] for t in trips] + [t[0] for t in trips], int)
    weight = np.array([t[2] for t in trips] * 2, float)
    unit = regionalize._communities(src, dst, weight, [f"n{i}" for i in range(n)], resolution)

    def score(label):
        if not len(weight):
            return 0.0
        label = np.unique(label, return_inverse=True)[1]
        held, inside = np.bincount(label[src], weight), weight[label[src] == label[dst]].sum()
        return inside / weight.sum() - resolution * (held**2).sum() / weight.sum() ** 2

    assert score(unit.astype(str)) >= score(np.arange(n)) - 1e-9
    root = min_labels(src, dst, n) if len(src) else np.arange(n)
    assert all(len(set(root[unit == u])) == 1 for u in set(unit))


def test_relabel_and_best(spark):
    df = spark.createDataFrame([("a", 7), ("b", 3), ("c", 7)], "zip string, unit_id bigint")
    assert {r.zip: r.unit_id for r in regionalize.relabel(df).collect()} == {"a": 1, "b": 0, "c": 1}
    m = spark.createDataFrame([("x", 0.5), ("y", float("nan")), ("z", 0.9), ("n", None)], "method string, silhouette double")
    assert regionalize.select_best(m, "silhouette").first().method == "z" and regionalize.select_best(m, "silhouette", largest=False).first().method == "x"


def test_registered_region_queries_follow_the_tables(spark, tmp_path):
    import __spark_entry__ as entry

    r = np.random.default_rng(4)
    names = [f"{i:05d}" for i in range(60)]
    vec = [(n, *[float(i // 20 * 9 + x) for x in r.normal(0, 0.1, 8)]) for i, n in enumerate(names)]
    vec += [("00000", *[math.nan] * 8), (None, *[1.0] * 8), ("alone", *[3.0] * 8), ("alone", *[4.0] * 8)]
    trips = [(i, names[i], names[(i + by) % 60], 50.0) for by in (1, 7) for i in range(60)] + [(999, names[0], "elsewhere", 50.0)]
    for name, rows, kind in (("zip_embeddings", vec, "zip string, " + ", ".join(f"e{i} double" for i in range(8))), ("mobility_edges", trips, "edge_id bigint, src_zip string, dst_zip string, weight double"), ("mapping", [(n, i % 3) for i, n in enumerate(names[:50])], "zip string, unit_id bigint")):
        spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    run = {n: entry.queries()[n](spark, str(tmp_path)) for n in ("spanning_forest", "skater_units", "unit_evaluation")}
    forest = run["spanning_forest"].collect()
    assert len(forest) == 59 and {z for e in forest for z in (e.a, e.b)} == set(names)
    units = {x.zip: x.unit_id for x in run["skater_units"].collect()}
    assert set(units) == {*names, "alone"} and len({units[n] for n in names}) > 2 and units["alone"] not in {units[n] for n in names}
    assert all(len({units[n] for n in names[a : a + 20]} & {units[n] for n in names[b : b + 20]}) == 0 for a, b in ((0, 20), (20, 40), (0, 40)))
    assert {x.method for x in run["unit_evaluation"].collect()} == {"skater", "mapping"}
