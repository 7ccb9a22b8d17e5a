"""The embedding model: convolution over time, mean, one graph layer.

Applying a model is a DataFrame plan at any size: the convolution runs in Arrow
batches where the series are, the neighbour sum is a join and an aggregate, the
layer is array arithmetic. Training is full-batch gradient descent with Adam over
all geos, in blocks across the cluster; its parameters are plain tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import literal, relu, times_vector
from ..session import materialise
from . import losses
from .augment import DEFAULT_VIEWS, array_pair, augmented_pair
from .blocks import matrix
from .graph import Graph, neighbour_sum
from .skew import shuffled

LOSSES = ("reconstruction", "contrastive", "predictive", "multi")
DEFAULT_WEIGHTS = {"reconstruction": 1.0, "contrastive": 1.0}
#: Rows of a training block, and rows convolved at once.
BLOCK, SLICE = 1024, 256


@dataclass(frozen=True)
class EncoderConfig:
    in_channels: int
    hidden_channels: int = 16
    kernel_size: int = 3
    embedding_dim: int = 8
    lr: float = 0.01
    epochs: int = 50
    loss_type: str = "reconstruction"
    loss_weights: dict = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))
    temperature: float = 0.1
    use_memory_bank: bool = False  # of a contrastive loss: negatives from a ring buffer of earlier embeddings
    memory_bank_size: int = 4096
    augmentation: dict = field(default_factory=lambda: dict(DEFAULT_VIEWS))  # the two views of a contrastive loss
    seed: int = 0
    max_geos: int = 20_000  # of a contrastive loss, which compares all pairs; more are an error

    def __post_init__(self) -> None:
        if self.loss_type not in LOSSES:
            raise ValueError(f"loss_type must be one of {LOSSES}")
        if min(self.in_channels, self.hidden_channels, self.kernel_size, self.embedding_dim) <= 0:
            raise ValueError("sizes must be positive")


def initial_params(c: EncoderConfig) -> dict[str, np.ndarray]:
    """Seeded uniform start, scaled by fan-in."""
    r = np.random.default_rng(c.seed)
    draw = lambda *shape, fan: r.uniform(-1, 1, shape) / np.sqrt(fan)
    h, e, k = c.hidden_channels, c.embedding_dim, c.kernel_size
    return {"kernel": draw(h, c.in_channels, k, fan=c.in_channels * k), "bias": draw(h, fan=c.in_channels * k), "own": draw(e, h, fan=h), "nbr": draw(e, h, fan=h), "dec": draw(h, e, fan=e), "dec_bias": draw(h, fan=e)}


def params_frame(spark: SparkSession, params: dict[str, np.ndarray]) -> DataFrame:
    """(name, shape, values): a model as a table, to be written with any sink."""
    return spark.createDataFrame([(n, list(v.shape), v.ravel().tolist()) for n, v in params.items()], "name string, shape array<int>, values array<double>")


def load_params(df: DataFrame) -> dict[str, np.ndarray]:
    """The inverse of ``params_frame``; a model is small by nature."""
    return {r.name: np.array(r["values"]).reshape(r.shape) for r in df.collect()}


def _unfold(x: np.ndarray, k: int) -> np.ndarray:
    """(n, C, T') windows of (n, C, T) padded by k // 2: shape (n, T', C, k)."""
    padded = np.pad(x, ((0, 0), (0, 0), (k // 2, k // 2)))
    return np.lib.stride_tricks.sliding_window_view(padded, k, axis=2).transpose(0, 2, 1, 3)


def temporal_features(series: DataFrame, params: dict[str, np.ndarray], features: list[str], geo: str = "geo_id") -> DataFrame:
    """(zip, vec): convolution, ReLU and mean over time of each geo's series (geo, feature, xs)."""
    kernel, bias = params["kernel"], params["bias"]
    picks = [F.first(F.when(F.col("feature") == f, F.col("xs")), ignorenulls=True).alias(f"f{i}") for i, f in enumerate(features)]
    wide = series.groupBy(F.col(geo).cast("string").alias("zip")).agg(*picks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([matrix(batch.column(i + 1)) for i in range(len(features))], axis=1)
            y = np.einsum("ntck,hck->nth", _unfold(x, kernel.shape[2]), kernel) + bias
            out = np.maximum(y, 0).mean(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(out), pa.list_(pa.float64()))], names=["zip", "vec"])

    return wide.mapInArrow(run, "zip string, vec array<double>")


def graph_layer(vectors: DataFrame, g: Graph, params: dict[str, np.ndarray]) -> DataFrame:
    """(zip, embedding): relu(own . x + nbr . sum of the neighbours' x), without bias; islands have no neighbour term."""
    hidden = params["own"].shape[1]
    met = vectors.join(shuffled(neighbour_sum(g, vectors, hidden)), "zip")
    one, two = times_vector(literal(params["own"]), F.col("vec")), times_vector(literal(params["nbr"]), F.col("nbr"))
    return met.select("zip", relu(F.zip_with(one, two, lambda a, b: a + b)).alias("embedding"))


def encode(series: DataFrame, g: Graph, params: dict[str, np.ndarray], features: list[str], geo: str = "geo_id") -> DataFrame:
    """(zip, embedding) of every geo: temporal features, then the graph layer. Joined by key, never by position."""
    return graph_layer(temporal_features(series, params, features, geo), g, params)


def _hidden(x: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray]:
    """The windows (n * T', C * k) and the convolution before ReLU (n, T', H)."""
    h, c, k = p["kernel"].shape
    u = _unfold(x, k)
    flat = u.reshape(-1, c * k)
    return flat, (flat @ p["kernel"].reshape(h, -1).T + p["bias"]).reshape(len(x), u.shape[1], h)


def _forward(x: np.ndarray, adj: list[np.ndarray], p: dict) -> dict:
    t = np.concatenate([np.maximum(_hidden(x[i : i + SLICE], p)[1], 0).mean(1) for i in range(0, len(x), SLICE)])
    n = np.zeros_like(t)
    np.add.at(n, adj[0], t[adj[1]])
    pre = t @ p["own"].T + n @ p["nbr"].T
    return {"x": x, "t": t, "n": n, "pre": pre, "z": np.maximum(pre, 0)}


def _backward(f: dict, dz: np.ndarray, dt: np.ndarray, adj: list[np.ndarray], p: dict, g: dict) -> None:
    d = dz * (f["pre"] > 0)
    g["own"] += d.T @ f["t"]
    g["nbr"] += d.T @ f["n"]
    dt = dt + d @ p["own"]
    dn = d @ p["nbr"]
    np.add.at(dt, adj[1], dn[adj[0]])
    for i in range(0, len(dt), SLICE):
        u, y = _hidden(f["x"][i : i + SLICE], p)
        dy = (dt[i : i + SLICE] / y.shape[1])[:, None, :] * (y > 0)
        g["kernel"] += (dy.reshape(len(u), -1).T @ u).reshape(g["kernel"].shape)
        g["bias"] += dy.sum((0, 1))


def _contrast(a: np.ndarray, b: np.ndarray, temperature: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss and gradients of the contrastive loss of ``losses.nt_xent``, in blocks of rows."""
    z = np.concatenate([a, b])
    size = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    v = z / size
    m, half = len(z), len(a)
    loss, dv = 0.0, np.zeros_like(v)
    for at in range(0, m, SLICE):
        i = np.arange(at, min(at + SLICE, m))
        k, j = np.arange(len(i)), (i + half) % m
        s = v[i] @ v.T / temperature
        pos = s[k, j]
        s[k, i] = -np.inf
        top = s.max(1, keepdims=True)
        w = np.exp(s - top)
        w[k, j] *= 2
        total = w.sum(1, keepdims=True)
        loss += float((np.log(total[:, 0]) + top[:, 0] - pos).sum())
        w /= total
        w[k, j] -= 1
        dv[i] += w @ v
        dv += w.T @ v[i]
    dv /= temperature * m
    dz = (dv - v * (dv * v).sum(1, keepdims=True)) / size
    return loss / m, dz[:half], dz[half:]


@dataclass
class MemoryBank:
    """A ring buffer of unit vectors, written from ``pointer`` on."""

    vectors: np.ndarray
    pointer: int = 0

    @staticmethod
    def new(c: EncoderConfig) -> MemoryBank:
        v = np.random.default_rng(c.seed + 2).normal(size=(c.memory_bank_size, c.embedding_dim))
        return MemoryBank(v / np.linalg.norm(v, axis=1, keepdims=True))

    def write(self, unit: np.ndarray) -> None:
        """Of more rows than slots the last ones stay."""
        size = len(self.vectors)
        at = (self.pointer + np.arange(len(unit))) % size
        self.vectors[at[-size:]] = unit[-size:]
        self.pointer = (self.pointer + len(unit)) % size


def _bank_contrast(a: np.ndarray, b: np.ndarray, bank: MemoryBank, temperature: float, write: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss and gradients of ``losses.bank_loss``; then both views go into the bank. The bank itself is no variable."""
    sizes = [np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12) for z in (a, b)]
    views = [a / sizes[0], b / sizes[1]]
    grads, loss, n = [np.zeros_like(a), np.zeros_like(b)], 0.0, len(a)
    for at in range(0, n, SLICE):
        part = slice(at, at + SLICE)
        p = (views[0][part] * views[1][part]).sum(1) / temperature
        for mine in (0, 1):
            s = np.concatenate([p[:, None], views[mine][part] @ bank.vectors.T / temperature], axis=1)
            top = s.max(1, keepdims=True)
            w = np.exp(s - top)
            total = w.sum(1, keepdims=True)
            loss += float((np.log(total[:, 0]) + top[:, 0] - p).sum())
            w /= total
            w[:, 0] -= 1
            grads[mine][part] += w[:, 1:] @ bank.vectors + w[:, :1] * views[1 - mine][part]
            grads[1 - mine][part] += w[:, :1] * views[mine][part]
    out = []
    for d, v, size in zip(grads, views, sizes):
        d = d / (2 * n * temperature)
        out.append((d - v * (d * v).sum(1, keepdims=True)) / size)
    if write:
        for v in views:
            bank.write(v)
    return loss / (2 * n), *out


def loss_and_gradients(x: np.ndarray, adj: list[np.ndarray], p: dict, c: EncoderConfig, rng: np.random.Generator, own: int | None = None, geos: int | None = None, bank: MemoryBank | None = None) -> tuple[float, dict]:
    """The configured loss on all geos at once, and its gradients; a ``bank`` is written to.

    With ``own`` and ``geos`` the share that the first ``own`` rows have in the
    loss over ``geos`` geos; the other rows are neighbours only. The shares of
    all geos add up to loss and gradients of the whole, but not for the
    contrastive loss, which compares all with all.
    """
    if c.use_memory_bank and bank is None:
        bank = MemoryBank.new(c)
    own, geos = len(x) if own is None else own, len(x) if geos is None else geos
    g = {k: np.zeros_like(v) for k, v in p.items()}
    weights = _weights(c)
    loss = 0.0
    if w := weights.get("reconstruction"):
        f = _forward(x, adj, p)
        diff = f["z"] @ p["dec"].T + p["dec_bias"] - f["t"]
        diff[own:] = 0.0
        loss += w * float((diff**2).sum()) / (geos * diff.shape[1])
        dr = 2 * w * diff / (geos * diff.shape[1])
        g["dec"] += dr.T @ f["z"]
        g["dec_bias"] += dr.sum(0)
        _backward(f, dr @ p["dec"], -dr, adj, p, g)
    if w := weights.get("contrastive"):
        views = [_forward(v, adj, p) for v in array_pair(x, rng, **c.augmentation)]
        za, zb = views[0]["z"], views[1]["z"]
        part, da, db = _bank_contrast(za, zb, bank, c.temperature) if c.use_memory_bank else _contrast(za, zb, c.temperature)
        loss += w * part
        for f, d in zip(views, (da, db)):
            _backward(f, w * d, np.zeros_like(f["t"]), adj, p, g)
    if w := weights.get("predictive"):
        half = x.shape[2] // 2
        past, future = _forward(x[:, :, :half], adj, p), _forward(x[:, :, half:], adj, p)
        diff = past["z"] - future["z"]
        diff[own:] = 0.0
        loss += w * float((diff**2).sum()) / (geos * diff.shape[1])
        d = 2 * w * diff / (geos * diff.shape[1])
        _backward(past, d, np.zeros_like(past["t"]), adj, p, g)
        _backward(future, -d, np.zeros_like(future["t"]), adj, p, g)
    return loss, g


def _weights(c: EncoderConfig) -> dict[str, float]:
    return c.loss_weights if c.loss_type == "multi" else {c.loss_type: 1.0}


def _blocks(wide: DataFrame, ends: DataFrame, geos: int, edges: int, rows: int) -> DataFrame:
    """(geos, own, x, src, dst): blocks of geos with the neighbours that their loss needs, one row each.

    Each geo is its block's own once; a neighbour in another block is repeated
    there, so there are at most geos + edges rows of series. ``src`` and ``dst``
    count rows of ``x``, own geos first. A block takes about ``rows`` series, more only
    where one geo has more neighbours than that.
    """
    n = max(1, -(-(geos + edges) // rows))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    near = ends.groupBy(F.col("src").alias("zip")).agg(F.collect_list("dst").alias("near"))
    core = wide.join(shuffled(near), "zip", "left").select(block("zip").alias("block"), F.lit(0).alias("far"), "zip", "near", "xs")
    beyond = ends.select(block("src").alias("block"), F.col("dst").alias("zip")).distinct().filter(F.col("block") != block("zip"))
    halo = shuffled(beyond).join(wide, "zip").select("block", F.lit(1).alias("far"), "zip", F.lit(None).cast("array<string>").alias("near"), "xs")

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("far", "ascending"), ("zip", "ascending")]).combine_chunks()
        near, zips = t["near"].combine_chunks(), t["zip"].combine_chunks()
        src = np.repeat(np.arange(t.num_rows), pc.fill_null(pc.list_value_length(near), 0).to_numpy(zero_copy_only=False))
        dst = pc.index_in(near.flatten(), zips)
        x = matrix(t["xs"].combine_chunks())
        own = int((t["far"].to_numpy() == 0).sum())
        cols = [pa.array([len(x)]), pa.array([own]), pa.array([x.tobytes()], pa.binary()), pa.array([src.astype(np.int32)], pa.list_(pa.int32())), pa.array([dst.to_numpy(zero_copy_only=False).astype(np.int32)], pa.list_(pa.int32()))]
        return pa.Table.from_arrays(cols, names=["geos", "own", "x", "src", "dst"])

    packed = core.unionByName(halo).groupBy("block").applyInArrow(pack, "geos bigint, own bigint, x binary, src array<int>, dst array<int>")
    files = max(min(n, wide.sparkSession.sparkContext.defaultParallelism), n // 16)
    return materialise(packed.repartition(files), "blocks")


def _shares(blocks: DataFrame, p: dict, c: EncoderConfig, geos: int) -> tuple[float, dict]:
    """Loss and gradients over all blocks: one row of sums per task reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, total = 0.0, {k: np.zeros_like(v) for k, v in p.items()}
        for batch in batches:
            for r in range(batch.num_rows):
                n, own, x, src, dst = (batch.column(i)[r] for i in range(5))
                values = np.frombuffer(x.as_buffer(), np.float64).reshape(n.as_py(), c.in_channels, -1)
                part, g = loss_and_gradients(values, [src.values.to_numpy(), dst.values.to_numpy()], p, c, np.random.default_rng(0), own.as_py(), geos)
                loss += part
                for k in total:
                    total[k] += g[k]
        flat = np.concatenate([total[k].ravel() for k in p])
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([flat], pa.list_(pa.float64()))], names=["loss", "flat"])

    rows = blocks.mapInArrow(run, "loss double, flat array<double>").collect()
    flat, g, at = np.sum([r.flat for r in rows], axis=0), {}, 0
    for k, v in p.items():
        g[k] = flat[at : at + v.size].reshape(v.shape)
        at += v.size
    return sum(r.loss for r in rows), g


def fit(series: DataFrame, g: Graph, c: EncoderConfig, features: list[str], geo: str = "geo_id", block: int = BLOCK) -> tuple[dict[str, np.ndarray], list[float]]:
    """(parameters, loss of each epoch), trained by Adam on all geos at once.

    All geos with series and all edges among them are used, whatever their
    number: each epoch every block of geos gives its share of loss and gradients, and
    only their sums reach the driver. Only a contrastive loss, which compares
    every geo with every other, takes a single block; more than ``max_geos`` geos
    are a ValueError there. Series must be of one length. Errors are raised.
    """
    if len(features) != c.in_channels:
        raise ValueError("in_channels must be the number of features")
    picks = [F.first(F.when(F.col("feature") == f, F.col("xs")), ignorenulls=True).alias(f"f{i}") for i, f in enumerate(features)]
    picked = series.filter(F.col(geo).isNotNull()).groupBy(F.col(geo).cast("string").alias("zip")).agg(*picks)
    wide = materialise(picked, "series")
    sizes = F.array_compact(F.array(*[F.when(F.col(f"f{i}").isNotNull(), F.size(f"f{i}")) for i in range(len(features))]))
    r = wide.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(sizes)).alias("most"), F.min(F.array_min(sizes)).alias("least")).first()
    if not r.n or r.most is None or r.most != r.least:
        raise ValueError("there must be series, all of one length")
    if whole := bool(_weights(c).get("contrastive")):
        if r.n > c.max_geos:
            raise ValueError(f"a contrastive loss compares all pairs of at most {c.max_geos} geos")
    zeros = F.array_repeat(F.lit(0.0), r.most)
    wide = wide.select("zip", F.concat(*[F.coalesce(F.col(f"f{i}").cast("array<double>"), zeros) for i in range(len(features))]).alias("xs"))
    keys = wide.select("zip")
    ends = g.edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    ends = materialise(ends.join(shuffled(keys.withColumnRenamed("zip", "src")), "src", "left_semi").join(shuffled(keys.withColumnRenamed("zip", "dst")), "dst", "left_semi"), "ends")
    n_edges = ends.count()
    blocks = _blocks(wide, ends, r.n, n_edges, r.n + n_edges if whole else block)
    if whole:
        one = blocks.first()
        x = np.frombuffer(one.x, np.float64).reshape(r.n, c.in_channels, -1)
        adj = [np.array(one.src, int), np.array(one.dst, int)]
    p = initial_params(c)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    rng, history = np.random.default_rng(c.seed + 1), []
    bank = MemoryBank.new(c) if c.use_memory_bank else None
    for step in range(1, c.epochs + 1):
        loss, grad = loss_and_gradients(x, adj, p, c, rng, bank=bank) if whole else _shares(blocks, p, c, r.n)
        history.append(loss)
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
            p[k] = p[k] - c.lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p, history


def validation_losses(series: DataFrame, g: Graph, params: dict[str, np.ndarray], c: EncoderConfig, features: list[str], geo: str = "geo_id", bank: DataFrame | None = None) -> DataFrame:
    """(loss, value): each configured loss of a model on ``series`` and their weighted sum ``total``; nothing is learnt.

    A DataFrame plan at any size, with the losses of ``losses``; a contrastive
    loss takes one batch there. ``bank`` (slot, vec) is the memory bank to
    compare with, by default a new one if the configuration asks for one.
    """
    keyed = materialise(series.select(F.col(geo).cast("string").alias("zip"), "feature", "xs"), "series")
    g = Graph(g.nodes, materialise(g.edges, "edges"))
    model = lambda df, column: encode(df.select("zip", "feature", F.col(column).alias("xs")), g, params, features, "zip")
    parts: dict[str, DataFrame] = {}
    weights = _weights(c)
    if weights.get("reconstruction"):
        seen = materialise(temporal_features(keyed, params, features, "zip"), "features")
        decoded = F.zip_with(times_vector(literal(params["dec"]), F.col("embedding")), literal(params["dec_bias"]), lambda a, b: a + b)
        parts["reconstruction"] = losses.reconstruction_loss(graph_layer(seen, g, params).withColumn("out", decoded).join(seen, "zip"), "out", "vec")
    if weights.get("contrastive"):
        views = augmented_pair(keyed.withColumn("_key", F.concat_ws("/", "zip", "feature")), "_key", seed=c.seed, **c.augmentation)
        pairs = model(views, "view1").select("zip", F.col("embedding").alias("a")).join(model(views, "view2").select("zip", F.col("embedding").alias("b")), "zip")
        if c.use_memory_bank or bank is not None:
            bank = losses.new_bank(series.sparkSession, c.embedding_dim, c.memory_bank_size, c.seed) if bank is None else bank
            parts["contrastive"] = losses.bank_loss(pairs, bank, "a", "b", c.temperature)
        else:
            parts["contrastive"] = losses.nt_xent(pairs, "zip", "a", "b", c.temperature)
    if weights.get("predictive"):
        half = F.expr("size(xs) div 2")
        cut = keyed.withColumn("past", F.slice("xs", F.lit(1), half)).withColumn("future", F.slice("xs", half + 1, F.size("xs") - half))
        both = model(cut, "past").join(model(cut, "future").select("zip", F.col("embedding").alias("later")), "zip")
        parts["predictive"] = losses.predictive_loss(both, "embedding", "later")
    rows = {name: df.first()["loss"] for name, df in parts.items()}
    rows["total"] = float(sum(weights[k] * v for k, v in rows.items()))
    return series.sparkSession.createDataFrame(list(rows.items()), "loss string, value double")
