"""Synthetic lattice of zips and embeddings over it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import normal
from ..schema import require_columns
from .graph import Graph


def lattice_nodes(spark: SparkSession, width: int, height: int, block_w: int, block_h: int) -> DataFrame:
    """(zip, row, col, block_id) row by row; zip is Z + row and col of three digits or more.

    ValueError for sizes that are not positive, or over 1000 a side (ids would collide).
    """
    if min(width, height, block_w, block_h) <= 0:
        raise ValueError("sizes must be positive")
    if max(width, height) > 1000:
        raise ValueError("at most 1000 cells a side: zip ids have three digits for each")
    across = math.ceil(width / block_w)
    cells = spark.range(width * height).select(F.expr(f"cast(id div {width} AS int)").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    block = F.expr(f"(row div {block_h}) * {across} + col div {block_w}").cast("int")
    return cells.select(F.format_string("Z%03d%03d", "row", "col").alias("zip"), "row", "col", block.alias("block_id"))


def lattice_edges(nodes: DataFrame, width: int, height: int) -> DataFrame:
    """(src, dst, weight 1.0): the 4-connected neighbours, both directions, without a join."""
    steps = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((-1, 0), (1, 0), (0, -1), (0, 1))]))
    moved = nodes.select(F.col("zip").alias("src"), "row", "col", steps.alias("s")).select("src", (F.col("row") + F.col("s.r")).alias("r"), (F.col("col") + F.col("s.c")).alias("c"))
    inside = moved.filter(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1))
    return inside.select("src", F.format_string("Z%03d%03d", "r", "c").alias("dst"), F.lit(1.0).alias("weight"))


def lattice_grid(spark: SparkSession, width: int, height: int, block_w: int = 1, block_h: int = 1) -> tuple[DataFrame, Graph]:
    """The lattice's table and its rook graph."""
    nodes = lattice_nodes(spark, width, height, block_w, block_h)
    return nodes, Graph(nodes.select("zip"), lattice_edges(nodes, width, height))


def make_embeddings(df: DataFrame, noise: float = 0.05, emb_prefix: str = "e", random_state: int = 42, use_float32: bool = True) -> DataFrame:
    """Adds <prefix>0 = row / max(1, max row) and <prefix>1 likewise from col, plus N(0, noise)."""
    require_columns(df, "zip", "row", "col")
    if noise < 0:
        raise ValueError("noise must not be negative")
    kind = "float" if use_float32 else "double"
    tops = df.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    out = df
    for i, (name, top) in enumerate((("row", tops.r), ("col", tops.c))):
        value = F.col(name) / float(max(1, top or 0))
        if noise:
            value = value + F.lit(noise) * normal(random_state, f"{emb_prefix}{i}", F.col("zip"))
        out = out.withColumn(f"{emb_prefix}{i}", value.cast(kind))
    return out
