"""Scans and sinks. Parquet is the native format; CSV is read by column name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import require_columns


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder (a file or a directory of parts)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def edges_csv(spark: SparkSession, path: str) -> DataFrame:
    """Mobility edges from CSV with a header: ids stay text (leading zeros kept),
    columns are bound by name, an unreadable weight becomes NULL."""
    raw = spark.read.csv(path, header=True)
    require_columns(raw, "src_zip", "dst_zip", "weight")
    return raw.select("src_zip", "dst_zip", F.expr("try_cast(weight AS DOUBLE)").alias("weight"))


def polygons(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Polygons as (zip STRING, ring ARRAY<STRUCT<x DOUBLE, y DOUBLE>>) from Parquet or JSON."""
    df = spark.read.schema("zip string, ring array<struct<x:double,y:double>>").format(fmt).load(path)
    return df.filter(F.col("zip").isNotNull() & (F.size("ring") >= 3))


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "error") -> None:
    """Write a result; ``partition_by`` lays it out by column values."""
    out = df.write.mode(mode).format(fmt)
    if partition_by:
        out = out.partitionBy(*partition_by)
    if fmt == "csv":
        out = out.option("header", True)
    out.save(path)
