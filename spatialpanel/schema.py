"""Declared schemas, column checks and the wide/array embedding adapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGES = T.StructType(
    [T.StructField("src_zip", T.StringType()), T.StructField("dst_zip", T.StringType()), T.StructField("weight", T.DoubleType())]
)
PANEL_KEYS = ("geo_id", "date")


def require_columns(df: DataFrame, *names: str) -> None:
    """ValueError naming the missing columns; reads the schema only (no job)."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def require_numeric(df: DataFrame, *names: str) -> None:
    """ValueError unless every named column has a numeric type."""
    require_columns(df, *names)
    bad = [f.name for f in df.schema.fields if f.name in names and not isinstance(f.dataType, T.NumericType)]
    if bad:
        raise ValueError(f"columns must be numeric: {bad}")


def embedding_columns(df: DataFrame, prefix: str = "e") -> list[str]:
    """Columns named prefix + digits, in numeric order of the digits."""
    found = [c for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()]
    if not found:
        raise ValueError(f"no embedding columns with prefix {prefix!r}")
    return sorted(found, key=lambda c: int(c[len(prefix) :]))


def feature_columns(df: DataFrame, keys: tuple[str, ...] = PANEL_KEYS) -> list[str]:
    """Every column but the panel keys, in table order."""
    require_columns(df, *keys)
    found = [c for c in df.columns if c not in keys]
    if not found:
        raise ValueError("no feature columns besides the keys")
    return found


def from_wide(df: DataFrame, key: str = "zip", prefix: str = "e", extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, embedding ARRAY<DOUBLE>) from e0, e1, ...; ``extra`` columns are appended unscaled."""
    cols = embedding_columns(df, prefix)
    require_numeric(df, *cols, *extra)
    return df.select(key, F.array(*[F.col(c).cast("double") for c in (*cols, *extra)]).alias("embedding"))


def to_wide(df: DataFrame, dims: int, key: str = "zip", prefix: str = "e") -> DataFrame:
    """The inverse of ``from_wide`` for vectors of ``dims`` components."""
    return df.select(key, *[F.get("embedding", F.lit(i)).alias(f"{prefix}{i}") for i in range(dims)])


def all_finite(vector: Column) -> Column:
    """True if no component is NULL, NaN or infinite."""
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def repeated(df: DataFrame, key: str) -> DataFrame:
    """(key, n): the keys with more than one row. One partially aggregated shuffle."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def require_unique(df: DataFrame, key: str) -> None:
    """ValueError if a key repeats."""
    if not repeated(df, key).isEmpty():
        raise ValueError(f"{key} is not unique")
