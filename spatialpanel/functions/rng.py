"""Counter-based random numbers: md5 of (seed, stream, key), so a draw depends
on its key alone, never on partitions or order, and SQL can repeat it."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, stream: str, *keys: Column) -> Column:
    """A number in [0, 1) with 52 random bits."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(stream), *[k.cast("string") for k in keys]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / float(1 << 52)


def normal(seed: int, stream: str, *keys: Column) -> Column:
    """A standard normal number by Box-Muller from streams ``<stream>a`` and ``<stream>b``."""
    u = F.greatest(uniform(seed, stream + "a", *keys), F.lit(2.0**-52))
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2 * math.pi) * uniform(seed, stream + "b", *keys))


def integer(seed: int, stream: str, below: Column, *keys: Column) -> Column:
    """A whole number in [0, below)."""
    return F.floor(uniform(seed, stream, *keys) * below).cast("int")
