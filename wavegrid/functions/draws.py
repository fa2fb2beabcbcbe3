"""Reproducible draws: a hash of (seed, stream, key), so that partitioning never changes a value."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, stream: str, *keys: Column | str) -> Column:
    """U(0, 1) from the first 52 bits of an MD5."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *[c.cast("string") for c in cols]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def normal(seed: int, stream: str, *keys: Column | str, mean=0.0, sd=1.0) -> Column:
    """Box-Muller over two uniforms."""
    radius = F.sqrt(-2.0 * F.ln(uniform(seed, f"{stream}a", *keys)))
    return F.lit(mean) + F.lit(sd) * (radius * F.cos(2.0 * math.pi * uniform(seed, f"{stream}b", *keys)))


def discrete_uniform(seed: int, stream: str, *keys: Column | str, low: int, high: int) -> Column:
    return F.lit(low) + F.floor(uniform(seed, stream, *keys) * (high - low + 1)).cast("int")


def clamp(value: Column, low: Column | int, high: Column | int) -> Column:
    """The upper bound wins where the two cross."""
    return F.least(F.greatest(value, F.lit(low) if isinstance(low, int) else low), F.lit(high) if isinstance(high, int) else high)
