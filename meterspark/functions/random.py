"""Reproducible per-row uniforms from hashes of row content (not of
partition layout), so fits give the same result under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO53 = float(2 ** 53)


def uniform(*parts) -> Column:
    """Uniform in (0, 1) from ``xxhash64`` of the given columns/literals."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return (F.pmod(F.xxhash64(*cols), F.lit(2 ** 53)).cast("double") + 0.5) / _TWO53
