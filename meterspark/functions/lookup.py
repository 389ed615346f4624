"""Joins against small derived tables, broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterspark.config import DEFAULT_BROADCAST_ROWS


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left",
                max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS, known_rows: int | None = None) -> DataFrame:
    """Join ``big`` to a small derived table (statistics per house, per hour, ...).

    The small side is materialised once (cached; lost blocks are recomputed
    from lineage) and counted. Within ``max_broadcast_rows`` it is broadcast,
    so the big side is never shuffled; beyond it a shuffle join runs, where
    AQE's skew-join rule splits a hot key's partition. ``known_rows`` skips
    the count when the caller already knows the table's size."""
    if known_rows is None:
        small = small.cache()
        n = small.count()
    else:
        n = known_rows
    if n <= max_broadcast_rows:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)
