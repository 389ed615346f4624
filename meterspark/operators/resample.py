"""Downsampling: mean of every numeric column per (house, time bin)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from meterspark.functions.lookup import lookup_join

_UNITS = {
    "s": 1, "sec": 1, "second": 1, "seconds": 1, "S": 1,
    "min": 60, "t": 60, "T": 60, "minute": 60, "minutes": 60,
    "h": 3600, "H": 3600, "hour": 3600, "hours": 3600,
    "d": 86400, "D": 86400, "day": 86400, "days": 86400,
}


def freq_seconds(freq: str) -> int:
    """'1min', '1 minute', '15T', 'H', '1 hour' -> seconds."""
    m = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)\s*", freq)
    if not m or m.group(2) not in _UNITS and m.group(2).lower() not in _UNITS:
        raise ValueError(f"unsupported frequency: {freq!r}")
    n = int(m.group(1) or 1)
    unit = _UNITS.get(m.group(2), _UNITS.get(m.group(2).lower()))
    return n * unit


def downsample(df: DataFrame, freq: str = "1 minute") -> DataFrame:
    """Mean of each numeric column per ``freq`` bin and house; bins are
    left-closed and labelled by their start; empty bins do not appear.

    Bins line up with midnight of each house's first day, as in a per-house
    resample. When ``freq`` divides a day that equals epoch alignment, so no
    lookup is needed; otherwise each house's origin comes from a small
    per-house table (that arithmetic assumes a session time zone without
    daylight saving, e.g. UTC). One shuffle on (house, bin) with map-side
    partial means."""
    step_us = freq_seconds(freq) * 1_000_000
    numeric = [f.name for f in df.schema.fields
               if isinstance(f.dataType, NumericType) and f.name != "house_id"]
    if (86400 * 1_000_000) % step_us == 0:
        # Bins that divide a day: window() on TIMESTAMP_NTZ (no time zone).
        return (df.groupBy("house_id", F.window("Time", f"{step_us // 1_000_000} seconds").alias("_w"))
                .agg(*[F.avg(c).alias(c) for c in numeric])
                .select("house_id", F.col("_w.start").alias("Time"), *numeric))
    else:
        origins = df.groupBy("house_id").agg(
            F.to_date(F.min("Time")).cast("timestamp_ntz").alias("_origin"))
        src = lookup_join(df, origins, ["house_id"], "inner")
    bin_start = F.expr(
        f"timestampadd(MICROSECOND, floor(timestampdiff(MICROSECOND, _origin, Time) / {step_us}) * {step_us}, _origin)")
    return (src.groupBy("house_id", bin_start.alias("Time"))
            .agg(*[F.avg(c).alias(c) for c in numeric]))
