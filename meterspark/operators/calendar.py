"""Calendar columns from ``Time``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add_time_features(df: DataFrame) -> DataFrame:
    """hour, minute, day_of_week (0 = Monday), month, is_weekend,
    is_night (23:00-04:59), is_peak (07-09 and 17-21, both ends included)."""
    t = F.col("Time")
    h = F.hour(t)
    return df.select(
        "*",
        h.alias("hour"),
        F.minute(t).alias("minute"),
        F.weekday(t).alias("day_of_week"),
        F.month(t).alias("month"),
        (F.weekday(t) >= 5).cast("int").alias("is_weekend"),
        ((h >= 23) | (h < 5)).cast("int").alias("is_night"),
        (h.between(7, 9) | h.between(17, 21)).cast("int").alias("is_peak"),
    )
