"""Feature engineering: rolling, rate-of-change, appliance and hourly features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from meterspark.config import (ACTIVE_APPLIANCE_W, DIFF_CLIP, PCT_CLIP, ROLLING_EPS,
                               ROLLING_MIN_ROWS, ROLLING_WINDOW)
from meterspark.functions.columns import clip, row_count_if, row_sum
from meterspark.operators.cleaning import appliance_columns
from meterspark.operators.windows import row_windows


def _a():
    return F.col("Aggregate")


def _rolling_cols(w: WindowSpec, window: int, min_rows: int) -> list[Column]:
    frame = w.rowsBetween(-(window - 1), 0)
    enough = F.count(_a()).over(frame) >= min_rows
    return [F.when(enough, F.avg(_a()).over(frame)).alias("rolling_mean"),
            F.when(enough, F.stddev_samp(_a()).over(frame)).alias("rolling_std")]


def _rolling_derived(df: DataFrame) -> DataFrame:
    dev = _a() - F.col("rolling_mean")
    return df.withColumns({"deviation": dev,
                           "z_score": dev / (F.col("rolling_std") + ROLLING_EPS)})


def _lag_cols(w: WindowSpec) -> list[Column]:
    return [F.lag(_a(), 1).over(w).alias("_lag1"), F.lag(_a(), 5).over(w).alias("_lag5")]


def _rate_derived(df: DataFrame) -> DataFrame:
    l1 = F.col("_lag1")
    # a / 0 is +-inf (clipped to +-500) or NaN (null) in float arithmetic.
    pct = (F.when(l1 == 0, F.when(_a() > 0, F.lit(PCT_CLIP)).when(_a() < 0, F.lit(-PCT_CLIP)))
           .otherwise(clip((_a() / l1 - 1) * 100, -PCT_CLIP, PCT_CLIP)))
    return (df.withColumns({
        "diff_1": clip(_a() - l1, -DIFF_CLIP, DIFF_CLIP),
        "diff_5": clip(_a() - F.col("_lag5"), -DIFF_CLIP, DIFF_CLIP),
        "pct_change": pct,
    }).drop("_lag1", "_lag5"))


def row_order(df: DataFrame, unique_time: bool = False) -> list[str]:
    """Time alone where it is unique within a house (after downsampling), else
    Time and then the readings themselves: two readings of a house may share
    a timestamp, and row windows need one fixed order."""
    if unique_time:
        return ["Time"]
    return ["Time"] + [c for c in ["Aggregate"] + appliance_columns(df) if c in df.columns]


def add_rolling_features(df: DataFrame, window: int = ROLLING_WINDOW,
                         min_rows: int = ROLLING_MIN_ROWS, chunk_rows: int | None = None) -> DataFrame:
    """rolling_mean / rolling_std over the current and ``window - 1`` previous
    rows per house (null before ``min_rows`` rows), deviation, z_score."""
    out = row_windows(df, lambda w: _rolling_cols(w, window, min_rows), halo=max(window - 1, 1),
                      order=row_order(df), chunk_rows=chunk_rows)
    return _rolling_derived(out)


def add_rate_features(df: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """diff_1, diff_5 (clipped to +-5000 W) and pct_change (clipped to +-500 %)."""
    return _rate_derived(row_windows(df, _lag_cols, halo=5, order=row_order(df), chunk_rows=chunk_rows))


def add_appliance_features(df: DataFrame) -> DataFrame:
    """appliance_sum, unaccounted_load (floored at 0), active_appliances (> 10 W).
    Without appliance channels the frame is returned unchanged."""
    apps = appliance_columns(df)
    if not apps:
        return df
    s = row_sum(apps)
    return df.withColumns({
        "appliance_sum": s,
        "unaccounted_load": clip(_a() - s, lo=0.0),
        "active_appliances": row_count_if(apps, lambda c: c > ACTIVE_APPLIANCE_W),
    })


def hourly_profile(df: DataFrame) -> DataFrame:
    """Mean Aggregate per house and hour of day (<= 24 rows per house)."""
    if "hour" not in df.columns:
        df = df.withColumn("hour", F.hour("Time"))
    return df.groupBy("house_id", "hour").agg(F.avg(_a()).alias("hourly_avg"))


def add_hourly_pattern(df: DataFrame) -> DataFrame:
    """hourly_avg (mean for this hour over the whole frame) and above_hourly.
    The profile has at most 24 rows per house; Spark broadcasts it where its
    size at run time is below the session's threshold, else it splits large houses."""
    if "hour" not in df.columns:
        df = df.withColumn("hour", F.hour("Time"))
    out = df.join(hourly_profile(df), ["house_id", "hour"], "left")
    cols = [c for c in df.columns] + ["hourly_avg"]
    return out.select(*cols, F.coalesce((_a() > F.col("hourly_avg")).cast("int"), F.lit(0)).alias("above_hourly"))


def engineer_features(df: DataFrame, window: int = ROLLING_WINDOW, min_rows: int = ROLLING_MIN_ROWS,
                      chunk_rows: int | None = None, unique_time: bool = False) -> DataFrame:
    """All features, then the warm-up rows (null rolling stats) are dropped.
    ``unique_time``: a house has one row for each Time (see ``row_order``).

    Rolling and lag columns share one window pass;
    the hourly means are a partial aggregation joined back by (house, hour)."""
    halo = max(window - 1, 5)
    out = row_windows(df, lambda w: _rolling_cols(w, window, min_rows) + _lag_cols(w),
                      halo=halo, order=row_order(df, unique_time), chunk_rows=chunk_rows)
    out = _rate_derived(_rolling_derived(out))
    order = [c for c in df.columns] + ["rolling_mean", "rolling_std", "deviation", "z_score",
                                       "diff_1", "diff_5", "pct_change"]
    out = add_appliance_features(out.select(*order))
    out = add_hourly_pattern(out)
    return out.filter(F.col("rolling_mean").isNotNull() & F.col("rolling_std").isNotNull())


def warmup_report(features_before_drop: DataFrame) -> DataFrame:
    """Rows per house that the warm-up drop removes (null rolling stats)."""
    nul = F.col("rolling_mean").isNull() | F.col("rolling_std").isNull()
    return features_before_drop.groupBy("house_id").agg(F.count_if(nul).alias("warmup_dropped"))
