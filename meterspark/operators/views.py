"""Row views of the replay: series, sliding windows, batches, positions, latest.

Positions are per-house row indexes from ``with_row_index`` (parallel over
(house, day)); sliding windows run by day with carried rows, so no view
needs a whole house in one task, and none counts anything before it is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterspark.operators.windows import row_windows, with_row_index


def baseline_band(df: DataFrame) -> DataFrame:
    """Consumption series with its baseline and the mean +- std band."""
    m, s = F.col("rolling_mean"), F.col("rolling_std")
    return df.select("house_id", "Time", "Aggregate", "rolling_mean",
                     (m - s).alias("band_low"), (m + s).alias("band_high"))


def anomaly_markers(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_anomaly") == 1).select("house_id", "Time", "Aggregate")


def cluster_series(df: DataFrame) -> DataFrame:
    return df.select("house_id", "Time", "Aggregate", "cluster", "cluster_label")


def recent_anomalies(df: DataFrame, n: int = 6) -> DataFrame:
    """The last ``n`` anomalous rows per house (window group limit)."""
    w = Window.partitionBy("house_id").orderBy(F.desc("Time"))
    return (df.filter(F.col("is_anomaly") == 1).withColumn("_r", F.row_number().over(w))
            .filter(F.col("_r") <= n).drop("_r"))


def latest(df: DataFrame) -> DataFrame:
    """Last reading per house (``max_by`` is a partial aggregation)."""
    cols = [c for c in df.columns if c != "house_id"]
    return (df.groupBy("house_id").agg(F.max_by(F.struct(*cols), F.col("Time")).alias("r"))
            .select("house_id", "r.*"))


def row_batches(df: DataFrame, size: int = 10) -> DataFrame:
    """Consecutive batches of ``size`` rows per house (the last may be short)."""
    x = with_row_index(df).withColumn("batch_id", F.floor(F.col("_idx") / size))
    aggs = [F.count(F.lit(1)).alias("rows"), F.min("Time").alias("start_time"), F.max("Time").alias("end_time"),
            F.avg("Aggregate").alias("avg_w"), F.max("Aggregate").alias("peak_w")]
    if "is_anomaly" in df.columns:
        aggs.append(F.sum("is_anomaly").cast("bigint").alias("anomalies"))
    return x.groupBy("house_id", "batch_id").agg(*aggs)


def sliding_views(df: DataFrame, size: int = 100, step: int = 1, chunk_rows: int | None = None) -> DataFrame:
    """Statistics of every replay window per house.

    Window ``i`` (``0 <= i < ceil(n / step)``) holds rows
    ``[max(0, e - size), e)`` with ``e = min(i * step + size, n)``, so every
    window is the ``size``-row frame ending at row ``e - 1``. The frames are
    one rolling pass; the rows that end a window are kept and the last row
    of a house is repeated for the tail windows that all end there."""
    has_anom = "is_anomaly" in df.columns

    def build(w):
        f = w.rowsBetween(-(size - 1), 0)
        cols = [F.count(F.lit(1)).over(f).alias("rows"), F.min("Time").over(f).alias("start_time"),
                F.avg("Aggregate").over(f).alias("avg_w"), F.max("Aggregate").over(f).alias("peak_w")]
        if has_anom:
            cols.append(F.sum("is_anomaly").over(f).cast("bigint").alias("anomalies"))
        return cols

    x = with_row_index(df, with_total=True).withColumnRenamed("_idx", "_j")
    x = row_windows(x, build, halo=max(size - 1, 1), chunk_rows=chunk_rows)
    j, n = F.col("_j"), F.col("_total")
    n_windows = F.ceil(n / step)
    first_tail = F.greatest(F.ceil((n - size) / step), F.lit(0))
    regular = (j >= size - 1) & ((j - (size - 1)) % step == 0) & (j + 1 < n)
    tail = F.when(first_tail <= n_windows - 1, F.sequence(first_tail, n_windows - 1))
    ids = (F.when((j == n - 1) & tail.isNotNull(), tail)
           .when(regular, F.array(((j - (size - 1)) / step).cast("bigint")))
           .otherwise(F.array().cast("array<bigint>")))
    out = x.select("*", F.explode(ids).alias("window_id"))
    keep = ["house_id", "window_id", "start_time", F.col("Time").alias("end_time"), "rows", "avg_w", "peak_w"]
    if has_anom:
        keep.append("anomalies")
    return out.select(*keep)


def view_at(df: DataFrame, i: int, size: int = 200, step: int = 5) -> DataFrame:
    """Rows shown after ``i`` advances of the replay pointer (per house).

    The pointer starts at ``size``, moves by ``step`` and wraps back to
    ``size`` once it passes the end, so after ``i`` calls it is at
    ``size + (i mod (M + 1)) * step`` with ``M = max(0, (n - size) div step)``;
    the view is rows ``[pos - size, pos)``."""
    x = with_row_index(df, with_total=True)
    m = F.greatest(F.floor((F.col("_total") - size) / step), F.lit(0))
    pos = F.lit(size) + (F.lit(i) % (m + 1)) * step
    return (x.filter((F.col("_idx") >= pos - size) & (F.col("_idx") < pos))
            .withColumnRenamed("_idx", "row_idx").drop("_total"))


def last_rows(df: DataFrame, n: int = 200) -> DataFrame:
    """The newest ``n`` rows per house (window group limit: no more than ``n``
    rows of a house leave a map task)."""
    w = Window.partitionBy("house_id").orderBy(F.desc("Time"))
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def preview(df: DataFrame, n: int = 3) -> DataFrame:
    """First ``n`` rows per house by time (window group limit)."""
    w = Window.partitionBy("house_id").orderBy("Time")
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def metric_row(view: DataFrame, minutes_per_row: float = 1.0) -> DataFrame:
    """Dashboard metric row per house: the view's latest power and its
    deviation from baseline, with the view's summary."""
    from meterspark.operators.reports import summary
    last = latest(view.select("house_id", "Time", "Aggregate", "deviation")).select(
        "house_id", F.col("Time").alias("latest_time"), F.col("Aggregate").alias("current_w"),
        F.col("deviation").alias("current_deviation_w"))
    return last.join(summary(view, minutes_per_row), "house_id")
