"""Summary tables and dashboard datasets (all partial aggregations)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterspark.config import DAY_NAMES, THRESHOLDS
from meterspark.functions.columns import round_half_even
from meterspark.operators.cleaning import appliance_columns


def summary(df: DataFrame, minutes_per_row: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """Per house: readings, anomalies (count, % to 2 dp), mean / peak watts
    (1 dp), night anomalies, readings above 3000 W, energy in kWh (2 dp).
    ``minutes_per_row`` makes the energy right for bins other than 1 minute."""
    by = by if by is not None else ["house_id"]
    a, anom = F.col("Aggregate"), F.col("is_anomaly")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_readings"),
        F.sum(anom).cast("bigint").alias("anomaly_count"),
        round_half_even(F.avg(anom) * 100, 2).alias("anomaly_pct"),
        round_half_even(F.avg(a), 1).alias("avg_consumption_w"),
        round_half_even(F.max(a), 1).alias("peak_consumption_w"),
        F.count_if((anom == 1) & (F.col("is_night") == 1)).alias("night_anomalies"),
        F.count_if(a > THRESHOLDS["high_consumption_w"]).alias("high_consumption"),
        round_half_even(F.sum(a) * minutes_per_row / 1000 / 60, 2).alias("estimated_kwh"),
    )


def detection_rate(scored: DataFrame) -> DataFrame:
    """Flagged rows / all rows per house, in %."""
    return scored.groupBy("house_id").agg(
        F.sum("is_anomaly").cast("bigint").alias("flagged"), F.count(F.lit(1)).alias("total"),
        (F.avg("is_anomaly") * 100).alias("detection_pct"))


def date_range(df: DataFrame) -> DataFrame:
    return df.groupBy("house_id").agg(F.min("Time").alias("first_time"), F.max("Time").alias("last_time"))


def cluster_distribution(scored: DataFrame) -> DataFrame:
    """Rows per (house, cluster, label) and their share of the house in % (1 dp)."""
    c = scored.groupBy("house_id", "cluster", "cluster_label").agg(F.count(F.lit(1)).alias("count"))
    tot = F.sum("count").over(Window.partitionBy("house_id"))
    return c.withColumn("pct", round_half_even(F.col("count") / tot * 100, 1))


def appliance_breakdown(df: DataFrame, min_w: float = 1.0) -> DataFrame:
    """Mean watts per appliance channel and house, channels above ``min_w``,
    highest first (``rank`` 1 = highest)."""
    apps = appliance_columns(df)
    long = df.select("house_id", *apps).unpivot("house_id", apps, "appliance", "watts")
    m = long.groupBy("house_id", "appliance").agg(F.avg("watts").alias("avg_w")).filter(F.col("avg_w") > min_w)
    w = Window.partitionBy("house_id").orderBy(F.desc("avg_w"), "appliance")
    return m.withColumn("rank", F.row_number().over(w))


def hour_heatmap(df: DataFrame) -> DataFrame:
    """Mean Aggregate per weekday (rows) and hour (columns h00..h23); missing
    cells are null. The 24 pivot values are given, so no extra distinct job."""
    src = df
    if "hour" not in src.columns:
        src = src.withColumn("hour", F.hour("Time"))
    if "day_of_week" not in src.columns:
        src = src.withColumn("day_of_week", F.weekday("Time"))
    p = src.groupBy("house_id", "day_of_week").pivot("hour", list(range(24))).agg(F.avg("Aggregate"))
    names = F.array(*[F.lit(d) for d in DAY_NAMES])
    return p.select("house_id", "day_of_week", F.element_at(names, F.col("day_of_week") + 1).alias("day"),
                    *[F.col(str(h)).alias(f"h{h:02d}") for h in range(24)])
