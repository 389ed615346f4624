"""Exact percentile per group (linear interpolation, as NumPy's default),
without holding a whole group in one task.

``percentile_approx`` has a rank error of at most ``n / accuracy``; a bracket
of twice that around the wanted rank therefore contains the exact order
statistics. Rows below the bracket are only counted, and just the bracket's
distinct values (about ``4 n / accuracy`` per group, ties counted once) are
sorted, with their counts. If a bracket misses (it cannot by the error bound,
but it is checked), it is widened."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterspark.functions.lookup import lookup_join


# Values per group that the exact step may sort (the bracket around the rank).
BRACKET_ROWS = 1_000_000


def exact_percentile(df: DataFrame, keys: list[str], col: str, p: float, out: str = "percentile",
                     accuracy: int | None = None, max_group_rows: int | None = None,
                     max_tries: int = 10) -> DataFrame:
    """One row per group with the ``p`` quantile (0..1) of ``col``.

    ``accuracy`` defaults to a value that keeps the bracket of the largest
    group (``max_group_rows``, counted when not given) near BRACKET_ROWS."""
    v = F.col(col)
    if accuracy is None:
        if max_group_rows is None:
            max_group_rows = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]) or 0
        accuracy = int(min(2**31 - 1, max(10_000, -(-4 * max_group_rows // BRACKET_ROWS))))
    base = df.select(*keys, v.cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    width = 2.0 / accuracy
    stats = None
    for _ in range(max_tries):
        lo_p, hi_p = max(0.0, p - width), min(1.0, p + width)
        br = base.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"),
            F.percentile_approx("_v", [lo_p, hi_p], accuracy).alias("_br"))
        br = br.select(*keys, "_n", F.col("_br")[0].alias("_a"), F.col("_br")[1].alias("_b"))
        x = lookup_join(base, br, keys, "inner")
        # (value, count) pairs: ties of any number are one row, and all
        # values below the bracket are one row of their own.
        below = F.lit(float("-inf"))
        counts = (x.filter(F.col("_v") <= F.col("_b"))
                  .withColumn("_v", F.when(F.col("_v") < F.col("_a"), below).otherwise(F.col("_v")))
                  .groupBy(*keys, "_n", "_v").agg(F.count(F.lit(1)).alias("_c")))
        pos = F.lit(p) * (F.col("_n") - 1)
        upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v"))
        counts = counts.withColumns({"_upto": upto, "_pos": pos})
        at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v")))
        stats = counts.groupBy(*keys).agg(
            at(F.floor("_pos")).alias("_lo"), at(F.ceil("_pos")).alias("_hi"),
            F.first(F.col("_pos") - F.floor("_pos")).alias("_f"), F.min("_v").alias("_least"))
        stats = stats.cache()
        ok = stats.filter(((F.col("_lo") == below) & (F.col("_least") == below)) | F.col("_hi").isNull()).isEmpty()
        if ok or width >= 1.0:      # width 1: the bracket is the whole range
            break
        stats.unpersist()
        width *= 4
    lo, hi = F.col("_lo"), F.col("_hi")
    # NumPy's interpolation: a + (b - a) t, or b - (b - a)(1 - t) from t = 0.5.
    f = F.col("_f")
    val = F.when(f >= 0.5, hi - (hi - lo) * (1 - f)).otherwise(lo + (hi - lo) * f)
    return stats.select(*keys, val.alias(out))
