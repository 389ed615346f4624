"""Exact row-count windows per house that stay balanced when one house is huge.

Row frames ("the previous 29 rows") need the rows of a house in order. The
plain plan, ``Window.partitionBy('house_id').orderBy('Time')``, puts a whole
house into one task, so a house holding a third of all rows becomes a third
of the job in one task. ``row_windows`` windows each day of a house
on its own, whatever the house's size, next to the rows that its frames reach back to:

1. the last ``halo`` rows of every (house, day) are its tail (a group limit, applied
   before the shuffle, so few rows move);
2. the rows before a day are the last ``halo`` rows of the tails of earlier days, so
   a tail row is carried to each day that begins within the next ``halo`` tail rows
   of its house (a window over the tails alone, at most ``halo`` rows a day);
3. the window runs per (house, day) over its own rows and the carried ones, which are dropped.

Frames of at most ``halo + 1`` rows and lags up to ``halo`` are then exact,
a task holds a day's rows and ``halo`` more, and nothing is counted first.

With ``chunk_rows`` the rows are numbered instead (day counts, prefix sums, positions within
a day) and cut into chunks of so many. The views number their rows the same way. All of
this is part of the query's plan: no job runs and nothing is cached before the result is read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def day_counts(df: DataFrame, key: str = "house_id") -> DataFrame:
    return df.groupBy(key, _day_of_row().alias("_day")).agg(F.count(F.lit(1)).alias("_n"))


def _day_of_row() -> Column:
    """The day of a row; rows without a time sort first, as a day before all others."""
    return F.coalesce(F.to_date("Time"), F.lit("0001-01-01").cast("date"))


def with_row_index(df: DataFrame, order: Sequence[str] = ("Time",), key: str = "house_id", with_total: bool = False) -> DataFrame:
    """Add ``_idx``: 0-based position of each row within its house by ``order``, and
    optionally ``_total`` (rows of the house). Parallel over (house, day); the only
    per-house step runs on day counts, whose join is left to Spark's threshold at run time."""
    days = Window.partitionBy(key)
    before = F.sum("_n").over(days.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))
    offs = day_counts(df, key).select(F.col(key).alias("_key"), F.col("_day").alias("_on"), F.coalesce(before, F.lit(0)).alias("_off"),
                                      *([F.sum("_n").over(days).alias("_total")] if with_total else []))
    w = Window.partitionBy(key, "_day").orderBy(*order)
    x = df.withColumn("_day", _day_of_row()).withColumn("_at", F.row_number().over(w) - 1)
    x = x.join(offs, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_day") == F.col("_on")))
    return x.withColumn("_idx", F.col("_off") + F.col("_at")).drop("_off", "_day", "_at", "_key", "_on")


def with_carried_rows(df: DataFrame, halo: int, order: Sequence[str], key: str = "house_id") -> DataFrame:
    """The rows with ``_day``, and again, with ``_own`` false, the ``halo`` rows before each day of a house."""
    rows = df.withColumn("_day", _day_of_row())
    newest = Window.partitionBy(key, "_day").orderBy(*[F.desc(c) for c in order])
    tails = rows.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= halo).drop("_r")
    ahead = Window.partitionBy(key).orderBy("_day", *order).rowsBetween(1, halo)
    reach = tails.withColumn("_days", F.collect_set("_day").over(ahead))
    carried = reach.withColumn("_day", F.explode(F.array_except("_days", F.array("_day")))).drop("_days")
    return rows.withColumn("_own", F.lit(True)).unionByName(carried.withColumn("_own", F.lit(False)))


def row_windows(df: DataFrame, build: Callable[[WindowSpec], list[Column]], halo: int,
                order: Sequence[str] = ("Time",), key: str = "house_id",
                chunk_rows: int | None = None) -> DataFrame:
    """Add the columns ``build(w)`` makes from a per-house window spec ``w``
    ordered by ``order``, which begins with Time. ``build`` may use ``w.rowsBetween(-k, 0)`` with
    ``k <= halo`` and ``lag(.., n)`` with ``n <= halo``.

    ``chunk_rows``: None = by days with carried rows; 0 = one window task per house;
    N = chunks of N numbered rows."""
    if chunk_rows is None:
        rows = with_carried_rows(df, halo, order, key)
        w = Window.partitionBy(key, "_day").orderBy(*order)
        return rows.select("*", *build(w)).filter("_own").drop("_own", "_day")
    if not chunk_rows:
        w = Window.partitionBy(key).orderBy(*order)
        return df.select("*", *build(w))
    if chunk_rows <= halo:
        raise ValueError("chunk_rows must exceed the halo")
    x = with_row_index(df, order, key)
    home = F.floor(F.col("_idx") / chunk_rows)
    x = x.withColumn("_home", home).withColumn(
        "_wchunk",
        F.explode(F.when(F.col("_idx") % chunk_rows >= chunk_rows - halo,
                         F.array(F.col("_home"), F.col("_home") + 1))
                  .otherwise(F.array(F.col("_home")))))
    w = Window.partitionBy(key, "_wchunk").orderBy("_idx")
    return (x.select("*", *build(w))
            .filter(F.col("_wchunk") == F.col("_home"))
            .drop("_idx", "_home", "_wchunk"))
