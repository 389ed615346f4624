"""Cleaning: valid readings only, appliance channels filled and floored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterspark.config import APPLIANCE_MARKER


def appliance_columns(df: DataFrame) -> list[str]:
    """Appliance channels: names containing 'Appliance' (case-sensitive), so
    derived columns like ``appliance_sum`` are not channels."""
    return [c for c in df.columns if APPLIANCE_MARKER in c]


def _number(df: DataFrame, c: str):
    """The column with NaN as missing (Spark orders NaN above every number)."""
    x = F.col(c)
    return F.nanvl(x, F.lit(None).cast("double")) if dict(df.dtypes)[c] in ("double", "float") else x


def _valid(df: DataFrame):
    return F.coalesce(_number(df, "Aggregate") > 0, F.lit(False))


def clean(df: DataFrame) -> DataFrame:
    """Keep rows with ``Aggregate > 0`` (a null or NaN reading is missing), fill
    missing appliance readings with 0, floor negatives at 0, drop ``Issues``.
    Order is not materialised here: every row window orders by ``Time``."""
    apps = set(appliance_columns(df))
    out = []
    for c in df.columns:
        if c == "Issues":
            continue
        if c in apps:
            out.append(F.greatest(F.coalesce(_number(df, c), F.lit(0.0)), F.lit(0.0)).alias(c))
        else:
            out.append(F.col(c))
    return df.filter(_valid(df)).select(*out)


def cleaning_report(df: DataFrame) -> DataFrame:
    """Per house: rows read, rows removed, rows kept (one aggregation pass)."""
    return (df.groupBy("house_id")
            .agg(F.count(F.lit(1)).alias("rows_in"),
                 F.count_if(~_valid(df)).alias("rows_removed"),
                 F.count_if(_valid(df)).alias("rows_kept")))
