"""Standard scaler per model scope: mean and population std per feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterspark.functions.lookup import lookup_join

SCOPE_KEY = "_scope"


def scope_keys(scope: str) -> list[str]:
    if scope == "house":
        return ["house_id"]
    if scope == "global":
        return [SCOPE_KEY]
    raise ValueError(f"scope must be 'house' or 'global', not {scope!r}")


def with_scope(df: DataFrame, scope: str) -> DataFrame:
    return df.withColumn(SCOPE_KEY, F.lit(0)) if scope == "global" and SCOPE_KEY not in df.columns else df


def available(df: DataFrame, wanted: list[str]) -> list[str]:
    """Configured features that exist in the frame, in configured order."""
    return [c for c in wanted if c in df.columns]


def fit_scaler(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """One row per scope key: ``<c>_mean`` and ``<c>_scale`` (population std,
    1 where the std is 0), plus ``_n`` rows. Nulls are ignored."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}_mean"), F.stddev_pop(x).alias(f"{c}_std")]
    s = df.groupBy(*keys).agg(*aggs)
    nonconst = sum((F.coalesce(F.col(f"{c}_std"), F.lit(0.0)) > 0).cast("int") for c in cols) if cols else F.lit(0)
    out = [*keys, "_n", nonconst.alias("_nonconst")]
    for c in cols:
        sd = F.col(f"{c}_std")
        out += [F.coalesce(F.col(f"{c}_mean"), F.lit(0.0)).alias(f"{c}_mean"),
                F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd).alias(f"{c}_scale")]
    return s.select(*out)


def scaled(c: str, fill_null: bool = True) -> Column:
    x = F.col(c).cast("double")
    if fill_null:
        x = F.coalesce(x, F.lit(0.0))
    return (x - F.col(f"{c}_mean")) / F.col(f"{c}_scale")


def apply_scaler(df: DataFrame, scaler: DataFrame, cols: list[str], keys: list[str],
                 prefix: str = "_z", fill_null: bool = True, known_rows: int | None = None, how: str = "inner") -> DataFrame:
    """Add ``<prefix>0..`` scaled columns (nulls as 0 first, as at prediction).
    With ``how="left"`` rows of a scope without a scaler stay, unscaled."""
    x = lookup_join(df, scaler.select(*keys, *[f"{c}_{s}" for c in cols for s in ("mean", "scale")]),
                    keys, how, known_rows=known_rows)
    x = x.select("*", *[scaled(c, fill_null).alias(f"{prefix}{i}") for i, c in enumerate(cols)])
    return x.drop(*[f"{c}_{s}" for c in cols for s in ("mean", "scale")])
