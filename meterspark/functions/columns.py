"""Small Column helpers shared by the operators (all JVM-side expressions)."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip to [lo, hi] keeping nulls null (``least``/``greatest`` skip nulls)."""
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(out)


def round_half_even(c: Column, digits: int) -> Column:
    """Round like Python's ``round`` on floats: scale, ``rint`` (half to even), unscale."""
    s = float(10 ** digits)
    return F.rint(c * s) / s


def row_sum(cols: list[str]) -> Column:
    """Row sum that treats nulls as 0 (a pandas ``sum(axis=1)``)."""
    if not cols:
        return F.lit(0.0)
    return reduce(add, [F.coalesce(F.col(c), F.lit(0.0)) for c in cols])


def row_count_if(cols: list[str], pred) -> Column:
    return reduce(add, [F.coalesce(pred(F.col(c)).cast("int"), F.lit(0)) for c in cols])


def fmt(c: Column, pattern: str) -> Column:
    """Number text with a DecimalFormat pattern ('0', '0.0', '+0;-0'): half-to-even
    on the exact value, the same text Python's format specs give."""
    return F.call_function("format_number", c, F.lit(pattern))


def is_true(c: Column) -> Column:
    """Python truthiness of a numeric 0/1 column (null counts as false)."""
    return F.coalesce(c != 0, F.lit(False))
