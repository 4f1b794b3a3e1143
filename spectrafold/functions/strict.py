"""NA-strict aggregates.

A missing value makes the aggregate missing. Spark's own aggregates skip NULLs, which would
turn a spectrum without absorbance into a yield of 0 instead of "unknown".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _strict(agg: Column, value: Column) -> Column:
    return F.when(F.count(F.lit(1)) == F.count(value), agg)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strict_sum(value: Column | str) -> Column:
    value = _col(value)
    return _strict(F.sum(value), value)


def strict_avg(value: Column | str) -> Column:
    value = _col(value)
    return _strict(F.avg(value), value)


def strict_max(value: Column | str) -> Column:
    value = _col(value)
    return _strict(F.max(value), value)


def strict_min(value: Column | str) -> Column:
    value = _col(value)
    return _strict(F.min(value), value)


def strict_stddev(value: Column | str) -> Column:
    """Sample standard deviation; one row gives NULL."""
    value = _col(value)
    return _strict(F.stddev_samp(value), value)


def strict_avg_where(condition: Column, value: Column) -> Column:
    """Mean over the rows that meet ``condition``; NULL if there are none or one is NULL."""
    rows = F.count(F.when(condition, F.lit(1)))
    known = F.count(F.when(condition, value))
    return F.when(rows == known, F.avg(F.when(condition, value)))


def strict_sum_where(condition: Column, value: Column) -> Column:
    """Sum over the rows that meet ``condition``; 0 if there are none, NULL if one is NULL."""
    rows = F.count(F.when(condition, F.lit(1)))
    known = F.count(F.when(condition, value))
    total = F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))
    return F.when(rows == known, total)


def all_true(flag: Column | str) -> Column:
    """Three-valued ``all``: any FALSE wins, then any NULL makes it NULL."""
    flag = _col(flag)
    return F.when(~F.bool_and(F.coalesce(flag, F.lit(True))), F.lit(False)).when(
        F.count(F.lit(1)) == F.count(flag), F.lit(True)
    )


def safe_div(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient; a zero denominator gives NULL (ANSI mode would raise)."""
    return _col(numerator) / F.nullif(_col(denominator), F.lit(0.0))
