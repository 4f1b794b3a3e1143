"""Rounding and small order statistics as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def signif(value: Column, digits: int) -> Column:
    """Round to ``digits`` significant digits, half to even; 0 stays 0.

    The power of ten is applied by a multiplication or a division by a whole power, so the
    result is the double nearest to the decimal and can serve as a key.
    """
    shift = F.lit(digits - 1) - F.floor(F.log10(F.abs(F.nullif(value, F.lit(0.0)))))
    up = F.pow(F.lit(10.0), F.greatest(shift, F.lit(0)))
    down = F.pow(F.lit(10.0), F.greatest(-shift, F.lit(0)))
    rounded = F.rint(value * up / down) * down / up
    return F.when(value == 0, F.lit(0.0)).otherwise(rounded)


def round_half_even(value: Column, scale: int) -> Column:
    """The nearer of the two neighbours with ``scale`` decimals; of equally near ones the even.

    Nearness is judged on the number as stored, so 0.15 (stored a little below) rounds to 0.1.
    """
    power = F.lit(10.0**scale)
    below = F.floor(value * power)
    low, high = below / power, F.ceil(value * power) / power
    down, up = value - low, high - value
    even = F.when(below % 2 == 0, low).otherwise(high)
    return F.when(down < up, low).when(down > up, high).when(down == up, even)


def med3(a: str, b: str, c: str) -> str:
    """Median of three known numbers, as SQL text."""
    return f"greatest(least({a}, {b}), least(greatest({a}, {b}), {c}))"


def median_of(values: Sequence[str]) -> str:
    """Median of an odd number of columns in one row, as SQL text; NULL if one is NULL."""
    size = len(values)
    if size % 2 == 0:
        raise ValueError("median_of needs an odd number of columns")
    if size == 1:
        return values[0]
    if size == 3:
        middle = med3(*values)
    elif size == 5:
        a, b, c, d, e = values
        low = f"greatest(least({a}, {b}), least({c}, {d}))"
        high = f"least(greatest({a}, {b}), greatest({c}, {d}))"
        middle = med3(e, low, high)
    else:
        middle = f"sort_array(array({', '.join(values)}))[{size // 2}]"
    return f"(CASE WHEN {' + '.join(values)} IS NOT NULL THEN {middle} END)"
