"""Row filters of the analyses. A NULL predicate drops the row."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip_wavelength(
    df: DataFrame,
    lo: float | None = None,
    hi: float | None = None,
    lo_open: bool = False,
    hi_open: bool = False,
) -> DataFrame:
    """Keep ``lo <= wavelength <= hi``; either end may be open or absent."""
    wavelength = F.col("wavelength")
    if lo is not None:
        df = df.where(wavelength > lo if lo_open else wavelength >= lo)
    if hi is not None:
        df = df.where(wavelength < hi if hi_open else wavelength <= hi)
    return df


def exclude_band(df: DataFrame, lo: float, hi: float) -> DataFrame:
    """Drop the open band ``(lo, hi)``; its ends stay."""
    return df.where((F.col("wavelength") <= lo) | (F.col("wavelength") >= hi))


def below_saturation(df: DataFrame, limit: float = 1.9, signal: str = "absorbance") -> DataFrame:
    return df.where(F.col(signal) <= limit)


def near_wavelength(df: DataFrame, center: float, tolerance: float) -> DataFrame:
    return df.where(F.abs(F.col("wavelength") - center) <= tolerance)


def clip_xy(
    df: DataFrame,
    x: str,
    xlim: tuple[float, float],
    y: str | None = None,
    ylim: tuple[float, float] | None = None,
) -> DataFrame:
    """Drop the rows outside the limits of a figure; the limits themselves stay."""
    df = df.where(F.col(x).between(*xlim))
    if y is not None and ylim is not None:
        df = df.where(F.col(y).between(*ylim))
    return df


def has_text(column: str, pattern: str) -> Column:
    return F.col(column).rlike(pattern)


def layers(df: DataFrame, rules: Mapping[str, Column], name: str = "layer") -> DataFrame:
    """One copy of a row per rule it meets, in one pass; a NULL rule is not met."""
    hits = F.array(*[F.when(rule, F.lit(layer)) for layer, rule in rules.items()])
    met = reduce(lambda a, b: a | b, [F.coalesce(rule, F.lit(False)) for rule in rules.values()])
    return df.where(met).withColumn(name, F.explode(F.array_compact(hits)))
