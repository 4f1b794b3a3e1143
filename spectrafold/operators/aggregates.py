"""Aggregates over spectra. Sums and means are pre-aggregated before they are shuffled."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafold.functions.strict import (
    all_true,
    safe_div,
    strict_avg,
    strict_avg_where,
    strict_stddev,
    strict_sum,
    strict_sum_where,
)
from spectrafold.operators.filters import clip_wavelength, near_wavelength
from spectrafold.operators.joins import left_join_null_safe
from spectrafold.operators.quantiles import exact_median, exact_quantiles
from spectrafold.session import settle


def point_signal(
    df: DataFrame,
    center: float = 365.0,
    tolerance: float = 3.0,
    keys: Sequence[str] = ("file",),
    signal: str = "absorbance",
) -> DataFrame:
    """Median signal within ``tolerance`` of ``center``.

    The few rows near ``center`` are settled, so that both passes of the median read them
    instead of cleaning twice.
    """
    rows = near_wavelength(df, center, tolerance).select(*keys, signal)
    return exact_median(settle(rows, "point-signal"), keys, signal)


def normalized_integral(
    df: DataFrame,
    keys: Sequence[str],
    lo: float | None = None,
    hi: float | None = None,
    signal: str = "intensity",
    divisor: str = "absorbance",
) -> DataFrame:
    """Sum of ``signal / divisor`` above ``lo`` and below ``hi`` (open ends).

    An unknown or zero divisor makes the integral NULL.
    """
    rows = clip_wavelength(df, lo, hi, lo_open=True, hi_open=True)
    return rows.groupBy(*keys).agg(strict_sum(safe_div(signal, divisor)).alias("integral"))


def raw_integral(
    df: DataFrame, keys: Sequence[str], lo: float | None = None, signal: str = "intensity"
) -> DataFrame:
    rows = clip_wavelength(df, lo, lo_open=True)
    return rows.groupBy(*keys).agg(strict_sum(signal).alias("integral"))


def integral(
    df: DataFrame, lo: float, hi: float, keys: Sequence[str] = ("file",), signal: str = "intensity"
) -> DataFrame:
    """Sum over the open window divided by its width; an empty window gives 0."""
    inside = (F.col("wavelength") > lo) & (F.col("wavelength") < hi)
    return df.groupBy(*keys).agg(
        (strict_sum_where(inside, F.col(signal)) / F.lit(hi - lo)).alias("integral")
    )


def in_band(band: tuple[float, float]) -> Column:
    return F.col("wavelength").between(*band)


def band_means(
    df: DataFrame,
    bands: Mapping[str, tuple[float, float]],
    keys: Sequence[str],
    signal: str = "intensity",
    divisor: str = "absorbance",
) -> DataFrame:
    """Mean of ``signal / divisor`` in each closed band, all bands in one aggregation."""
    ratio = safe_div(signal, divisor)
    return df.groupBy(*keys).agg(
        *[strict_avg_where(in_band(band), ratio).alias(name) for name, band in bands.items()]
    )


def spectrum_features(
    df: DataFrame,
    keys: Sequence[str],
    split: float,
    bands: Mapping[str, tuple[float, float]],
    signal: str = "intensity",
    divisor: str | None = None,
) -> DataFrame:
    """Emission integral, scatter integral and band means of each spectrum in one pass.

    One row per spectrum with a point above ``split``; ``scatter`` is NULL without a point
    below it. A divisor that is constant within a spectrum is better applied to the result
    (``per_absorbance``) than joined to every point.
    """
    ratio = safe_div(signal, divisor) if divisor else F.col(signal)
    above, below = F.col("wavelength") > split, F.col("wavelength") < split
    scatter = F.when(F.count(F.when(below, F.lit(1))) > 0, strict_sum_where(below, ratio))
    features = df.groupBy(*keys).agg(
        F.count(F.when(above, F.lit(1))).alias("_above"),
        strict_sum_where(above, ratio).alias("integral"),
        scatter.alias("scatter"),
        *[strict_avg_where(in_band(band), ratio).alias(name) for name, band in bands.items()],
    )
    return features.where(F.col("_above") > 0).drop("_above")


def per_absorbance(
    features: DataFrame, absorbance: DataFrame, columns: Sequence[str], on: str = "file"
) -> DataFrame:
    """Divide per-spectrum sums and means by the absorbance of the spectrum.

    Equal to dividing every point first, but the join meets one row per spectrum.
    """
    joined = features.join(absorbance, on, "left")
    return joined.withColumns({c: safe_div(c, "absorbance") for c in columns})


def replicate_average(
    df: DataFrame, keys: Sequence[str], value: str, flags: Sequence[str] = ()
) -> DataFrame:
    """Mean over replicates; a flag holds if it holds in all of them."""
    return df.groupBy(*keys).agg(
        strict_avg(value).alias(value), *[all_true(f).alias(f) for f in flags]
    )


def replicate_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return exact_median(settle(df.select(*keys, value), "replicates"), keys, value)


def replicate_spread(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Standard deviation (``sd``) and median (under the name ``value``) over replicates."""
    rows = settle(df.select(*keys, value), "replicates")
    spread = rows.groupBy(*keys).agg(strict_stddev(value).alias("sd"))
    return left_join_null_safe(spread, exact_median(rows, keys, value), keys)


def group_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum, quartiles, mean and maximum of each column, one row per column.

    Reads ``df`` three times; hand in settled rows when it is costly.
    """
    doubles = df.select(*[F.col(c).cast("double") for c in columns])
    long = doubles.unpivot([], list(columns), "column", "value")
    places = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    spots = exact_quantiles(long, ["column"], "value", places)
    means = long.groupBy("column").agg(strict_avg("value").alias("mean"))
    return spots.join(means, "column").select(
        "column", "min", "q1", "median", "mean", "q3", "max"
    )
