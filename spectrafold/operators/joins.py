"""Joins: sample sheets, scalars per spectrum, reference samples.

No side is forced to be broadcast. Spark broadcasts a side it has measured to be small and
otherwise shuffles both, splitting the partitions of a hot key (AQE skew join).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafold.functions.strict import safe_div, strict_avg, strict_max


def one_row_per_key(sheet: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``sheet`` itself; the query fails if a key occurs twice."""
    others = [c for c in sheet.columns if c not in keys]
    grouped = sheet.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_copies"), *[F.any_value(c).alias(c) for c in others]
    )
    unique = F.assert_true(F.col("_copies") == 1, F.lit(f"duplicate key {', '.join(keys)}"))
    return grouped.where(unique.isNull()).select(*sheet.columns)


def attach_samples(
    df: DataFrame, samples: DataFrame, on: str = "file", unique: bool = True
) -> DataFrame:
    """Add the attributes of the sample sheet; spectra without a sample keep NULLs."""
    sheet = one_row_per_key(samples, [on]) if unique else samples
    return df.join(sheet, on, "left")


def attach_signal(df: DataFrame, signal: DataFrame, on: str | Sequence[str] = "file") -> DataFrame:
    """Add one number per key (such as the absorbance at 365 nm); missing ones are NULL."""
    return df.join(signal, on if isinstance(on, str) else list(on), "left")


def left_join_null_safe(df: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which a NULL key matches a NULL key."""
    renamed = facts
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_r_{k}")
    match = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return df.join(renamed, match, "left").drop(*[f"_r_{k}" for k in keys])


def attach_scalar(df: DataFrame, value: DataFrame, name: str) -> DataFrame:
    """Add the single value of a one-row, one-column frame to every row."""
    return df.withColumn(name, value.scalar())


def normalize_to_reference(
    df: DataFrame,
    value: str,
    is_ref: Column,
    keys: Sequence[str] = (),
    ref_name: str = "ref",
    relabel: Mapping[str, str] | None = None,
    many: str = "raise",
) -> DataFrame:
    """Add the value of the reference row with the same ``keys``.

    ``relabel`` gives reference rows the key of the rows they are a reference for. More than
    one reference per key fails (``many="raise"``) or is averaged (``many="mean"``).
    """
    if many not in ("raise", "mean"):
        raise ValueError("many must be 'raise' or 'mean'")
    refs = df.where(is_ref)
    for column, label in (relabel or {}).items():
        refs = refs.withColumn(column, F.lit(label))
    if many == "mean":
        picked = strict_avg(value)
    else:
        picked = F.when(
            F.count(F.lit(1)) > 1, F.raise_error(F.lit("more than one reference per key"))
        ).otherwise(F.max(value))
    if not keys:
        return attach_scalar(df, refs.agg(picked.alias(ref_name)), ref_name)
    return left_join_null_safe(df, refs.groupBy(*keys).agg(picked.alias(ref_name)), keys)


def normalize_to_max(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Divide by the largest value of the group; a maximum of 0 gives NULL.

    The maxima are pre-aggregated and joined back rather than taken over a window, so a
    large group is never gathered in one task.
    """
    tops = df.groupBy(*keys).agg(strict_max(value).alias("_top"))
    joined = left_join_null_safe(df, tops, keys)
    return joined.withColumn(value, safe_div(value, "_top")).drop("_top")
