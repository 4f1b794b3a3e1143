"""Plate-reader scans: wide tables, one column per well."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafold.functions.text import bracket_text, scan_mode
from spectrafold.operators.joins import attach_samples


def unpivot_plate(
    wide: DataFrame, fixed_wavelength: Column | float, exp_type: Column | str
) -> DataFrame:
    """One row per wavelength and well; the well id is the text in parentheses."""
    fixed = fixed_wavelength if isinstance(fixed_wavelength, Column) else F.lit(fixed_wavelength)
    kind = exp_type if isinstance(exp_type, Column) else F.lit(exp_type)
    long = wide.unpivot(["Wavelength"], None, "cell", "intensity")
    return long.select(
        F.col("Wavelength").alias("var_wavelength"),
        bracket_text(F.col("cell")).alias("cell"),
        "intensity",
        fixed.cast("double").alias("fixed_wavelength"),
        kind.alias("exp_type"),
    )


def read_plate(scans: Sequence[tuple[DataFrame, str]], samples: DataFrame) -> DataFrame:
    """Union of all scans, each with its header cell, joined to the sample table by well."""
    tidy = []
    for wide, header in scans:
        mode = scan_mode(F.lit(header))
        tidy.append(unpivot_plate(wide, mode["fixed_wavelength"], mode["exp_type"]))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tidy)
    return attach_samples(union, samples, "cell")
