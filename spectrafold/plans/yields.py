"""Relative quantum yields, the design tables built on them, and the response optimum.

Every per-spectrum number is aggregated by ``file`` first; sheet, absorbance and reference
are then joined to one row per spectrum.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrafold.functions.strict import safe_div
from spectrafold.functions.text import label
from spectrafold.operators.aggregates import (
    numeric_summary,
    per_absorbance,
    point_signal,
    spectrum_features,
)
from spectrafold.operators.design import encode_levels, level_grid, top_k, two_way
from spectrafold.operators.filters import has_text
from spectrafold.operators.joins import attach_samples, attach_scalar, normalize_to_reference
from spectrafold.operators.models import INTERCEPT, gated_product, ols, score
from spectrafold.session import settle

# Yield of the reference dye, excitation, emission border and bands in nm, the
# yield above which a sample counts, factor names and labels.
REFERENCE_YIELD = 0.54
EXCITATION = 365.0
EXCITATION_TOLERANCE = 3.0
EMISSION_START = 400.0
BANDS = {"int_365": (360.0, 370.0), "int_490": (480.0, 500.0), "int_600": (590.0, 610.0)}
FACTORS = ["Au_level", "AMP_level", "N3_level", "Citr_level", "NaH_level"]
BRIGHT_FRACTION = 0.02
LEVEL_LABEL = "au{Au_level}_AMP{AMP_level}_Citr{Citr_level}_NaH{NaH_level}_N3{N3_level}"
RATIO_LABEL = "au{Au_conc}_AMP{AMP_ratio}_Citr{Citr_ratio}_NaH{NaH_ratio}_N3{N3_ratio}"
RATIOS = {
    "AMP_ratio": "AMP_level",
    "Citr_ratio": "Citr_level",
    "NaH_ratio": "NaH_level",
    "N3_ratio": "N3_level",
}


def absorbance_365(ab: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    return point_signal(ab, EXCITATION, EXCITATION_TOLERANCE, keys)


def quantum_yield(df: DataFrame, ref_qy: float = REFERENCE_YIELD) -> DataFrame:
    return df.withColumn("qy", safe_div("integral", "ref_integral") * F.lit(ref_qy))


def _features(fl: DataFrame, ab: DataFrame, samples: DataFrame) -> DataFrame:
    # One row per spectrum from here on, read again for references, levels and models.
    features = settle(spectrum_features(fl, ["file"], EMISSION_START, BANDS), "features")
    scaled = per_absorbance(
        features, absorbance_365(ab), ["integral", "scatter", *BANDS]
    )
    return attach_samples(scaled, samples)


def _against_reference(df: DataFrame, value: str, ref_name: str) -> DataFrame:
    return normalize_to_reference(
        df, value, has_text("type", "ref"), ["type"], ref_name, relabel={"type": "au"}
    )


def ratio_yields(fl: DataFrame, ab: DataFrame, samples: DataFrame) -> DataFrame:
    """Yield of each sample of a ratio series against the one reference spectrum."""
    rows = _features(fl, ab, samples).select("file", "n3_au", "type", "integral")
    rows = quantum_yield(_against_reference(rows, "integral", "ref_integral"))
    return rows.where(~has_text("type", "ref"))


def factorial_design(fl: DataFrame, ab: DataFrame, samples: DataFrame) -> DataFrame:
    """Yield, relative scatter, band means and band ratio of each factorial sample."""
    rows = _features(fl, ab, samples).where(F.col("type").isin("au", "ref"))
    rows = label(rows, LEVEL_LABEL)
    rows = _against_reference(rows, "integral", "ref_integral")
    rows = quantum_yield(_against_reference(rows, "scatter", "ref_scatter"))
    rows = rows.where(~has_text("type", "ref")).withColumns(
        {
            "rel_scatter": safe_div("scatter", "ref_scatter"),
            "int_600_490": safe_div("int_600", "int_490"),
            "qy_percent": F.col("qy") * 100,
        }
    )
    return rows.select(
        "file", "label", *FACTORS, "integral", "ref_integral", "qy", "qy_percent",
        "rel_scatter", *BANDS, "int_600_490",
    )


def pooled_yields(fl: DataFrame, ab: DataFrame, samples: DataFrame, kind: str) -> DataFrame:
    """Yield of the samples of type ``kind`` against the mean of all reference spectra."""
    rows = _features(fl, ab, samples).where(F.col("type").isin(kind, "ref"))
    rows = rows.where(F.col("integral").isNotNull())
    rows = label(rows, RATIO_LABEL)
    pooled = rows.where(has_text("type", "ref")).agg(F.avg("integral"))
    rows = quantum_yield(attach_scalar(rows, pooled, "ref_integral"))
    return rows.where(~has_text("type", "ref"))


def optimisation_design(fl: DataFrame, ab: DataFrame, samples: DataFrame, kind: str) -> DataFrame:
    """Pooled yields with coded levels and the target ``qy * ratio`` of the bright samples."""
    rows = encode_levels(pooled_yields(fl, ab, samples, kind), RATIOS)
    ratio = safe_div("int_600", "int_490")
    rows = rows.withColumn("int_600_490", ratio).withColumn(
        "target", gated_product(F.col("qy"), BRIGHT_FRACTION, F.col("int_600_490"))
    )
    return rows.select(
        "file", "label", *RATIOS, *RATIOS.values(), "qy", *BANDS, "int_600_490", "target"
    )


# The models: response, terms and row filter.
FULL = two_way(FACTORS)
REDUCED_TARGET = ["Au_level", *two_way(
    FACTORS[1:], drop=["AMP_level:Citr_level", "AMP_level:NaH_level", "Citr_level:NaH_level"]
)]
YELLOW_FULL = two_way(["AMP_level", "N3_level", "Citr_level", "NaH_level"])
YELLOW_TARGET = ["AMP_level", "NaH_level", "AMP_level:NaH_level", "Citr_level"]


def factorial_models() -> dict[str, tuple[str, list[str], Column | None]]:
    bright, no_azide = F.col("qy") > 0.01, F.col("N3_level") == -1
    mains = ["Au_level", "AMP_level", "Citr_level", "NaH_level"]
    return {
        "qy": ("qy_percent", FULL, None),
        "qy_reduced": ("qy_percent", ["N3_level", "NaH_level"], None),
        "qy_no_azide": ("qy_percent", mains, no_azide),
        "target": ("int_600_490", FULL, bright),
        "target_reduced": ("int_600_490", REDUCED_TARGET, bright),
    }


def yellow_models() -> dict[str, tuple[str, list[str], Column | None]]:
    return {
        "target": ("target_percent", YELLOW_FULL, None),
        "target_reduced": ("target_percent", YELLOW_TARGET, None),
        "qy": ("qy", YELLOW_FULL, None),
        "qy_reduced": ("qy", ["AMP_level", "NaH_level"], None),
    }


TARGET_TERMS = [
    INTERCEPT, *FACTORS, "AMP_level:N3_level", "N3_level:Citr_level", "N3_level:NaH_level"
]
YIELD_TERMS = [INTERCEPT, "N3_level", "NaH_level"]
GRID_STEP = 0.05
BRIGHT_PERCENT = 2.0


def _fitted(design: DataFrame, model: tuple[str, list[str], Column | None]) -> DataFrame:
    response, terms, rows = model
    return ols(design if rows is None else design.where(rows), response, terms)


def response_grid(
    spark: SparkSession,
    design: DataFrame,
    step: float = GRID_STEP,
    levels: Mapping[str, Sequence[float]] | None = None,
) -> DataFrame:
    """Predicted band ratio, yield and target over all combinations of the five levels.

    ``levels`` restricts factors to some of their levels.
    """
    models = factorial_models()
    grid = level_grid(spark, FACTORS, step=step, levels=levels)
    grid = score(grid, _fitted(design, models["target"]), TARGET_TERMS, "yellow")
    grid = score(grid, _fitted(design, models["qy"]), YIELD_TERMS, "qy")
    target = gated_product(F.col("qy"), BRIGHT_PERCENT, F.col("yellow"))
    return grid.withColumn("target", target)


def yellow_grid(spark: SparkSession, design: DataFrame, step: float = GRID_STEP) -> DataFrame:
    """Predicted target over the levels of the three factors of the reduced model."""
    design = design.withColumn("target_percent", 100 * F.col("target"))
    coefs = _fitted(design, yellow_models()["target_reduced"])
    grid = level_grid(spark, ["AMP_level", "Citr_level", "NaH_level"], step=step)
    return score(grid, coefs, [INTERCEPT, *YELLOW_TARGET], "target")


def optimum(grid: DataFrame, by: str, k: int) -> DataFrame:
    """Where the ``k`` best grid points with the highest gold level lie."""
    ties = ["AMP_level", "N3_level", "Citr_level", "NaH_level"]
    best = top_k(grid.where(F.col("Au_level") == 1), by, k, ties)
    return numeric_summary(settle(best, "optimum"), [*FACTORS, "yellow", "qy", "target"])
