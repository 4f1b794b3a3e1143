"""Dilution, pH, quenching and selectivity series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafold.functions.numeric import round_half_even, signif
from spectrafold.functions.strict import safe_div, strict_sum
from spectrafold.functions.text import category, na_text
from spectrafold.operators.aggregates import raw_integral, replicate_median, replicate_spread
from spectrafold.operators.filters import clip_wavelength
from spectrafold.operators.joins import (
    attach_samples,
    attach_signal,
    normalize_to_max,
    normalize_to_reference,
)
from spectrafold.operators.models import origin_slope
from spectrafold.operators.smoothing import local_regression
from spectrafold.plans.yields import EMISSION_START, absorbance_365
from spectrafold.session import settle

# Sample volume, acceptance limits, linear range and pH of the series.
TOTAL_VOLUME = 3300.0
ACCEPTED = (0.97, 1.03)
LINEAR_RANGE = 4e-5
ABSORBANCE_FLOOR = 0.01
PH_LABELS = {"low": "3.8", "high": "6.0"}


def relative_concentration() -> Column:
    return round_half_even(safe_div("V_sample", "V_total"), 2)


def dilution_sheet(samples: DataFrame) -> DataFrame:
    return samples.withColumn("conc_rel", relative_concentration())


def dilution_curve(fl: DataFrame, samples: DataFrame) -> DataFrame:
    """Integral of each diluted sample; samples with a known pH belong to the pH series."""
    sums = fl.groupBy("file").agg(strict_sum("intensity").alias("integral"))
    rows = attach_samples(sums, dilution_sheet(samples)).where(F.col("pH").isNull())
    return rows.groupBy("file", "conc_rel").agg(
        F.min("sample").alias("sample"), strict_sum("integral").alias("integral")
    )


def dilution_fit(fl: DataFrame, samples: DataFrame, points: int = 80) -> DataFrame:
    curve = settle(dilution_curve(fl, samples), "dilution")
    return local_regression(curve, "conc_rel", "integral", ["sample"], points=points)


def ph_absorbance(ab: DataFrame) -> DataFrame:
    """Absorbance at 365 nm, unknown where it is no more than the noise floor."""
    a365 = absorbance_365(ab)
    return a365.withColumn(
        "absorbance", F.when(F.col("absorbance") > ABSORBANCE_FLOOR, F.col("absorbance"))
    )


def ph_series(fl: DataFrame, ab: DataFrame, samples: DataFrame) -> DataFrame:
    """Spectra of the samples with a known pH, with their absorbance."""
    known = samples.where(F.col("pH").isNotNull())
    rows = fl.join(dilution_sheet(known), "file", "inner")
    return attach_signal(rows, ph_absorbance(ab))


def dose_sheet(samples: DataFrame) -> DataFrame:
    dose = F.col("c_Hg_stock") * F.col("V_Hg") / F.lit(TOTAL_VOLUME)
    return samples.withColumn("c_Hg", dose)


def quenched_spectra(fl: DataFrame, samples: DataFrame) -> DataFrame:
    """Median spectrum per dose in micromol/L, scaled to its own maximum."""
    micromolar = signif(F.col("c_Hg") * 1e6, 2)
    sheet = dose_sheet(samples).withColumn("c_Hg", micromolar)
    sheet = sheet.select("file", "c_Hg", "sample", "pH")
    rows = attach_samples(clip_wavelength(fl, EMISSION_START, lo_open=True), sheet)
    groups = ["c_Hg", "sample", "pH"]
    medians = settle(replicate_median(rows, ["wavelength", *groups], "intensity"), "medians")
    scaled = normalize_to_max(medians, "intensity", groups)
    # Panels: whatever is not low is high.
    shown = F.when(F.col("pH") == "low", PH_LABELS["low"]).when(F.col("pH").isNotNull(), PH_LABELS["high"])
    return scaled.withColumn("pH", F.concat(F.lit("pH = "), na_text(shown)))


def _integrals(fl: DataFrame, sheet: DataFrame, columns: list[str]) -> DataFrame:
    sums = raw_integral(fl, ["file"], lo=EMISSION_START)
    return attach_samples(sums, sheet.select("file", *columns))


def _relative(df: DataFrame, is_ref: Column, keys: list[str]) -> DataFrame:
    rows = normalize_to_reference(df, "integral", is_ref, keys)
    return rows.withColumns(
        {"rel_integral": safe_div("integral", "ref"), "rel_sd": safe_div("sd", "ref")}
    )


def dose_response(fl: DataFrame, samples: DataFrame) -> DataFrame:
    """Integral per dose, replicates combined, relative to the zero dose."""
    rows = _integrals(fl, dose_sheet(samples), ["c_Hg", "sample", "pH"])
    spread = replicate_spread(rows, ["c_Hg", "sample", "pH"], "integral")
    return _relative(spread, F.col("c_Hg") == 0, ["sample", "pH"])


def quenching(response: DataFrame) -> DataFrame:
    """``I0 / I - 1`` and the decadic logarithm of the dose."""
    return response.withColumns(
        {
            "quenching": safe_div(F.lit(1.0), "rel_integral") - 1,
            "log_c": F.log10(F.nullif("c_Hg", F.lit(0.0))),
        }
    )


def stern_volmer(response: DataFrame) -> DataFrame:
    """Slope of the quenching line per sample and pH over the linear range."""
    rows = quenching(response).where(F.col("c_Hg") < LINEAR_RANGE)
    return origin_slope(rows, "c_Hg", "quenching", ["sample", "pH"])


def selectivity(fl: DataFrame, samples: DataFrame) -> DataFrame:
    """Integral per ion relative to the sample without ions."""
    rows = _integrals(fl, samples, ["sample", "ion"])
    spread = replicate_spread(rows, ["sample", "ion"], "integral")
    rows = _relative(spread, F.col("ion") == "ref", ["sample"])
    return rows.withColumn("responds", ~F.col("rel_integral").between(*ACCEPTED))
