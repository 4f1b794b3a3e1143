"""The rows behind each figure, with the columns that tell its series and panels apart.

Figures of spectra filter and label cleaned spectra; the others select from an analysis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafold.functions.strict import safe_div
from spectrafold.functions.text import na_text, number_text
from spectrafold.operators.design import band
from spectrafold.operators.filters import clip_wavelength, clip_xy, has_text
from spectrafold.operators.joins import attach_samples, attach_signal
from spectrafold.plans.mixing import control_spectra
from spectrafold.plans.quenching import dilution_sheet, quenched_spectra, quenching
from spectrafold.plans.yields import absorbance_365

# Panel titles.
SODIUM = "<i>r</i><sub>Na/H</sub> = "
CITRATE = "<i>r</i><sub>citr</sub> = "


def _titled(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), na_text(number_text(F.col(column))))


def ratio_emission(fl: DataFrame, samples: DataFrame) -> DataFrame:
    rows = attach_samples(fl, samples).where(F.col("type") != "ref")
    return clip_xy(rows, "wavelength", (400, 800))


def ratio_absorbance(ab: DataFrame, samples: DataFrame) -> DataFrame:
    rows = attach_samples(ab, samples).where(F.col("type") != "ref")
    return clip_xy(rows, "wavelength", (280, 500), "absorbance", (0, 1.25))


def yield_bars(yields: DataFrame, *series: str) -> DataFrame:
    return yields.select(*series, (F.col("qy") * 100).alias("qy_percent"))


def control_absorbance(ab: DataFrame, samples: DataFrame) -> DataFrame:
    return clip_xy(control_spectra(ab, samples), "wavelength", (280, 500), "absorbance", (0, 2.5))


def control_emission(fl: DataFrame, samples: DataFrame) -> DataFrame:
    return clip_xy(control_spectra(fl, samples), "wavelength", (400, 800))


def _scaled(fl: DataFrame, ab: DataFrame, samples: DataFrame) -> DataFrame:
    rows = attach_samples(fl, samples).where(F.col("type") == "au")
    rows = attach_signal(clip_wavelength(rows, 400), absorbance_365(ab))
    return rows.withColumn("intensity", safe_div("intensity", "absorbance"))


def factorial_overview(fl: DataFrame, ab: DataFrame, samples: DataFrame) -> DataFrame:
    """Every factorial spectrum, coloured by whether it contains azide."""
    return _scaled(fl, ab, samples).withColumn("azide", F.col("N3_level") > -1)


def without_azide(fl: DataFrame, ab: DataFrame, samples: DataFrame) -> DataFrame:
    rows = _scaled(fl, ab, samples.where(F.col("N3_level") == -1))
    return rows.withColumn("panel", _titled(SODIUM, "NaH_level"))


# The levels of citrate and sodium that have a panel.
PANEL_LEVELS = [-1.0, 0.0, 1.0]


def response_panels(grid: DataFrame, z: str) -> DataFrame:
    """Slices of the five-factor response at three levels of citrate and sodium, banded.

    All gold levels are kept, as in the grid.
    """
    rows = grid.where(F.col("Citr_level").isin(PANEL_LEVELS) & F.col("NaH_level").isin(PANEL_LEVELS))
    rows = band(rows, z)
    return rows.select(
        "Au_level", "AMP_level", "N3_level", F.col(z).alias("z"), "band",
        _titled(CITRATE, "Citr_level").alias("row"), _titled(SODIUM, "NaH_level").alias("panel"),
    )


def yellow_panels(grid: DataFrame) -> DataFrame:
    rows = band(grid.where(F.col("Citr_level").isin(-1.0, 0.0, 1.0)), "target")
    return rows.select(
        "AMP_level", "NaH_level", F.col("target").alias("z"), "band",
        _titled(CITRATE, "Citr_level").alias("panel"),
    )


def diluted_emission(fl: DataFrame, samples: DataFrame) -> DataFrame:
    sheet = dilution_sheet(samples).where(F.col("pH").isNull() & (F.col("conc_rel") > 0.1))
    return clip_xy(fl.join(sheet, "file", "inner"), "wavelength", (400, 850))


def ph_emission(series: DataFrame) -> DataFrame:
    return clip_xy(series, "wavelength", (400, 850))


def dose_points(response: DataFrame) -> DataFrame:
    return quenching(response).where(F.col("c_Hg") != 0)


def quenching_points(response: DataFrame) -> DataFrame:
    return quenching(response).where(F.col("c_Hg") < 1e-4)


def normalised_emission(fl: DataFrame, samples: DataFrame) -> DataFrame:
    spectra = quenched_spectra(fl, samples)
    return clip_xy(spectra, "wavelength", (400, 850), "intensity", (0, 1))


def ion_bars(response: DataFrame) -> DataFrame:
    return response.where(~has_text("ion", "^ref$"))
