"""Cleaned spectra with their sample attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafold.operators.cleaning import clean_spectra
from spectrafold.operators.filters import below_saturation, clip_wavelength, exclude_band
from spectrafold.operators.joins import attach_samples

# Wavelength limits in nm and the largest trusted absorbance.
BASELINE = (850.0, 900.0)
SMOOTHING_WIDTH = 5
FLUORESCENCE_RANGE = (200.0, 900.0)
ABSORBANCE_END = 900.0
ARTEFACT_BAND = (650.0, 665.0)
SATURATION = 1.9


def cleaned(
    raw: DataFrame,
    signal: str,
    order: Sequence[str] = ("wavelength",),
    samples: DataFrame | None = None,
    keep: Column | None = None,
) -> DataFrame:
    """Baseline-corrected, smoothed spectra.

    With ``keep`` only the spectra whose sample meets it are cleaned. Whole spectra are
    dropped before the shuffle; wavelength limits come after it, since the baseline and the
    medians need the points beyond them.
    """
    if samples is not None and keep is not None:
        raw = raw.join(samples.where(keep).select("file"), "file", "left_semi")
    return clean_spectra(raw, signal, order=order, baseline=BASELINE, k=SMOOTHING_WIDTH)


def fluorescence(
    raw: DataFrame,
    order: Sequence[str] = ("wavelength",),
    samples: DataFrame | None = None,
    keep: Column | None = None,
) -> DataFrame:
    spectra = cleaned(raw, "intensity", order, samples, keep)
    return clip_wavelength(spectra, *FLUORESCENCE_RANGE)


def absorbance(
    raw: DataFrame,
    order: Sequence[str] = ("wavelength",),
    samples: DataFrame | None = None,
    keep: Column | None = None,
    saturation: bool = True,
    start: float | None = None,
) -> DataFrame:
    spectra = cleaned(raw, "absorbance", order, samples, keep)
    if saturation:
        spectra = below_saturation(spectra, SATURATION)
    return exclude_band(clip_wavelength(spectra, start, ABSORBANCE_END), *ARTEFACT_BAND)


def with_samples(spectra: DataFrame, samples: DataFrame, keep: Column | None = None) -> DataFrame:
    joined = attach_samples(spectra, samples)
    return joined if keep is None else joined.where(keep)


def sample_is(*types: str) -> Column:
    return F.col("type").isin(*types)
