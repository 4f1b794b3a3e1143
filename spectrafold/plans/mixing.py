"""Order-of-mixing comparison and control experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafold.functions.strict import safe_div
from spectrafold.functions.text import component_label, label
from spectrafold.operators.aggregates import replicate_average
from spectrafold.operators.filters import clip_xy, layers
from spectrafold.operators.joins import attach_samples
from spectrafold.plans.yields import absorbance_365

FLAGS = ["au_last", "water_last", "ligands_first"]
# The label of a mixture and the component names of a control.
MIXTURE_LABEL = "{comp_1_2} < {comp_3} < {comp_4} < {comp_5}"
COMPONENTS = {"AMP": "AMP_ratio", "citr": "Citr_ratio", "N<sub>3</sub>": "N3_ratio"}


def order_sheet(samples: DataFrame) -> DataFrame:
    """Label and order flags of each mixture; an unknown component gives an unknown flag."""
    sheet = label(samples, MIXTURE_LABEL)
    sheet = sheet.withColumns(
        {"au_last": F.col("comp_5") == "Au", "water_last": F.col("comp_5") == "w"}
    )
    water_then_gold = (F.col("comp_4") == "w") & F.col("au_last")
    gold_then_water = (F.col("comp_4") == "Au") & F.col("water_last")
    return sheet.withColumn("ligands_first", water_then_gold | gold_then_water)


def mixture_spectra(spectra: DataFrame, samples: DataFrame, signal: str) -> DataFrame:
    """Mean spectrum of each mixture, replicates averaged."""
    sheet = order_sheet(samples).select("file", "label", *FLAGS)
    return replicate_average(
        attach_samples(spectra, sheet), ["label", "wavelength"], signal, FLAGS
    )


def mixture_emission(fl: DataFrame, ab: DataFrame, samples: DataFrame) -> DataFrame:
    """Mean emission spectra with the absorbance of their mixture."""
    emission = mixture_spectra(fl, samples, "intensity")
    a365 = absorbance_365(mixture_spectra(ab, samples, "absorbance"), ("label",))
    joined = emission.join(a365, "label", "left")
    return joined.withColumn("normalized", safe_div("intensity", "absorbance"))


def absorbance_layers(ab: DataFrame, samples: DataFrame) -> DataFrame:
    """Layers of the absorbance comparison, within the limits of the figure."""
    rules = {
        "ligands first": F.col("ligands_first"),
        "ligands first, water last": F.col("ligands_first") & F.col("water_last"),
        "other": ~F.col("ligands_first"),
    }
    spectra = mixture_spectra(ab, samples, "absorbance")
    return layers(
        clip_xy(spectra, "wavelength", (282.0, 500.0), "absorbance", (0.0, 1.5)), rules
    )


def emission_layers(fl: DataFrame, ab: DataFrame, samples: DataFrame) -> DataFrame:
    rules = {
        "gold last": F.col("au_last"),
        "water last": F.col("water_last"),
        "other": ~F.col("ligands_first"),
    }
    spectra = mixture_emission(fl, ab, samples)
    return layers(
        clip_xy(spectra, "wavelength", (400.0, 900.0), "normalized", (0.0, 36000.0)), rules
    )


def control_label() -> Column:
    return component_label({name: F.col(ratio) for name, ratio in COMPONENTS.items()})


def control_spectra(spectra: DataFrame, samples: DataFrame) -> DataFrame:
    """Control spectra labelled by the components they contain."""
    controls = samples.where(F.col("type") == "control").withColumn("label", control_label())
    return spectra.join(controls.select("file", "type", "label"), "file", "inner")
