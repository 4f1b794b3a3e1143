"""Sample sheets: small CSV tables, one row per spectrum, read with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The columns of the sample sheets.
RATIO_SHEET = "file int, azide double, gold double, n3_au double, type string"
FACTORIAL_SHEET = (
    "file int, Au_level double, AMP_level double, Citr_level double, NaH_level double,"
    " N3_level double, type string, Au_conc double, AMP_ratio double, Citr_ratio double,"
    " NaH_ratio double, N3_ratio double, Au_vol double, AMP_vol double, CitrNa_vol double,"
    " CitrH_vol double, N3_vol double, water_vol double"
)
ORDER_SHEET = "file int, comp_1_2 string, comp_3 string, comp_4 string, comp_5 string, type string"
PH_SHEET = "file string, sample string, V_sample double, V_total double, pH double"
DOSE_SHEET = "file int, sample string, V_Hg double, c_Hg_stock double, pH string"
ION_SHEET = "file int, sample string, ion string, pH string"


def read_sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Empty cells are NULL; a byte-order mark and CRLF line ends are accepted."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=True)
