"""The rows behind a figure, as a partitioned table, and its inline literals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_figure(df: DataFrame, path: str, facets: Sequence[str] = ()) -> None:
    """Overwrite ``path`` with the rows of the figure, one folder per facet value.

    The rows of a facet are brought together first, so that a folder gets few files; the
    rebalance splits a facet that is too large for one task.
    """
    if not facets:
        df.write.mode("overwrite").parquet(path)
        return
    together = df.hint("rebalance", *[F.col(c) for c in facets])
    together.write.mode("overwrite").partitionBy(*facets).parquet(path)


def band_polygons(spark: SparkSession) -> DataFrame:
    """Corners of the two shaded wavelength bands; NULL is the edge of the panel."""
    # Band borders in nm.
    bands = [("blue", 480.0, 500.0), ("yellow", 590.0, 610.0)]
    corners = [
        (name, corner, x)
        for name, lo, hi in bands
        for corner, x in enumerate((lo, hi, hi, lo), start=1)
    ]
    return spark.createDataFrame(corners, "band string, corner int, x double")
