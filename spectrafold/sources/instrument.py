"""Directories of instrument files as one long table.

One scan reads every file: Spark lists the directory and packs small files into tasks. A file is
one record, cut at the line that ends its header, so nothing above that line becomes a row, whatever
it looks like. A row is a data line below it; lines are never counted, so mixed line ends do no
harm. Instrument files have some ten kilobytes; a spectrum too large for one record is
a folder of part files, the first of which holds the header.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrafold.functions.text import trimmed_number

# The formats of the instruments.
NUMBER = r"[-+]?(?:[0-9]+{point}?[0-9]*|{point}[0-9]+)(?:[eE][-+]?[0-9]+)?"


@dataclass(frozen=True)
class Dialect:
    """How a data line is written: ``wavelength<TAB>signal``."""

    marker: str
    decimal: str

    @property
    def header(self) -> str:
        """What precedes the data: all up to the first line that is the marker."""
        return rf"(?ms)\A.*?^\Q{self.marker}\E[ \t]*$"

    @property
    def data_line(self) -> str:
        number = NUMBER.format(point="\\" + self.decimal)
        return rf"^\s*{number}\t"

    def number(self, text: Column) -> Column:
        if self.decimal != ".":
            text = F.replace(text, F.lit(self.decimal), F.lit("."))
        return trimmed_number(text)


# The line that ends the header, and the decimal mark.
OCEAN = Dialect(marker=">>>>>Begin Spectral Data<<<<<", decimal=",")
SP = Dialect(marker="#DATA", decimal=".")


def file_stem(path: Column) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")


def _located(spark: SparkSession, directory: str, pattern: str, folder_is_spectrum: bool):
    """Reader, path and file stem for the files whose name (or folder) matches the glob ``pattern``."""
    if folder_is_spectrum:
        stem = F.regexp_extract("_metadata.file_path", r"/file=([^/]+)/", 1)
        # Folders, not their files: matched by one listing, then listed by Spark in parallel.
        return spark.read, f"{directory.rstrip('/')}/file={pattern}", stem
    reader = spark.read.option("pathGlobFilter", pattern)
    return reader, directory, file_stem(F.col("_metadata.file_name"))


def list_spectra(
    spark: SparkSession, directory: str, pattern: str = "*", folder_is_spectrum: bool = False
) -> DataFrame:
    """Columns ``file`` (the stem), ``files`` and ``bytes``, in order of the stem.

    Only the names and sizes of the files that match ``pattern`` are read, not their content.
    """
    reader, path, stem = _located(spark, directory, pattern, folder_is_spectrum)
    found = reader.format("binaryFile").load(path).select(stem.alias("file"), "length")
    sizes = found.groupBy("file").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    return sizes.orderBy("file")


def read_spectra(
    spark: SparkSession,
    directory: str,
    pattern: str | None = None,
    dialect: Dialect = OCEAN,
    signal: str = "intensity",
    folder_is_spectrum: bool = False,
) -> DataFrame:
    """Columns ``wavelength``, ``signal`` and ``file`` (the file stem).

    ``pattern`` is a glob on file names (``*txt`` if none is given). With ``folder_is_spectrum`` a
    spectrum is a folder ``file=<stem>`` of part files, as Spark writes it, and ``pattern`` a glob on
    stems. Lines up to the marker are no data; a file without the marker has no header. A
    signal that is no number is NULL.
    """
    pattern = pattern or ("*" if folder_is_spectrum else "*txt")
    reader, path, stem = _located(spark, directory, pattern, folder_is_spectrum)
    whole = reader.text(path, wholetext=True)
    data = F.regexp_replace("value", dialect.header, "")
    lines = whole.select(stem.alias("file"), F.explode(F.split(data, r"[\r\n]+")).alias("line"))
    fields = F.split("line", "\t")
    return lines.where(F.col("line").rlike(dialect.data_line)).select(
        dialect.number(F.get(fields, F.lit(0))).alias("wavelength"),
        dialect.number(F.get(fields, F.lit(1))).alias(signal),
        "file",
    )


def read_spectra_set(spark: SparkSession, directories: list[str], **options) -> DataFrame:
    """Spectra of several directories in one table."""
    frames = [read_spectra(spark, d, **options) for d in directories]
    table = frames[0]
    for frame in frames[1:]:
        table = table.unionByName(frame)
    return table
