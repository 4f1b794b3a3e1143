"""Sources and sinks: the tables are written in each format by Spark, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.registry import entry
from catalog.sql import block
from catalog.views import FL_ORDER
from spectrafold.functions import text
from spectrafold.operators.joins import attach_samples
from spectrafold.plans import figures, spectra
from spectrafold.session import shared_folder
from spectrafold.sources.figures import write_figure
from spectrafold.sources.instrument import (
    OCEAN,
    SP,
    Dialect,
    file_stem,
    list_spectra,
    read_spectra,
    read_spectra_set,
)
from spectrafold.sources.plate import read_plate, unpivot_plate
from spectrafold.sources.sheets import FACTORIAL_SHEET, read_sheet

# Header lines of an instrument file. The last one looks like data.
HEADER = ["Data from Node", "User: x", "Integration Time (sec): 5,000000E-1",
          "Number of Pixels in Spectrum: 2068", "250,5\t99,5"]


# Many small files: Hadoop starts a program for every local file and folder it makes, and for checksum
# files as well; the latter are left out.
SMALL_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def _stem(prefix: str):
    return F.concat(F.lit(prefix), F.lpad(F.col("file").cast("string"), 5, "0"))


def _write_spectra(df: DataFrame, signal: str, dialect: Dialect, prefix: str) -> str:
    """One folder of text files per spectrum, header lines first."""
    def shown(column: str):
        return F.replace(F.col(column).cast("string"), F.lit("."), F.lit(dialect.decimal))

    stem = _stem(prefix)
    line = F.concat(shown("wavelength"), F.lit("\t"), F.lit(" "), shown(signal))
    data = df.select(stem.alias("file"), F.lit(1).alias("part"), line.alias("value"))
    above = [*HEADER[:-1], HEADER[-1].replace(",", dialect.decimal), f"not yet {dialect.marker}"]
    top = F.explode(F.array(*[F.lit(x) for x in [*above, dialect.marker]]))
    header = df.select(stem.alias("file")).distinct().select("file", F.lit(0).alias("part"),
                                                             top.alias("value"))
    path = shared_folder(df.sparkSession, "instrument")
    # A spectrum too large for one task is split; its further part files have no header.
    lines = data.unionByName(header).hint("rebalance", F.col("file"))
    lines = lines.sortWithinPartitions("file", "part").drop("part")
    lines.write.options(**SMALL_FILES).partitionBy("file").text(path)
    return path


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("file", text.sample_number(F.col("file")).cast("long"))


@entry("S1_spectra_scan", "SELECT file, wavelength, intensity FROM fu", "wavelength intensity")
def _(t):
    path = _write_spectra(t.fu, "intensity", OCEAN, "Subt2_")
    return _numbered(read_spectra(t.spark, path, folder_is_spectrum=True))


@entry("S2_preamble_skip", "SELECT file, count(*) AS n, min(wavelength) AS first, max(wavelength)"
       " AS last FROM fl GROUP BY file", "first last")
def _(t):
    path = _write_spectra(t.fl, "intensity", OCEAN, "O-")
    rows = _numbered(read_spectra(t.spark, path, folder_is_spectrum=True))
    return rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.min("wavelength").alias("first"),
        F.max("wavelength").alias("last"),
    )


@entry("S3_sp_dialect", "SELECT file, wavelength, intensity FROM fl", "wavelength intensity")
def _(t):
    path = _write_spectra(t.fl, "intensity", SP, "scan_")
    return _numbered(read_spectra(t.spark, path, dialect=SP, folder_is_spectrum=True))


@entry("S4_decimal_comma", "SELECT seq, wavelength, intensity * 1e-6 AS tiny FROM fl",
       "wavelength tiny", 12)
def _(t):
    def comma(value):
        return F.replace(value.cast("string"), F.lit("."), F.lit(","))

    return t.fl.select(
        "seq", OCEAN.number(comma(F.col("wavelength"))).alias("wavelength"),
        OCEAN.number(comma(F.col("intensity") * 1e-6)).alias("tiny"),
    )


@entry("S5_absorbance_reader", "SELECT file, wavelength, absorbance FROM ab",
       "wavelength absorbance")
def _(t):
    path = _write_spectra(t.ab, "absorbance", OCEAN, "Absorbance_")
    return _numbered(read_spectra(t.spark, path, signal="absorbance", folder_is_spectrum=True))


@entry("S6_file_stem", "SELECT seq, concat('Subt2.', lpad(CAST(file AS VARCHAR), 5, '0')) AS stem"
       " FROM fl")
def _(t):
    path = F.concat(F.lit("/data/fluoro/"), _stem("Subt2."), F.lit(".txt"))
    return t.fl.select("seq", file_stem(path).alias("stem"))


@entry("S7_sample_sheet", "SELECT CAST(file AS INTEGER) AS file, Au_level, AMP_level, Citr_level,"
       " NaH_level, N3_level, type, Au_conc, AMP_ratio, Citr_ratio, NaH_ratio, N3_ratio"
       " FROM factorial")
def _(t):
    columns = [c.split()[0] for c in FACTORIAL_SHEET.split(", ")]
    volumes = [c for c in columns if c.endswith("_vol")]
    sheet = t.factorial.withColumns({c: F.lit(None).cast("double") for c in volumes})
    path = shared_folder(t.spark, "sheet")
    sheet.select(*columns).write.option("header", True).option("lineSep", "\n").csv(path)
    return read_sheet(t.spark, path, FACTORIAL_SHEET).drop(*volumes)


@entry("S9_figure_sink", "SELECT f.file, f.seq, f.wavelength, f.intensity, s.n3_au FROM flx f"
       " JOIN ratio s ON f.file = s.file WHERE s.type <> 'ref'", "wavelength intensity n3_au")
def _(t):
    rows = spectra.with_samples(
        spectra.fluorescence(t.fl, FL_ORDER), t.ratio, F.col("type") != "ref"
    )
    path = shared_folder(t.spark, "figure")
    write_figure(rows.select("file", "seq", "wavelength", "intensity", "n3_au"), path, ["n3_au"])
    back = t.spark.read.parquet(path)
    return back.withColumn("n3_au", F.col("n3_au").cast("double"))


_STEM = "lpad(CAST(file AS VARCHAR), 5, '0')"


def _mixed_directory(t) -> str:
    """Emission and absorbance files of one experiment side by side."""
    stem = lambda prefix: _stem(prefix).alias("file")
    line = F.concat_ws("\t", "wavelength", F.coalesce("signal", F.lit(0.0))).alias("value")
    rows = t.fu.select(stem("Subt2_"), "wavelength", F.col("intensity").alias("signal"))
    rows = rows.unionByName(t.ab.select(stem("Absorbance_"), "wavelength", F.col("absorbance").alias("signal")))
    path = shared_folder(t.spark, "mixed")
    rows = rows.select("file", line).hint("rebalance", F.col("file"))
    rows.write.options(**SMALL_FILES).partitionBy("file").text(path)
    return path


@entry("K3_file_listing", f"SELECT DISTINCT concat('Subt2_', {_STEM}) AS file, 'emission' AS kind FROM fu"
       f" UNION ALL SELECT DISTINCT concat('Absorbance_', {_STEM}), 'absorbance' FROM ab")
def _(t):
    """Two patterns over one directory; only names are read."""
    path = _mixed_directory(t)
    kinds = {"Subt2_*": "emission", "Absorbance_*": "absorbance"}
    found = [list_spectra(t.spark, path, p, True).select("file", F.lit(k).alias("kind")) for p, k in kinds.items()]
    return found[0].unionByName(found[1])


@entry("S1_mixed_directory", f"SELECT concat('Absorbance_', {_STEM}) AS file, count(*) AS n,"
       " min(wavelength) AS first, max(wavelength) AS last FROM ab GROUP BY file", "first last")
def _(t):
    """One of the two kinds of files is read."""
    point = Dialect(marker=OCEAN.marker, decimal=".")
    rows = read_spectra(t.spark, _mixed_directory(t), "Absorbance_*", point, "absorbance", True)
    return rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.min("wavelength").alias("first"), F.max("wavelength").alias("last")
    )


@entry("S1_U1_directory_union", "SELECT file, wavelength, intensity FROM fl UNION ALL"
       " SELECT file, wavelength, intensity FROM fu", "wavelength intensity")
def _(t):
    paths = [_write_spectra(t.fl, "intensity", OCEAN, "Subt2_"),
             _write_spectra(t.fu, "intensity", OCEAN, "Subt2_")]
    return _numbered(read_spectra_set(t.spark, paths, folder_is_spectrum=True))


@entry("F2c_stored_control_emission", "SELECT x.file, x.wavelength, x.intensity, c.label FROM fuv x"
       " JOIN controls c ON x.file = c.file WHERE x.wavelength BETWEEN 400 AND 800",
       "wavelength intensity")
def _(t):
    """From instrument files to figure rows. Equal wavelengths are told apart by the signal."""
    path = _write_spectra(t.fu, "intensity", OCEAN, "Subt2_")
    raw = _numbered(read_spectra(t.spark, path, folder_is_spectrum=True))
    order = ("wavelength", "intensity")
    fl = spectra.fluorescence(raw, order, t.factorial, spectra.sample_is("control"))
    rows = figures.control_emission(fl, t.factorial)
    return rows.select("file", "wavelength", "intensity", "label")


# --- plates -------------------------------------------------------------------------------------

# Scan header cells and the wells of the test plate.
EMISSION = "Em scan 400-700 nm, Ex 365 nm"
EXCITATION = "Ex scan 250-500 nm, Detection at 520 nm"
WELLS = 25


def _wide(df: DataFrame) -> DataFrame:
    """One row per 5 nm step, one column per well."""
    steps = df.withColumn("Wavelength", F.floor(F.col("wavelength") / 5) * F.lit(5.0))
    wide = steps.groupBy("Wavelength").pivot("file", list(range(WELLS))).agg(F.avg("intensity"))
    names = {str(i): f"Sample {i} (A{i + 1:02d})" for i in range(WELLS)}
    return wide.withColumnsRenamed(names)


block("plate_rows", """
    SELECT floor(wavelength / 5) * 5.0 AS var_wavelength, concat('A', lpad(CAST(file + 1 AS VARCHAR), 2, '0'))
      AS cell, avg(intensity) AS intensity FROM fl GROUP BY ALL""")
block("plate_long", """
    SELECT w.var_wavelength, c.cell, p.intensity FROM (SELECT DISTINCT var_wavelength FROM plate_rows) w
    CROSS JOIN (SELECT cell FROM wells) c
    LEFT JOIN plate_rows p ON p.var_wavelength = w.var_wavelength AND p.cell = c.cell""")


@entry("X13_unpivot_plate", "SELECT CAST(var_wavelength AS DOUBLE) AS var_wavelength, cell, intensity,"
       " 365.0::DOUBLE AS fixed_wavelength, 'emission' AS exp_type FROM plate_long", "intensity")
def _(t):
    return unpivot_plate(_wide(t.fl), 365.0, "emission")


@entry("X14_bracket_text", "SELECT seq, CASE WHEN file % 2 = 0 THEN concat('A', CAST(file AS VARCHAR))"
       " END AS well FROM fl")
def _(t):
    number = F.col("file").cast("string")
    inside = F.concat(F.lit("Sample (A"), number, F.lit(") x (y)"))
    name = F.when(F.col("file") % 2 == 0, inside).otherwise(F.concat(F.lit("Sample A"), number))
    return t.fl.select("seq", text.bracket_text(name).alias("well"))


@entry("X15_scan_mode", "SELECT seq, CASE WHEN file % 2 = 0 THEN 'emission' ELSE 'excitation' END"
       " AS exp_type, CAST(300 + file AS DOUBLE) AS fixed_wavelength FROM fl")
def _(t):
    kind = F.when(F.col("file") % 2 == 0, F.lit("Em scan")).otherwise(F.lit("Ex scan"))
    header = F.concat(kind, F.lit(" 1-2 nm, at "), (300 + F.col("file")).cast("string"),
                      F.lit(" nm"))
    return t.fl.select("seq", text.scan_mode(header).alias("m")).select("seq", "m.*")


@entry("J2_plate_samples", "SELECT p.var_wavelength::DOUBLE AS var_wavelength, p.cell, p.intensity,"
       " s.type, s.conc FROM plate_long p LEFT JOIN wells s ON p.cell = s.cell", "intensity")
def _(t):
    tidy = unpivot_plate(_wide(t.fl), 365.0, "emission")
    joined = attach_samples(tidy, t.wells, "cell")
    return joined.select("var_wavelength", "cell", "intensity", "type", "conc")


_PLATE = """
    SELECT p.var_wavelength::DOUBLE AS var_wavelength, p.cell, p.intensity * k.f AS intensity,
      k.fixed_wavelength, k.exp_type, s.type, s.conc
    FROM plate_long p LEFT JOIN wells s ON p.cell = s.cell
    CROSS JOIN (VALUES (1.0::DOUBLE, 365.0::DOUBLE, 'emission'), (2.0, 520.0, 'excitation'))
      k(f, fixed_wavelength, exp_type)"""


def _plate(t) -> DataFrame:
    twice = t.fl.withColumn("intensity", F.col("intensity") * 2)
    return read_plate([(_wide(t.fl), EMISSION), (_wide(twice), EXCITATION)], t.wells)


@entry("S8_read_plate", _PLATE, "intensity")
def _(t):
    return _plate(t)


@entry("C16_plate_by_sample_type", f"SELECT exp_type, fixed_wavelength, type, var_wavelength,"
       f" avg(intensity) AS intensity FROM ({_PLATE}) x GROUP BY ALL", "intensity")
def _(t):
    groups = ["exp_type", "fixed_wavelength", "type", "var_wavelength"]
    return _plate(t).groupBy(*groups).agg(F.avg("intensity").alias("intensity"))
