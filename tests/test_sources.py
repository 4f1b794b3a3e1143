from __future__ import annotations

from pyspark.sql import functions as F

from spectrafold.functions.text import sample_number
from spectrafold.sources.figures import band_polygons, write_figure
from spectrafold.sources.instrument import OCEAN, SP, read_spectra, read_spectra_set
from spectrafold.sources.plate import read_plate
from spectrafold.sources.sheets import DOSE_SHEET, PH_SHEET, read_sheet

# Header lines end in LF, the second begins with a stray CR, data lines end in CRLF.
HEADER = (
    "Data from x Node\n\rDate: Fri\nUser: v\nIntegration Time (sec): 5,000000E-1\n"
    "Scans to average: 5\nNumber of Pixels in Spectrum: 3\n>>>>>Begin Spectral Data<<<<<\n"
)


def write(path, lines):
    path.write_bytes((HEADER + "".join(f"{x}\r\n" for x in lines)).encode())


def test_directory_of_ocean_files(spark, tmp_path):
    write(tmp_path / "Subt2_00006.txt", ["199,4\t-0,496", "199,9\t8,0E-3", "200,4\t12"])
    write(tmp_path / "Subt2_00010.txt", ["199,4\t1", "200\tn/a"])
    write(tmp_path / "Absorbance_00006.txt", ["199,4\t0,1"])
    (tmp_path / "notes.md").write_text("1,0\t2,0\n")
    df = read_spectra(spark, str(tmp_path), "Subt2_*txt")
    assert df.columns == ["wavelength", "intensity", "file"]
    rows = sorted(tuple(r) for r in df.collect() if r.intensity is not None)
    assert rows == [
        (199.4, -0.496, "Subt2_00006"), (199.4, 1.0, "Subt2_00010"),
        (199.9, 0.008, "Subt2_00006"), (200.4, 12.0, "Subt2_00006"),
    ]
    assert df.where("intensity IS NULL").select("wavelength", "file").collect() == [
        (200.0, "Subt2_00010")
    ]
    ids = df.select(sample_number(F.col("file")).alias("n")).distinct().collect()
    assert sorted(r.n for r in ids) == [6, 10]


def test_absorbance_and_union_of_directories(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        write(tmp_path / name / "O-5.txt", ["300,5\t0,25"])
    df = read_spectra_set(
        spark, [str(tmp_path / "a"), str(tmp_path / "b")], signal="absorbance", dialect=OCEAN
    )
    assert [tuple(r) for r in df.collect()] == [(300.5, 0.25, "O-5")] * 2


def test_sp_files(spark, tmp_path):
    (tmp_path / "s_1.sp").write_text("PE UV\n#DATA\n400.5\t  12.25 \n401\t-3\n")
    df = read_spectra(spark, str(tmp_path), "*.sp", SP)
    assert sorted((r.wavelength, r.intensity, r.file) for r in df.collect()) == [
        (400.5, 12.25, "s_1"), (401.0, -3.0, "s_1")
    ]


def test_empty_directory(spark, tmp_path):
    assert read_spectra(spark, str(tmp_path)).count() == 0


def test_sheet_with_bom_crlf_and_no_last_line_end(spark, tmp_path):
    path = tmp_path / "samples.csv"
    path.write_bytes(
        b"\xef\xbb\xbffile,sample,V_Hg,c_Hg_stock,pH\r\n1,A,0,0,low\r\n330,B,150,1.00E-02,high"
    )
    rows = read_sheet(spark, str(path), DOSE_SHEET).collect()
    assert [tuple(r) for r in rows] == [(1, "A", 0.0, 0.0, "low"), (330, "B", 150.0, 0.01, "high")]


def test_sheet_with_empty_cells(spark, tmp_path):
    path = tmp_path / "samples.csv"
    path.write_bytes(b"\xef\xbb\xbffile,sample,V_sample,V_total,pH\r\nA1,A,0.1,3,\r\nB13,B,1.5,3,5.4")
    rows = read_sheet(spark, str(path), PH_SHEET).collect()
    assert [tuple(r) for r in rows] == [("A1", "A", 0.1, 3.0, None), ("B13", "B", 1.5, 3.0, 5.4)]


def test_plate(spark):
    wide = spark.createDataFrame(
        [(400.0, 1.0, 2.0), (405.0, 3.0, None)], "Wavelength double, `S (A01)` double, `S B` double"
    )
    samples = spark.createDataFrame([("A01", "ref")], "cell string, type string")
    rows = read_plate([(wide, "Em 400-700,Ex 365 nm"), (wide, "Ex 250,520")], samples).collect()
    assert len(rows) == 8
    first = [r for r in rows if r.cell == "A01" and r.exp_type == "emission"]
    assert sorted((r.var_wavelength, r.intensity, r.fixed_wavelength, r.type) for r in first) == [
        (400.0, 1.0, 365.0, "ref"), (405.0, 3.0, 365.0, "ref")
    ]
    assert {r.type for r in rows if r.cell is None} == {None}


def test_figure_sink_partitions_by_facet(spark, tmp_path):
    path = str(tmp_path / "figure")
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "panel string, x double")
    write_figure(df, path, ["panel"])
    write_figure(df, path, ["panel"])
    assert sorted(p.name for p in (tmp_path / "figure").glob("panel=*")) == ["panel=a", "panel=b"]
    assert spark.read.parquet(path).count() == 2


def test_band_polygons(spark):
    rows = band_polygons(spark).collect()
    assert [r.x for r in rows if r.band == "yellow"] == [590.0, 610.0, 610.0, 590.0]


def test_nothing_above_the_marker_is_data(spark, tmp_path):
    above = "Data\n\r1,5\t2,5\nsee >>>>>Begin Spectral Data<<<<<\n300,0\t7,0\n"
    below = "200,0\t1,0\r\n201,0\t-2,5E-1\r\n>>>>>Begin Spectral Data<<<<<\r\n202,0\t3,0\r\n"
    (tmp_path / "a_1.txt").write_bytes((above + ">>>>>Begin Spectral Data<<<<<\n" + below).encode())
    (tmp_path / "b_2.txt").write_bytes(b"200,0\t9,0\r\n")
    got = sorted(map(tuple, read_spectra(spark, str(tmp_path)).collect()))
    assert got == [(200.0, 1.0, "a_1"), (200.0, 9.0, "b_2"), (201.0, -0.25, "a_1"), (202.0, 3.0, "a_1")]


def test_listing_reads_names_only(spark, tmp_path):
    from spectrafold.sources.instrument import list_spectra

    for name in ("Subt2_00002.txt", "Subt2_00001.txt", "Absorbance_00001.txt", "notes.md"):
        (tmp_path / name).write_bytes(b"12345")
    got = list_spectra(spark, str(tmp_path), "Subt2_*txt")
    assert [tuple(r) for r in got.collect()] == [("Subt2_00001", 1, 5), ("Subt2_00002", 1, 5)]
    assert "ReadSchema: struct<length:bigint>" in got._jdf.queryExecution().toString()


def test_small_local_files_without_checksums(spark):
    """One file and one folder a spectrum, and nothing else that Hadoop starts a program for."""
    from pathlib import Path

    from catalog import formats

    rows = spark.range(6).selectExpr("id % 3 AS file", "id * 1.0D AS wavelength", "id * 2.0D AS intensity")
    path = formats._write_spectra(rows, "intensity", formats.OCEAN, "Subt2_")
    names = sorted(p.relative_to(path).parts[0] for p in Path(path).glob("file=*/*"))
    assert names == [f"file=Subt2_{i:05}" for i in range(3)]
    back = formats._numbered(formats.read_spectra(spark, path, "Subt2_*", folder_is_spectrum=True))
    assert sorted(map(tuple, back.select("file", "wavelength", "intensity").collect())) == sorted(map(tuple, rows.collect()))
