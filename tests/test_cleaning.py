from __future__ import annotations

import random
import statistics

import pytest

from spectrafold.operators.cleaning import baseline_correct, clean_spectra, running_median, spectrum_inventory
from spectrafold.operators.splits import cut_groups, split_points, with_slice


def expected(raw: list[float], k: int) -> list[float]:
    """The running median with its end rule, point by point."""
    n = len(raw)
    h = min((k - 1) // 2, (n - 1) // 2)
    if h == 0:
        return list(raw)
    y = [
        raw[i] if i < h or i >= n - h else statistics.median(raw[i - h : i + h + 1])
        for i in range(n)
    ]
    s = list(y)
    for i in range(2, h + 1):
        s[i - 1] = statistics.median(y[: 2 * i - 1])
        s[n - i] = statistics.median(y[n - 2 * i + 1 :])
    s[0] = statistics.median([y[0], s[1], 3 * s[1] - 2 * s[2]])
    s[-1] = statistics.median([y[-1], s[-2], 3 * s[-2] - 2 * s[-3]])
    return s


@pytest.fixture(scope="module")
def spectra():
    rng = random.Random(7)
    found = {}
    for file, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 60, 400]):
        wavelengths = sorted(rng.uniform(200, 900) for _ in range(n))
        found[file] = [(w, rng.gauss(0, 10)) for w in wavelengths]
    return found


@pytest.fixture(scope="module")
def table(spark, spectra):
    rows = [(f, w, x) for f, points in spectra.items() for w, x in points]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "file int, wavelength double, intensity double").repartition(5)


def by_file(df):
    found = {}
    for row in df.collect():
        found.setdefault(row.file, []).append((row.wavelength, row.intensity))
    return {f: [x for _, x in sorted(points)] for f, points in found.items()}


@pytest.mark.parametrize("slice_rows", [10**6, 40, 15])
@pytest.mark.parametrize("k", [1, 3, 5, 7])
def test_running_median_equals_brute_force(table, spectra, k, slice_rows):
    got = by_file(running_median(table, k, slice_rows=slice_rows))
    assert got.keys() == spectra.keys()
    for file, points in spectra.items():
        assert got[file] == pytest.approx(expected([x for _, x in points], k), abs=1e-9)


def test_even_width_is_refused(table):
    with pytest.raises(ValueError):
        running_median(table, 4)


def test_empty_slices_between_clusters(spark):
    rows = [(0, 200.0 + i * 0.01, float((i * 37) % 11)) for i in range(40)]
    rows += [(0, 899.0 + i * 0.01, float((i * 17) % 13)) for i in range(3)]
    df = spark.createDataFrame(rows, "file int, wavelength double, intensity double")
    got = by_file(running_median(df, 5, slice_rows=8))[0]
    assert got == pytest.approx(expected([x for _, _, x in rows], 5))


def test_smoothing_is_shift_and_scale_equivariant(table):
    plain = by_file(running_median(table, 5))
    moved = by_file(running_median(table.selectExpr("file", "wavelength", "3 * intensity + 7 AS intensity"), 5))
    for file, values in plain.items():
        assert moved[file] == pytest.approx([3 * x + 7 for x in values], abs=1e-9)


def test_baseline_window_mean_is_zero(table):
    inside = "wavelength > 850 AND wavelength < 900"
    df = baseline_correct(table, 850, 900).where(inside).groupBy("file").avg("intensity")
    assert all(abs(r[1]) < 1e-9 for r in df.collect())


@pytest.mark.parametrize("slice_rows", [10**6, 30])
def test_clean_is_baseline_then_median(table, slice_rows):
    steps = by_file(running_median(baseline_correct(table, 850, 900), 5))
    fused = by_file(clean_spectra(table, slice_rows=slice_rows))
    for file, values in steps.items():
        if values[0] is None:
            assert all(x is None for x in fused[file])
        else:
            assert fused[file] == pytest.approx(values, abs=1e-9)


def test_no_point_in_baseline_window_gives_null(spark):
    df = spark.createDataFrame(
        [("a", 300.0 + i, 1.0) for i in range(9)], "file string, wavelength double, intensity double"
    )
    assert {r.intensity for r in clean_spectra(df).collect()} == {None}
    assert {r.intensity for r in baseline_correct(df, 850, 900).collect()} == {None}


def test_null_signal_makes_its_neighbours_null(spark):
    rows = [("a", float(i), None if i == 10 else float(i)) for i in range(21)]
    df = spark.createDataFrame(rows, "file string, wavelength double, intensity double")
    got = by_file(running_median(df, 5))["a"]
    assert [i for i, x in enumerate(got) if x is None] == [8, 9, 10, 11, 12]


def test_other_columns_and_their_order_survive(table):
    df = table.selectExpr("wavelength", "'x' AS note", "intensity", "file")
    assert clean_spectra(df).columns == df.columns


def test_one_full_shuffle(table):
    plan = clean_spectra(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def largest_slice(df, order, every):
    points = split_points(df, ["file"], order, every)
    placed = with_slice(cut_groups(df, points, ["file"]), order).groupBy("_slice").count()
    return placed.agg({"count": "max"}).collect()[0][0], placed.count()


def test_an_outlying_wavelength_does_not_make_slices_longer(spark):
    df = spark.range(20000).selectExpr("1 AS file", "IF(id = 0, 1e12, 300 + id / 1e4) AS wavelength", "sin(id) AS x")
    largest, slices = largest_slice(df, ["wavelength", "x"], 500)
    assert slices > 20 and largest < 500 * 12


def test_equal_wavelengths_are_cut_at_their_tie_breaks(spark):
    df = spark.range(20000).selectExpr("1 AS file", "365D AS wavelength", "sin(id) AS x")
    largest, slices = largest_slice(df, ["wavelength", "x"], 500)
    assert slices > 20 and largest < 500 * 12


@pytest.mark.parametrize("slice_rows", [25])
def test_outlier_and_equal_wavelengths_are_smoothed_alike(spark, slice_rows):
    rows = [(0, 1e9 if i == 0 else 300.0 + (i // 150), float((i * 37) % 1009)) for i in range(600)]
    df = spark.createDataFrame(rows, "file int, wavelength double, intensity double")
    got = running_median(df, 5, order=("wavelength",), slice_rows=slice_rows).collect()
    ordered = [x for _, _, x in sorted(rows, key=lambda r: (r[1], r[2]))]
    assert sorted(r.intensity for r in got) == pytest.approx(sorted(expected(ordered, 5)))


def test_an_inventory_handed_in_starts_no_job(spark, table):
    inventory = spectrum_inventory(table, baseline=(850.0, 900.0), slice_rows=30)
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    df = clean_spectra(table, slice_rows=30, inventory=inventory)
    assert len(tracker.getJobIdsForGroup(None)) == before
    assert by_file(df) == by_file(clean_spectra(table, slice_rows=30))
