from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spectrafold.operators import aggregates as agg
from spectrafold.operators import design, filters, joins


@pytest.fixture(scope="module")
def sheet(spark):
    return spark.createDataFrame([(1, "ref"), (2, "au")], "file int, type string")


def test_unmatched_spectrum_keeps_null_attributes(spark, sheet):
    df = spark.createDataFrame([(1,), (3,)], "file int")
    rows = {r.file: r.type for r in joins.attach_samples(df, sheet).collect()}
    assert rows == {1: "ref", 3: None}


def test_duplicate_key_in_sheet_fails(spark, sheet):
    df = spark.createDataFrame([(1,)], "file int")
    with pytest.raises(PySparkException, match="duplicate key"):
        joins.attach_samples(df, sheet.union(sheet)).collect()


def refs(spark, rows):
    return spark.createDataFrame(rows, "k string, kind string, x double")


def test_reference_by_key_including_null_key(spark):
    df = refs(spark, [("a", "ref", 2.0), ("a", "au", 6.0), (None, "ref", 4.0), (None, "au", 2.0),
                      ("b", "au", 1.0)])
    got = joins.normalize_to_reference(df, "x", F.col("kind") == "ref", ["k"])
    found = {(r.k, r.kind): r.ref for r in got.collect()}
    assert found == {("a", "ref"): 2.0, ("a", "au"): 2.0, (None, "ref"): 4.0, (None, "au"): 4.0,
                     ("b", "au"): None}


def test_several_references(spark):
    df = refs(spark, [("a", "ref", 2.0), ("a", "ref", 4.0), ("a", "au", 6.0)])
    is_ref = F.col("kind") == "ref"
    with pytest.raises(PySparkException, match="more than one reference"):
        joins.normalize_to_reference(df, "x", is_ref, ["k"]).collect()
    mean = joins.normalize_to_reference(df, "x", is_ref, ["k"], many="mean")
    assert {r.ref for r in mean.collect()} == {3.0}
    scalar = joins.normalize_to_reference(df, "x", is_ref, many="mean")
    assert {r.ref for r in scalar.collect()} == {3.0}


def test_maximum_becomes_one(spark):
    df = refs(spark, [("a", "", 2.0), ("a", "", 4.0), ("b", "", 0.0), ("c", "", None), ("c", "", 1.0)])
    got = sorted((r.k, r.x) for r in joins.normalize_to_max(df, "x", ["k"]).collect() if r.x is not None)
    assert got == [("a", 0.5), ("a", 1.0)]


def test_layers_skip_null_rules(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, flag boolean")
    rules = {"all": F.col("id") > 0, "yes": F.col("flag"), "no": ~F.col("flag")}
    got = sorted((r.id, r.layer) for r in filters.layers(df, rules).collect())
    assert got == [(1, "all"), (1, "yes"), (2, "all"), (2, "no"), (3, "all")]


def points(spark):
    rows = [(f, float(w), float(w), None if f == 2 else 2.0) for f in (1, 2) for w in range(350, 620, 10)]
    return spark.createDataFrame(rows, "file int, wavelength double, intensity double, absorbance double")


def test_missing_absorbance_gives_null_not_zero(spark):
    got = {r.file: r.integral for r in agg.normalized_integral(points(spark), ["file"], lo=400).collect()}
    assert got == {1: sum(range(410, 620, 10)) / 2, 2: None}


def test_fused_features_equal_separate_aggregates(spark):
    df = points(spark).where("file = 1")
    bands = {"narrow": (480.0, 500.0), "none": (700.0, 710.0)}
    fused = agg.spectrum_features(df, ["file"], 400, bands, divisor="absorbance").collect()[0]
    assert fused.integral == agg.normalized_integral(df, ["file"], lo=400).collect()[0].integral
    assert fused.scatter == agg.normalized_integral(df, ["file"], hi=400).collect()[0].integral
    assert (fused.narrow, fused.none) == (245.0, None)
    means = agg.band_means(df, bands, ["file"]).collect()[0]
    assert (means.narrow, means.none) == (245.0, None)


def test_empty_window_integral_is_zero(spark):
    got = {r.file: r.integral for r in agg.integral(points(spark), 700, 710).collect()}
    assert got == {1: 0.0, 2: 0.0}


def test_single_replicate_has_no_spread(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0)], "k string, x double")
    got = {r.k: (r.sd, r.x) for r in agg.replicate_spread(df, ["k"], "x").collect()}
    assert got["a"] == (None, 1.0)
    assert got["b"] == (pytest.approx(2**0.5), 2.0)


def test_encoded_levels(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, same double")
    rows = design.encode_levels(df, {"x": "x_level", "same": "same_level"}).collect()
    assert [r.x_level for r in rows] == [-1.0, 0.0, 1.0]
    assert {r.same_level for r in rows} == {None}


def test_grid_hits_its_ends_and_centre(spark):
    grid = design.level_grid(spark, ["a", "b"])
    assert grid.count() == 41**2
    assert grid.where("a IN (-1, 0, 1) AND b IN (-1, 0, 1)").count() == 9
    assert [r.a for r in grid.limit(3).collect()] == [-1.0, -0.95, -0.9]


def test_two_way_terms():
    assert design.two_way(["a", "b", "c"], drop=["c:a"]) == ["a", "b", "c", "a:b", "b:c"]


def test_top_k_ignores_null_scores(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 5.0), (4, 1.0)], "id int, s double")
    assert [r.id for r in design.top_k(df, "s", 2, ["id"]).collect()] == [2, 3]


@pytest.mark.parametrize("hi, width", [(10.0, 1.0), (14.0, 1.0), (15.0, 2.0), (29.0, 5.0), (71.0, 10.0)])
def test_band_width_is_a_round_number(spark, hi, width):
    df = spark.createDataFrame([(0.0,), (hi,), (width * 0.99,), (width,)], "z double")
    got = [r.band for r in design.band(df, "z").orderBy("z").collect()]
    assert got == [1, 1, 2, int(hi // width) + 1]


def test_constant_response_is_one_band(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "z double")
    assert [r.band for r in design.band(df, "z").collect()] == [1, 1]


def test_grid_of_some_levels(spark):
    whole = design.level_grid(spark, ["a", "b", "c"])
    some = design.level_grid(spark, ["a", "b", "c"], levels={"b": [-1.0, 0.0, 1.0], "c": [1.0]})
    assert some.count() == 41 * 3
    want = whole.where(F.col("b").isin(-1.0, 0.0, 1.0) & (F.col("c") == 1.0))
    assert sorted(some.collect()) == sorted(want.collect())


def test_unknown_key_keeps_its_baseline(spark):
    from spectrafold.operators.cleaning import baseline_correct

    rows = [(None, float(w), 5.0) for w in range(845, 905)]
    df = spark.createDataFrame(rows, "file int, wavelength double, intensity double")
    assert {r.intensity for r in baseline_correct(df, 850.0, 900.0).collect()} == {0.0}


def test_saturated_absorbance_stays_where_it_should(spark):
    from spectrafold.plans import spectra

    rows = [(1, float(w), 2.5 if w < 400 else 0.1) for w in range(300, 900)]
    df = spark.createDataFrame(rows, "file int, wavelength double, absorbance double")
    near = F.abs(F.col("wavelength") - 365) <= 3
    assert spectra.absorbance(df).where(near).count() == 0
    assert spectra.absorbance(df, saturation=False).where(near).count() == 7
