from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spectrafold.functions import numeric, strict, text


def one(df, *columns):
    return df.select(*columns).collect()[0]


@pytest.fixture(scope="module")
def dual(spark):
    return spark.range(1)


def test_aggregates_are_null_with_a_missing_value(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, 3.0), (2, 5.0), (3, 4.0)], "k int, x double")
    rows = {
        r.k: r
        for r in df.groupBy("k").agg(
            strict.strict_sum("x").alias("sum"), strict.strict_avg("x").alias("avg"),
            strict.strict_max("x").alias("max"), strict.strict_min("x").alias("min"),
            strict.strict_stddev("x").alias("sd"),
        ).collect()
    }
    assert rows[1].asDict() == {"k": 1, "sum": None, "avg": None, "max": None, "min": None, "sd": None}
    assert (rows[2].sum, rows[2].avg, rows[2].max, rows[2].min) == (8.0, 4.0, 5.0, 3.0)
    assert rows[2].sd == pytest.approx(2**0.5)
    assert rows[3].sd is None


def test_conditional_aggregates_of_an_empty_window(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    row = one(df.groupBy().agg(
        strict.strict_sum_where(F.lit(False), F.col("x")).alias("s"),
        strict.strict_avg_where(F.lit(False), F.col("x")).alias("a"),
    ), "s", "a")
    assert (row.s, row.a) == (0.0, None)


def test_all_true_is_three_valued(spark):
    rows = [(1, True), (1, True), (2, True), (2, None), (3, False), (3, None), (4, False), (4, True)]
    df = spark.createDataFrame(rows, "k int, b boolean")
    got = {r.k: r.b for r in df.groupBy("k").agg(strict.all_true("b").alias("b")).collect()}
    assert got == {1: True, 2: None, 3: False, 4: False}


def test_division_by_zero_is_null(dual):
    assert one(dual, strict.safe_div(F.lit(1.0), F.lit(0.0)).alias("x")).x is None


@pytest.mark.parametrize(
    "value, digits, want",
    [(123456.0, 2, 120000.0), (0.00123456, 3, 0.00123), (-7.84, 2, -7.8), (0.0, 2, 0.0),
     (1000.0, 2, 1000.0), (2.5, 1, 2.0), (9.99, 2, 10.0)],
)
def test_signif(dual, value, digits, want):
    assert one(dual, numeric.signif(F.lit(value), digits).alias("x")).x == want


@pytest.mark.parametrize(
    "value, scale, want",
    [(0.15, 1, 0.1), (0.25, 1, 0.2), (0.75, 1, 0.8), (0.0333, 2, 0.03), (-2.5, 0, -2.0),
     (0.5, 2, 0.5), (3.0, 2, 3.0)],
)
def test_round_half_even(dual, value, scale, want):
    assert one(dual, numeric.round_half_even(F.lit(value), scale).alias("x")).x == want


def test_signif_of_null(dual):
    assert one(dual, numeric.signif(F.lit(None).cast("double"), 2).alias("x")).x is None


def test_labels(spark):
    df = spark.createDataFrame([(30.0, 0.5, None, "w")], "a double, b double, c double, d string")
    assert one(text.label(df, "{a}:{b} < {c} ({d})"), "label").label == "30:0.5 < NA (w)"


@pytest.mark.parametrize(
    "ratios, want",
    [((20.0, 0.0, 5.0), "AMP+N3"), ((0.0, 200.0, 0.0), "citr"), ((0.0, 0.0, 0.0), " "),
     ((20.0, 200.0, 5.0), "AMP+citr+N3"), ((None, 0.0, 5.0), "NA+N3")],
)
def test_component_label(spark, ratios, want):
    df = spark.createDataFrame([ratios], "a double, c double, n double")
    made = text.component_label({"AMP": F.col("a"), "citr": F.col("c"), "N3": F.col("n")})
    assert one(df, made.alias("x")).x == want


@pytest.mark.parametrize(
    "stem, number, code",
    [("Subt2_00006", 6, "00006"), ("O-5", 5, "5"), ("fl_A1", None, "A1"), ("12", 12, "12")],
)
def test_sample_ids(dual, stem, number, code):
    row = one(dual, text.sample_number(F.lit(stem)).alias("n"), text.sample_code(F.lit(stem)).alias("c"))
    assert (row.n, row.c) == (number, code)


def test_bracket_text(dual):
    row = one(
        dual, text.bracket_text(F.lit("Sample (A01) x (B)")).alias("a"),
        text.bracket_text(F.lit("Sample A01")).alias("b"), text.bracket_text(F.lit("()")).alias("c"),
    )
    assert (row.a, row.b, row.c) == ("A01", None, None)


def test_scan_mode(dual):
    row = one(
        dual, text.scan_mode(F.lit("Em 400-700,Ex 365 nm")).alias("a"),
        text.scan_mode(F.lit("Ex 250-400,at 520 nm of 600")).alias("b"),
        text.scan_mode(F.lit("Ex 250-400")).alias("c"),
    )
    assert tuple(row.a) == ("emission", 365.0)
    assert tuple(row.b) == ("excitation", 520.0)
    assert tuple(row.c) == ("excitation", None)


def test_category_of_unknown_level(dual):
    row = one(
        dual, text.category(F.lit("low"), {"low": "3.8"}).alias("a"),
        text.category(F.lit("mid"), {"low": "3.8"}).alias("b"),
        text.category_rank(F.lit("high"), ["low", "high"]).alias("c"),
        text.category_rank(F.lit("mid"), ["low", "high"]).alias("d"),
    )
    assert tuple(row) == ("3.8", None, 2, None)


@pytest.mark.parametrize("df", [1e9, 1e12, 1e13])
def test_tails_of_very_many_degrees(df):
    import math

    from spectrafold.functions.tails import f_tail, t_tail

    for t in (0.1, 1.0, 2.0, 4.0):
        assert t_tail(t, df) == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-6)
    assert f_tail(3.0, 4.0, df) == pytest.approx(math.exp(-6) * 7, rel=1e-6)  # chi-square, 4 degrees


def test_numbers_in_labels(spark):
    from spectrafold.functions.text import number_text

    shown = {
        30.0: "30", 0.5: "0.5", 0.1 + 0.2: "0.3", 1e-5: "1e-05", 1e5: "1e+05", 123456.0: "123456", 0.0: "0",
        0.0001: "1e-04", 0.00012: "0.00012", 1.5e-7: "1.5e-07", -2.0: "-2", 1e15: "1e+15", 1234567.25: "1234567.25",
        1e-120: "1e-120", 100.0: "100", 1 / 3: "0.333333333333333", 2 / 3 * 1e6: "666666.666666667", 22.0: "22",
    }
    df = spark.createDataFrame([(x,) for x in shown], "x double")
    assert {r.x: r.s for r in df.select("x", number_text(F.col("x")).alias("s")).collect()} == shown
    odd = spark.createDataFrame([(float("nan"),), (float("-inf"),), (None,)], "x double")
    assert [r.s for r in odd.select(number_text(F.col("x")).alias("s")).collect()] == ["NaN", "-Inf", None]


def test_number_text_writes_a_number_once(spark):
    from spectrafold.functions.text import number_text

    df = spark.range(3).select((F.col("id") * 0.1).alias("x")).select(number_text(F.col("x")).alias("s"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("%.14e") == 1
    assert [r.s for r in df.collect()] == ["0", "0.1", "0.2"]
