from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression

from spectrafold.functions.tails import f_tail, t_tail
from spectrafold.operators import models
from spectrafold.operators.design import design_matrix, two_way
from spectrafold.operators.smoothing import local_regression

TERMS = two_way(["a", "b", "c"])


@pytest.fixture(scope="module")
def runs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(90):
        a, b, c = (float(x) for x in rng.integers(-1, 2, 3))
        y = 3 + 2 * a - b + 0.5 * a * c + float(rng.normal(0, 0.3))
        rows.append(("g" if i % 2 else "h", a, b, c, y))
    return spark.createDataFrame(rows, "grp string, a double, b double, c double, y double")


def test_equals_normal_equation_solver(runs):
    wide = design_matrix(runs, TERMS)
    data = VectorAssembler(inputCols=TERMS, outputCol="x").transform(wide)
    fit = LinearRegression(featuresCol="x", labelCol="y", solver="normal").fit(data)
    got = {r.term: r for r in models.ols(runs, "y", TERMS).collect()}
    want = [*fit.coefficients, fit.intercept]
    for i, term in enumerate([*TERMS, models.INTERCEPT]):
        assert got[term].coef == pytest.approx(want[i])
        assert got[term].se == pytest.approx(fit.summary.coefficientStandardErrors[i])
        assert got[term].t == pytest.approx(fit.summary.tValues[i])
        assert got[term].p == pytest.approx(fit.summary.pValues[i], abs=1e-9)
    quality = models.ols_summary(runs, "y", TERMS).collect()[0]
    assert quality.r2 == pytest.approx(fit.summary.r2)
    assert quality.adj_r2 == pytest.approx(fit.summary.r2adj)
    assert quality.df == fit.summary.degreesOfFreedom


def test_groups_are_fitted_apart(runs):
    together = {(r.grp, r.term): r.coef for r in models.ols(runs, "y", ["a"], ["grp"]).collect()}
    for grp in "gh":
        for r in models.ols(runs.where(f"grp = '{grp}'"), "y", ["a"]).collect():
            assert together[grp, r.term] == pytest.approx(r.coef)


def test_aliased_term_is_null(runs):
    df = runs.withColumn("twice", 2 * runs.a)
    got = {r.term: r for r in models.ols(df, "y", ["a", "twice", "b"]).collect()}
    assert got["twice"].coef is None and got["twice"].p is None
    plain = {r.term: r.coef for r in models.ols(df, "y", ["a", "b"]).collect()}
    assert got["a"].coef == pytest.approx(plain["a"])
    anova = {r.term: r for r in models.anova_type2(df, "y", ["a", "twice", "b"]).collect()}
    assert anova["a"].df == 0 or anova["a"].ss is not None


def test_rows_with_null_drop_out(runs, spark):
    extra = spark.createDataFrame([("g", None, 1.0, 1.0, 9.0), ("g", 1.0, 1.0, 1.0, None)], runs.schema)
    want = {r.term: r.coef for r in models.ols(runs, "y", TERMS).collect()}
    got = {r.term: r.coef for r in models.ols(runs.union(extra), "y", TERMS).collect()}
    assert got == pytest.approx(want)


def test_no_rows(runs):
    rows = models.ols(runs.where("a > 5"), "y", ["a"]).collect()
    assert {r.coef for r in rows} == {None}
    assert models.ols_summary(runs.where("a > 5"), "y", ["a"]).collect() == []


def test_type_two_of_an_orthogonal_design_adds_up(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), float(rng.normal() + a)) for a in (-1, 1) for b in (-1, 1) for _ in range(5)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    ss = {r.term: r.ss for r in models.anova_type2(df, "y", ["a", "b", "a:b"]).collect()}
    y = np.array([r[2] for r in rows])
    assert sum(ss.values()) == pytest.approx(float(((y - y.mean()) ** 2).sum()))


def test_type_two_respects_marginality(runs):
    """A main effect is tested without the products that contain it."""
    frame = runs.toPandas()

    def rss(terms):
        x = np.column_stack([np.ones(len(frame))] + [
            np.prod([frame[f] for f in t.split(":")], axis=0) for t in terms
        ])
        left = frame.y - x @ np.linalg.lstsq(x, frame.y, rcond=None)[0]
        return float(left @ left)

    got = {r.term: r for r in models.anova_type2(runs, "y", TERMS).collect()}
    ss = rss(["b", "c", "b:c"]) - rss(["a", "b", "c", "b:c"])
    assert got["a"].ss == pytest.approx(ss)
    f = ss / (rss(TERMS) / (len(frame) - len(TERMS) - 1))
    assert got["a"].f == pytest.approx(f)
    assert got["a:b"].ss == pytest.approx(rss([t for t in TERMS if t != "a:b"]) - rss(TERMS))


def test_tails_against_the_jvm_library(spark):
    jvm = spark._jvm.org.apache.commons.math3.distribution
    for f, d1, d2 in [(4.35, 1, 20), (0.2, 3, 7), (60.0, 2, 500), (1e-6, 1, 1), (2.5, 15, 59984)]:
        want = 1 - jvm.FDistribution(float(d1), float(d2)).cumulativeProbability(f)
        assert f_tail(f, d1, d2) == pytest.approx(want, abs=1e-9)
    want = 2 * jvm.TDistribution(12.0).cumulativeProbability(-2.2)
    assert t_tail(2.2, 12) == pytest.approx(want, abs=1e-10)


def test_score_with_a_subset_and_an_unknown_term(runs):
    coefs = models.ols(runs, "y", TERMS)
    known = {r.term: r.coef for r in coefs.collect()}
    row = models.score(runs, coefs, [models.INTERCEPT, "a", "a:c"], "fit").first()
    want = known[models.INTERCEPT] + known["a"] * row.a + known["a:c"] * row.a * row.c
    assert row.fit == pytest.approx(want)
    with pytest.raises(Exception, match="not in the model"):
        models.score(
            runs.withColumn("z", runs.a), coefs, ["a:z"], "fit"
        ).collect()


def test_origin_slope(spark):
    df = spark.createDataFrame([("k", 0.0, 9.0), ("k", 1.0, 2.0), ("k", 2.0, 5.0), ("k", 3.0, None),
                                ("z", 0.0, 1.0)], "k string, x double, y double")
    got = {r.k: (r.slope, r.n) for r in models.origin_slope(df, "x", "y", ["k"]).collect()}
    assert got == {"k": (12 / 5, 3), "z": (None, 1)}


def test_local_regression_reproduces_a_parabola(spark):
    rows = [("k", i / 10, 1 + 2 * (i / 10) - (i / 10) ** 2) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = local_regression(df, "x", "y", ["k"], points=13).collect()
    assert len(got) == 13
    for r in got:
        assert r.fitted == pytest.approx(1 + 2 * r.x - r.x**2)


def test_large_offset_changes_nothing(spark):
    """A response and a term far from 0 keep their digits."""
    import random

    from spectrafold.operators.models import anova_type2, ols, ols_summary

    rng = random.Random(3)
    rows = [(float(k % 7), rng.random()) for k in range(2000)]
    near = spark.createDataFrame([(a, a + e) for a, e in rows], "a double, y double")
    far = spark.createDataFrame([(a, 1e8 + a + e) for a, e in rows], "a double, y double")
    moved = spark.createDataFrame([(1e6 + a, a + e) for a, e in rows], "a double, y double")
    want = ols_summary(near, "y", ["a"]).first()
    for other in (far, moved):
        got = ols_summary(other, "y", ["a"]).first()
        assert got.sigma == pytest.approx(want.sigma, rel=1e-6) and got.r2 == pytest.approx(want.r2, rel=1e-6)
        slope = [r.coef for r in ols(other, "y", ["a"]).collect() if r.term == "a"][0]
        assert slope == pytest.approx([r.coef for r in ols(near, "y", ["a"]).collect() if r.term == "a"][0], rel=1e-6)
    assert anova_type2(far, "y", ["a"]).first().ss == pytest.approx(anova_type2(near, "y", ["a"]).first().ss, rel=1e-6)


def _local_fit(xs, ys, span, points):
    """Brute force: weighted least squares at every place; None where it is not determined."""
    found = []
    for at in np.linspace(xs.min(), xs.max(), points):
        far = np.abs(xs - at)
        h = np.sort(far)[int(np.ceil(span * len(xs))) - 1]
        w = (1 - np.minimum(far / h, 1) ** 3) ** 3
        u = (xs - at) / h
        design = np.vander(u, 3, increasing=True) * np.sqrt(w)[:, None]
        known = np.linalg.det(design.T @ design) > 1e-9 * w.sum() ** 3
        found.append(np.linalg.lstsq(design, ys * np.sqrt(w), rcond=None)[0][0] if known else None)
    return found


@pytest.mark.parametrize("every", [20, 5000])  # cut groups, whole groups
def test_local_regression_equals_direct_fits(spark, every):
    rng = np.random.default_rng(11)
    even = rng.random(700)
    crowded = np.concatenate([rng.normal(5, 1e-3, 400).round(5), rng.random(200) * 100, [1e4]])
    data = {"even": even, None: crowded}
    rows, truth = [], {}
    for key, xs in data.items():
        ys = np.sin(xs * 3) + rng.normal(0, 0.1, len(xs)) + 50
        rows += [(key, float(a), float(b)) for a, b in zip(xs, ys)]
        truth[key] = _local_fit(xs, ys, 0.4, 15)
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = local_regression(df, "x", "y", ["k"], span=0.4, points=15, every=every).collect()
    assert len(got) == 30
    for r in got:
        # Some places of the crowded group lie far from all rows and extrapolate.
        want = truth[r.k][r.place]
        assert r.fitted == (want if want is None else pytest.approx(want, rel=1e-7 if r.k else 1e-5))


def test_local_regression_without_rows_or_width(spark):
    empty = spark.createDataFrame([], "k string, x double, y double")
    assert local_regression(empty, "x", "y", ["k"], points=5).count() == 0
    flat = spark.createDataFrame([("k", 1.0, 2.0)] * 4 + [("k", None, 1.0)], "k string, x double, y double")
    got = local_regression(flat, "x", "y", ["k"], points=5).collect()
    assert [r.fitted for r in got] == [None] * 5 and {r.x for r in got} == {1.0}
