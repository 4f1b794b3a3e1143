"""Design terms, least squares, analysis of variance, scoring, curve fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import entry
from catalog.sql import block, f_tail, least_squares, t_tail, two_way
from spectrafold.operators import design, models
from spectrafold.operators.joins import attach_scalar
from spectrafold.operators.smoothing import local_regression

MAINS = ["a", "b", "c"]
TERMS = design.two_way(MAINS)

least_squares("fit", "runs", "y", two_way(MAINS))
least_squares("fit_by", "runs", "y", MAINS, by="grp")
least_squares("fit_sub", "runs", "y", ["a", "b", "a:b"], where="c = -1")
least_squares("fit_dropped", "(SELECT *, CASE WHEN discount > 0.05 THEN y END AS known FROM runs) r",
              "known", MAINS)


@entry("M1_design_matrix", 'SELECT seq, a, b, c, a * b AS "a:b", b * c AS "b:c" FROM runs', "a b c a:b b:c")
def _(t):
    terms = design.two_way(MAINS, drop=["c:a"])
    return design.design_matrix(t.runs, terms).select("seq", *MAINS, "`a:b`", "`b:c`")


@entry("M2_ols", f"SELECT term, coef, se, t, {t_tail('t', 'df')} AS p FROM fit", "coef se t p")
def _(t):
    return models.ols(t.runs, "y", TERMS)


@entry("M2_ols_by_group", "SELECT grp, term, coef, se, t FROM fit_by", "coef se t")
def _(t):
    return models.ols(t.runs, "y", MAINS, by=["grp"]).drop("p")


@entry("M2_ols_null_rows", "SELECT term, coef, se FROM fit_dropped", "coef se")
def _(t):
    known = F.when(F.col("discount") > 0.05, F.col("y"))
    return models.ols(t.runs.withColumn("known", known), "known", MAINS).drop("t", "p")


@entry("M3_ols_summary", f"""
    SELECT *, {f_tail('f', '6', 'df')} AS p FROM (
      SELECT CAST(n AS BIGINT) AS n, CAST(df AS BIGINT) AS df, 6::BIGINT AS model_df,
        1 - rss / (yy - sy * sy / n) AS r2,
        1 - rss / (yy - sy * sy / n) * (n - 1) / df AS adj_r2, sqrt(rss / df) AS sigma,
        (yy - sy * sy / n - rss) / 6 / (rss / df) AS f
      FROM fit_fit) x""", "r2 adj_r2 sigma f p", 5)
def _(t):
    return models.ols_summary(t.runs, "y", TERMS)


least_squares("fit_two", "runs", "y", ["b", "a:b"], where="c = -1")


@entry("M3_summary_of_no_effect", f"""
    SELECT *, {f_tail('f', '2', 'df')} AS p FROM (
      SELECT CAST(n AS BIGINT) AS n, CAST(df AS BIGINT) AS df, 2::BIGINT AS model_df,
        (yy - sy * sy / n - rss) / 2 / (rss / df) AS f
      FROM fit_two_fit) x""", "f p", 5)
def _(t):
    """A model with hardly any effect: its p is not near 0."""
    rows = models.ols_summary(t.runs.where(F.col("c") == -1), "y", ["b", "a:b"])
    return rows.select("n", "df", "model_df", "f", "p")


@entry("M3_p_values", f"SELECT grp, term, {t_tail('t', 'df')} AS p FROM fit_by", "p")
def _(t):
    return models.ols(t.runs, "y", MAINS, by=["grp"]).select("grp", "term", "p")


@entry("M4_anova_type2", f"""
    SELECT term, ss, df::BIGINT AS df, ss / ms AS f, {t_tail('sqrt(ss / ms)', 'rdf')} AS p FROM fit_ss
    UNION ALL SELECT 'Residuals', rss, CAST(df AS BIGINT), NULL, NULL FROM fit_fit""",
       "ss f p", 5)
def _(t):
    return models.anova_type2(t.runs, "y", TERMS)


@entry("M4_anova_type2_by_group", f"""
    SELECT grp, term, ss, df::BIGINT AS df, ss / ms AS f, {t_tail('sqrt(ss / ms)', 'rdf')} AS p FROM fit_by_ss
    UNION ALL SELECT grp, 'Residuals', rss, CAST(df AS BIGINT), NULL, NULL FROM fit_by_fit""",
       "ss f p", 5)
def _(t):
    return models.anova_type2(t.runs, "y", MAINS, by=["grp"])


@entry("M5_row_subset_fit", "SELECT term, coef, se, t FROM fit_sub", "coef se t")
def _(t):
    rows = t.runs.where(F.col("c") == -1)
    return models.ols(rows, "y", ["a", "b", "a:b"]).drop("p")


def _coefficient(term: str) -> str:
    return f"(SELECT coef FROM fit WHERE term = '{term}')"


_SCORED = ("(Intercept)", "a", "b", "a:c")
block("scored", f"""
    SELECT seq, a, b, c, {_coefficient('(Intercept)')} + {_coefficient('a')} * a
      + {_coefficient('b')} * b + {_coefficient('a:c')} * a * c AS fitted FROM runs""")


@entry("M6_score", "SELECT seq, fitted FROM scored", "fitted")
def _(t):
    coefs = models.ols(t.runs, "y", TERMS)
    return models.score(t.runs, coefs, _SCORED, "fitted").select("seq", "fitted")


block("grid", """
    SELECT -1 + i * 0.05::DOUBLE AS a, -1 + j * 0.05::DOUBLE AS b, -1 + k * 0.05::DOUBLE AS c
    FROM range(0, 41) r(i), range(0, 41) s(j), range(0, 41) u(k)""")
block("grid_scored", f"""
    SELECT a, b, c, {_coefficient('(Intercept)')} + {_coefficient('a')} * a
      + {_coefficient('b')} * b + {_coefficient('a:c')} * a * c AS z FROM grid""")


def _grid(t, levels=None):
    coefs = models.ols(t.runs, "y", TERMS)
    return models.score(design.level_grid(t.spark, MAINS, levels=levels), coefs, _SCORED, "z")


@entry("M7_response_slice", "SELECT a, b, c, z FROM grid_scored WHERE round(c, 6) IN (-1, 0, 1)",
       "a b c z")
def _(t):
    return _grid(t, {"c": [-1.0, 0.0, 1.0]})


@entry("M8_response_bands", """
    SELECT a, b, c, CAST(floor(z / w) - floor(lo / w) + 1 AS BIGINT) AS band
    FROM grid_scored, (SELECT lo, p * CASE WHEN r > 7 THEN 10 WHEN r > 2.8 THEN 5 WHEN r > 1.4 THEN 2
        ELSE 1 END AS w FROM (SELECT lo, p, cell / p AS r FROM (SELECT lo, cell,
          pow(10, floor(log10(cell))) AS p FROM (SELECT min(z) AS lo, (max(z) - min(z)) / 10 AS cell
          FROM grid_scored) x) y) u) v""", "a b c")
def _(t):
    return design.band(_grid(t), "z").select("a", "b", "c", "band")


@entry("M9_origin_slope", "SELECT grp, sum(quantity * y) / sum(quantity * quantity) AS slope,"
       " count(*) AS n FROM runs WHERE quantity < 20 GROUP BY grp", "slope")
def _(t):
    rows = t.runs.where(F.col("quantity") < 20)
    return models.origin_slope(rows, "quantity", "y", ["grp"])


@entry("M10_local_regression", """
    WITH d AS (SELECT r.grp, g.i AS place, g.x0, r.quantity - g.x0 AS u, r.price AS y
      FROM runs r JOIN (SELECT grp, i, lo + (hi - lo) * i / 9 AS x0 FROM (SELECT grp,
          min(quantity) AS lo, max(quantity) AS hi FROM runs GROUP BY grp) x, range(0, 10) p(i)) g
        ON r.grp = g.grp),
    h AS (SELECT grp, place, max(abs(u)) AS h FROM (SELECT *, row_number() OVER (PARTITION BY grp,
        place ORDER BY abs(u)) AS k, count(*) OVER (PARTITION BY grp, place) AS n FROM d) x
      WHERE k <= ceil(0.75 * n) GROUP BY grp, place),
    w AS (SELECT d.grp, d.place, d.x0, d.u / h AS u, y, pow(1 - pow(least(abs(d.u) / h, 1), 3), 3) AS w
      FROM d JOIN h ON d.grp = h.grp AND d.place = h.place),
    s AS (SELECT grp, place, x0, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2,
        sum(w * u * u * u) AS s3, sum(w * u * u * u * u) AS s4, sum(w * y) AS t0,
        sum(w * u * y) AS t1, sum(w * u * u * y) AS t2 FROM w GROUP BY grp, place, x0)
    SELECT grp, CAST(place AS INTEGER) AS place, x0 AS quantity,
      (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2))
      / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)) AS fitted
    FROM s""", "quantity fitted")
def _(t):
    return local_regression(t.runs, "quantity", "price", ["grp"], points=10)


@entry("X18_A13_target_share", "SELECT seq, CASE WHEN y > m THEN y * b ELSE 0 END AS target FROM runs,"
       " (SELECT avg(y) AS m FROM runs) x", "target")
def _(t):
    rows = attach_scalar(t.runs, t.runs.agg(F.avg("y")), "m")
    gate = F.col("y")
    return rows.select(
        "seq", F.when(gate > F.col("m"), gate * F.col("b")).otherwise(F.lit(0.0)).alias("target")
    )
