"""The analyses and the rows behind their figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import entry
from catalog.sql import block, f_tail, least_squares, number_text, t_tail
from catalog.views import AB_ORDER, FL_ORDER
from spectrafold.operators.models import INTERCEPT, anova_type2, ols, ols_summary
from spectrafold.plans import figures, mixing, quenching, spectra, yields
from spectrafold.session import settle


def fl(t, keep=None, sheet=None):
    return spectra.fluorescence(t.fl, FL_ORDER, sheet, keep)


def ab(t, keep=None, sheet=None):
    return spectra.absorbance(t.ab, AB_ORDER, sheet, keep)


def fu(t, keep=None):
    return spectra.fluorescence(t.fu, FL_ORDER, t.factorial, keep)


def au(t, keep=None):
    """Factorial absorbance: saturated points stay, as only the pooled series drops them."""
    return spectra.absorbance(t.au, AB_ORDER, t.factorial, keep, saturation=False)


def au_pooled(t, keep=None, start=None):
    return spectra.absorbance(t.au, AB_ORDER, t.factorial, keep, start=start)


# --- yields and designs ---------------------------------------------------------------------------


@entry("C3_ratio_yields", "SELECT file, n3_au, type, integral, ref_integral, qy FROM yield_ratio",
       "n3_au integral ref_integral qy", 4)
def _(t):
    return yields.ratio_yields(fl(t), ab(t), t.ratio)


_DESIGN = ("file, label, Au_level, AMP_level, N3_level, Citr_level, NaH_level, integral,"
           " ref_integral, qy, qy_percent, rel_scatter, int_365, int_490, int_600, int_600_490")


def factorial_design(t):
    keep = spectra.sample_is("au", "ref")
    return yields.factorial_design(fu(t, keep), au(t, keep), t.factorial)


@entry("C4_factorial_yields", "SELECT file, label, integral, ref_integral, qy, rel_scatter FROM"
       " design_factorial", "integral ref_integral qy rel_scatter", 5)
def _(t):
    return factorial_design(t).select(
        "file", "label", "integral", "ref_integral", "qy", "rel_scatter"
    )


@entry("C5_factorial_design", f"SELECT {_DESIGN} FROM design_factorial",
       "integral ref_integral qy qy_percent rel_scatter int_365 int_490 int_600 int_600_490", 5)
def _(t):
    return factorial_design(t)


def pooled(t, kind):
    keep = spectra.sample_is(kind, "ref")
    return fu(t, keep), au_pooled(t, keep, start=220), t.factorial, kind


@entry("C6_pooled_yields", "SELECT file, label, integral, ref_integral, qy FROM yield_au2",
       "integral ref_integral qy", 5)
def _(t):
    rows = yields.pooled_yields(*pooled(t, "au2"))
    return rows.select("file", "label", "integral", "ref_integral", "qy")


@entry("C7_optimisation_design", "SELECT * FROM design_au3", "AMP_level Citr_level NaH_level"
       " N3_level qy int_365 int_490 int_600 int_600_490 target")
def _(t):
    return yields.optimisation_design(*pooled(t, "au3"))


# --- models of the designs, the response and its optimum --------------------------------------------

block("bright", "SELECT * FROM design_factorial WHERE qy > 0.01")
block("no_azide", 'SELECT * FROM design_factorial WHERE N3_level = -1')
block("yellow", "SELECT *, 100 * target AS target_percent FROM design_au3")
for name, (source, response, terms) in {
    "m_qy": ("design_factorial", "qy_percent", yields.FULL),
    "m_qy_reduced": ("design_factorial", "qy_percent", ["N3_level", "NaH_level"]),
    "m_qy_no_azide": ("no_azide", "qy_percent",
                      ["Au_level", "AMP_level", "Citr_level", "NaH_level"]),
    "m_target": ("bright", "int_600_490", yields.FULL),
    "m_target_reduced": ("bright", "int_600_490", yields.REDUCED_TARGET),
    "m_yellow_target": ("yellow", "target_percent", yields.YELLOW_FULL),
    "m_yellow_target_reduced": ("yellow", "target_percent", yields.YELLOW_TARGET),
    "m_yellow_qy": ("yellow", "qy", yields.YELLOW_FULL),
    "m_yellow_qy_reduced": ("yellow", "qy", ["AMP_level", "NaH_level"]),
}.items():
    least_squares(name, source, response, terms)

_FACTORIAL = ["qy", "qy_reduced", "qy_no_azide", "target", "target_reduced"]
_YELLOW = ["target", "target_reduced", "qy", "qy_reduced"]


def _all(names, prefix, columns, suffix=""):
    return " UNION ALL ".join(
        f"SELECT '{n}' AS model, {columns} FROM {prefix}{n}{suffix}" for n in names
    )


def _models(t, design, models, report):
    frames = []
    for name, (response, terms, keep) in models.items():
        rows = design if keep is None else design.where(keep)
        frames.append(report(rows, response, terms).withColumn("model", F.lit(name)))
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def yellow_design(t):
    design = yields.optimisation_design(*pooled(t, "au3"))
    return settle(design.withColumn("target_percent", 100 * F.col("target")), "yellow")


_COEFFICIENTS = f"term, coef, se, t, {t_tail('t', 'df')} AS p"


@entry("C8_factorial_models", _all(_FACTORIAL, "m_", _COEFFICIENTS), "coef se t p", 4)
def _(t):
    design = settle(factorial_design(t), "design")
    return _models(t, design, yields.factorial_models(), ols)


# A term has one degree of freedom, so its F is the square of a t.
_ANOVA = f"term, ss, CAST(df AS BIGINT) AS df, ss / ms AS f, {t_tail('sqrt(ss / ms)', 'rdf')} AS p"
_RESIDUAL = ("'Residuals' AS term, rss AS ss, CAST(df AS BIGINT) AS df, NULL::DOUBLE AS f,"
             " NULL::DOUBLE AS p")
_F = "((yy - sy * sy / n - rss) / (n - df - 1) / (rss / df))"
_SUMMARY = ("CAST(n AS BIGINT) AS n, CAST(df AS BIGINT) AS df, CAST(n - df - 1 AS BIGINT) AS model_df,"
            " 1 - rss / (yy - sy * sy / n) AS r2,"
            " 1 - rss / (yy - sy * sy / n) * (n - 1) / df AS adj_r2, sqrt(rss / df) AS sigma,"
            f" {_F} AS f, {f_tail(_F, '(n - df - 1)', 'df')} AS p")


@entry("C8_factorial_anova", _all(_FACTORIAL, "m_", _ANOVA, "_ss") + " UNION ALL "
       + _all(_FACTORIAL, "m_", _RESIDUAL, "_fit"), "ss f p", 4)
def _(t):
    design = settle(factorial_design(t), "design")
    return _models(t, design, yields.factorial_models(), anova_type2)


@entry("C8_factorial_summaries", _all(_FACTORIAL, "m_", _SUMMARY, "_fit"), "r2 adj_r2 sigma f p", 4)
def _(t):
    design = settle(factorial_design(t), "design")
    return _models(t, design, yields.factorial_models(), ols_summary)


@entry("C8_yellow_summaries", _all(_YELLOW, "m_yellow_", _SUMMARY, "_fit"), "r2 adj_r2 sigma f p", 4)
def _(t):
    return _models(t, yellow_design(t), yields.yellow_models(), ols_summary)


@entry("C8_yellow_models", _all(_YELLOW, "m_yellow_", _COEFFICIENTS), "coef se t p", 4)
def _(t):
    return _models(t, yellow_design(t), yields.yellow_models(), ols)


@entry("C8_yellow_anova", _all(_YELLOW, "m_yellow_", _ANOVA, "_ss") + " UNION ALL "
       + _all(_YELLOW, "m_yellow_", _RESIDUAL, "_fit"), "ss f p", 4)
def _(t):
    return _models(t, yellow_design(t), yields.yellow_models(), anova_type2)


def _polynomial(model: str, terms: list[str]) -> str:
    parts = []
    for term in terms:
        coef = f"max(CASE WHEN term = '{term}' THEN coef END)"
        parts.append((f"(SELECT {coef} FROM {model})", term))
    return " + ".join(
        c if term == INTERCEPT else f"{c} * {' * '.join(term.split(':'))}" for c, term in parts
    )


def _levels(*names: str) -> str:
    columns = ", ".join(f"-1 + i{j} * 0.05::DOUBLE AS {n}" for j, n in enumerate(names))
    return f"SELECT {columns} FROM " + ", ".join(
        f"range(0, 41) r{j}(i{j})" for j in range(len(names))
    )


# The predictions do not depend on every factor; the checks use the slices the plans keep.
block("slice_au", "SELECT * FROM (" + _levels("AMP_level", "N3_level", "Citr_level", "NaH_level")
      + ") g, (SELECT 1.0::DOUBLE AS Au_level) a")
block("slice_panel", "SELECT * FROM (" + _levels("Au_level", "AMP_level", "N3_level") + ") g,"
      " (VALUES (-1.0::DOUBLE), (0.0), (1.0)) c(Citr_level),"
      " (VALUES (-1.0::DOUBLE), (0.0), (1.0)) n(NaH_level)")
for name in ("slice_au", "slice_panel"):
    block(f"{name}_fit", f"""
        SELECT *, CASE WHEN qy > 2 THEN qy * yellow WHEN qy IS NOT NULL THEN 0 END AS target FROM
          (SELECT *, {_polynomial('m_target', yields.TARGET_TERMS)} AS yellow,
             {_polynomial('m_qy', yields.YIELD_TERMS)} AS qy FROM {name}) x""")


def _summary(source: str, by: str, k: int) -> str:
    best = (f"(SELECT * FROM {source} WHERE {by} IS NOT NULL ORDER BY round({by}, 9) DESC,"
            f" AMP_level, N3_level, Citr_level, NaH_level LIMIT {k}) b")
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", min({c}) AS min, quantile_cont({c}, 0.25) AS q1,"
        f" median({c}) AS median, avg({c}) AS mean, quantile_cont({c}, 0.75) AS q3,"
        f" max({c}) AS max FROM {best}" for c in [*yields.FACTORS, "yellow", "qy", "target"]
    )


def _response(t):
    design = settle(factorial_design(t), "design")
    grid = yields.response_grid(t.spark, design, levels={"Au_level": [1.0]})
    # Rounded as in the check, so that points with equal predictions tie in both engines.
    return grid.withColumns({c: F.round(c, 9) for c in ("yellow", "qy", "target")})


@entry("C8_optimum_by_yield", _summary("slice_au_fit", "qy", 100), "min q1 median mean q3 max", 5)
def _(t):
    return yields.optimum(_response(t), "qy", 100)


@entry("C8_optimum_by_target", _summary("slice_au_fit", "target", 20), "min q1 median mean q3 max",
       5)
def _(t):
    return yields.optimum(_response(t), "target", 20)


# Averaged over levels that are symmetric about 0, the terms of the other factors vanish.
_AVERAGED = [INTERCEPT, "N3_level", "NaH_level", "N3_level:NaH_level"]


@entry("C8_grid_profile", f"SELECT N3_level, NaH_level, 41 * 41 * 41::BIGINT AS n,"
       f" {_polynomial('m_qy', yields.YIELD_TERMS)} AS qy,"
       f" {_polynomial('m_target', _AVERAGED)} AS yellow"
       f" FROM ({_levels('N3_level', 'NaH_level')}) g", "N3_level NaH_level qy yellow")
def _(t):
    """Mean prediction per azide and sodium level over the whole five-factor grid."""
    grid = yields.response_grid(t.spark, settle(factorial_design(t), "design"))
    return grid.groupBy("N3_level", "NaH_level").agg(
        F.count(F.lit(1)).alias("n"), F.avg("qy").alias("qy"), F.avg("yellow").alias("yellow")
    )


# --- mixing order, controls, series -------------------------------------------------------------------


@entry("C9_mixing_order", "SELECT label, wavelength, intensity, absorbance, normalized, au_last,"
       " water_last, ligands_first FROM mix_emission", "wavelength intensity absorbance normalized")
def _(t):
    return mixing.mixture_emission(fl(t), ab(t), t.mixing)


_CONTROL_LABEL = """coalesce(nullif(concat_ws('+',
    CASE WHEN AMP_ratio IS NULL THEN 'NA' WHEN AMP_ratio <> 0 THEN 'AMP' END,
    CASE WHEN Citr_ratio IS NULL THEN 'NA' WHEN Citr_ratio <> 0 THEN 'citr' END,
    CASE WHEN N3_ratio IS NULL THEN 'NA' WHEN N3_ratio <> 0 THEN 'N<sub>3</sub>' END), ''), ' ')"""
block("controls", f"SELECT file, type, {_CONTROL_LABEL} AS label FROM factorial WHERE"
      " type = 'control'")


@entry("C10_control_labels", "SELECT x.file, x.seq, x.wavelength, x.intensity, c.label FROM fux x"
       " JOIN controls c ON x.file = c.file", "wavelength intensity")
def _(t):
    rows = mixing.control_spectra(fu(t, spectra.sample_is("control")), t.factorial)
    return rows.select("file", "seq", "wavelength", "intensity", "label")


def fp(t):
    return spectra.fluorescence(t.fp, FL_ORDER)


def ap(t):
    return spectra.absorbance(t.ap, AB_ORDER)


@entry("C11_dilution_curve", "SELECT file, conc_rel, sample, integral FROM dilution",
       "conc_rel integral", 4)
def _(t):
    return quenching.dilution_curve(fp(t), t.ph)


@entry("C12_ph_series", "SELECT x.file, x.seq, x.wavelength, x.intensity, s.sample, s.pH,"
       " CASE WHEN a.absorbance > 0.01 THEN a.absorbance END AS absorbance FROM fpx x"
       " JOIN ph s ON x.file = s.file LEFT JOIN apx365 a ON x.file = a.file WHERE s.pH IS NOT NULL",
       "wavelength intensity pH absorbance")
def _(t):
    rows = quenching.ph_series(fp(t), ap(t), t.ph)
    return rows.select("file", "seq", "wavelength", "intensity", "sample", "pH", "absorbance")


def all_fu(t):
    return spectra.fluorescence(t.fu, FL_ORDER)


@entry("C13_quenched_spectra", "SELECT * FROM quenched", "wavelength c_Hg intensity")
def _(t):
    return quenching.quenched_spectra(all_fu(t), t.dose)


@entry("C14_dose_response", "SELECT * FROM dose_resp", "c_Hg@12 sd integral ref rel_integral rel_sd", 5)
def _(t):
    return quenching.dose_response(all_fu(t), t.dose)


@entry("C14_stern_volmer", "SELECT sample, pH, sum(c_Hg * v) / nullif(sum(c_Hg * c_Hg), 0) AS slope,"
       " count(*) AS n FROM (SELECT *, 1 / nullif(rel_integral, 0) - 1 AS v FROM dose_resp"
       " WHERE c_Hg < 4e-5) x WHERE v IS NOT NULL AND c_Hg IS NOT NULL GROUP BY sample, pH",
       "slope", 3)
def _(t):
    return quenching.stern_volmer(quenching.dose_response(all_fu(t), t.dose))


@entry("C15_selectivity", "SELECT *, rel_integral NOT BETWEEN 0.97 AND 1.03 AS responds FROM ion_resp",
       "sd integral ref rel_integral rel_sd", 5)
def _(t):
    return quenching.selectivity(all_fu(t), t.ions)


# --- figures ------------------------------------------------------------------------------------------


@entry("F1a_ratio_emission", "SELECT x.file, x.seq, x.wavelength, x.intensity, s.n3_au FROM flx x"
       " JOIN ratio s ON x.file = s.file WHERE s.type <> 'ref' AND x.wavelength BETWEEN 400 AND 800",
       "wavelength intensity")
def _(t):
    rows = figures.ratio_emission(fl(t), t.ratio)
    return rows.select("file", "seq", "wavelength", "intensity", "n3_au")


@entry("F1c_ratio_absorbance", "SELECT x.file, x.o1, x.o2, x.o3, x.wavelength, x.absorbance,"
       " s.n3_au FROM abx x JOIN ratio s ON x.file = s.file WHERE s.type <> 'ref' AND"
       " x.wavelength BETWEEN 280 AND 500 AND x.absorbance BETWEEN 0 AND 1.25",
       "wavelength absorbance")
def _(t):
    rows = figures.ratio_absorbance(ab(t), t.ratio)
    return rows.select("file", "o1", "o2", "o3", "wavelength", "absorbance", "n3_au")


@entry("F1d_ratio_yields", "SELECT n3_au, qy * 100 AS qy_percent FROM yield_ratio", "qy_percent", 4)
def _(t):
    return figures.yield_bars(yields.ratio_yields(fl(t), ab(t), t.ratio), "n3_au")


@entry("F2a_control_absorbance", "SELECT x.file, x.o1, x.o2, x.o3, x.wavelength, x.absorbance,"
       " c.label FROM (SELECT * FROM auc WHERE wavelength <= 900 AND (wavelength <= 650 OR"
       " wavelength >= 665)) x JOIN controls c ON x.file = c.file WHERE x.wavelength BETWEEN 280"
       " AND 500 AND x.absorbance BETWEEN 0 AND 2.5", "wavelength absorbance")
def _(t):
    keep = spectra.sample_is("control")
    rows = spectra.absorbance(t.au, AB_ORDER, t.factorial, keep, saturation=False)
    rows = figures.control_absorbance(rows, t.factorial)
    return rows.select("file", "o1", "o2", "o3", "wavelength", "absorbance", "label")


@entry("F2b_control_emission", "SELECT x.file, x.seq, x.wavelength, x.intensity, c.label FROM fux x"
       " JOIN controls c ON x.file = c.file WHERE x.wavelength BETWEEN 400 AND 800",
       "wavelength intensity")
def _(t):
    rows = figures.control_emission(fu(t, spectra.sample_is("control")), t.factorial)
    return rows.select("file", "seq", "wavelength", "intensity", "label")


@entry("F3_mixing_absorbance", """
    SELECT m.label, m.wavelength, m.absorbance, k.layer FROM mix_ab m JOIN
      (VALUES ('ligands first'), ('ligands first, water last'), ('other')) k(layer)
      ON (k.layer = 'ligands first' AND m.ligands_first)
        OR (k.layer = 'ligands first, water last' AND m.ligands_first AND m.water_last)
        OR (k.layer = 'other' AND NOT m.ligands_first)
    WHERE m.wavelength BETWEEN 282 AND 500 AND m.absorbance BETWEEN 0 AND 1.5""",
       "wavelength absorbance")
def _(t):
    rows = mixing.absorbance_layers(ab(t), t.mixing)
    return rows.select("label", "wavelength", "absorbance", "layer")


@entry("F4_mixing_emission", """
    SELECT m.label, m.wavelength, m.normalized, k.layer FROM mix_emission m JOIN
      (VALUES ('gold last'), ('water last'), ('other')) k(layer)
      ON (k.layer = 'gold last' AND m.au_last) OR (k.layer = 'water last' AND m.water_last)
        OR (k.layer = 'other' AND NOT m.ligands_first)
    WHERE m.wavelength BETWEEN 400 AND 900 AND m.normalized BETWEEN 0 AND 36000""",
       "wavelength normalized")
def _(t):
    rows = mixing.emission_layers(fl(t), ab(t), t.mixing)
    return rows.select("label", "wavelength", "normalized", "layer")


_SCALED = """
    SELECT x.file, x.seq, x.wavelength, x.intensity / nullif(a.absorbance, 0) AS intensity, {}
    FROM fux x JOIN factorial s ON x.file = s.file LEFT JOIN aux365 a ON x.file = a.file
    WHERE s.type = 'au' AND x.wavelength >= 400"""


@entry("F5_factorial_overview", _SCALED.format("s.N3_level > -1 AS azide"), "wavelength intensity")
def _(t):
    keep = spectra.sample_is("au")
    rows = figures.factorial_overview(fu(t, keep), au(t, keep), t.factorial)
    return rows.select("file", "seq", "wavelength", "intensity", "azide")


@entry("F6_without_azide", _SCALED.format(
    f"s.AMP_level, concat('<i>r</i><sub>Na/H</sub> = ', {number_text('s.NaH_level')}) AS panel"
) + " AND s.N3_level = -1", "wavelength intensity")
def _(t):
    keep = spectra.sample_is("au") & (F.col("N3_level") == -1)
    rows = figures.without_azide(fu(t, keep), au(t, keep), t.factorial)
    return rows.select("file", "seq", "wavelength", "intensity", "AMP_level", "panel")


def _banded(z: str, source: str) -> str:
    return f"""
    SELECT *, CAST(floor({z} / w) - floor(lo / w) + 1 AS BIGINT) AS band FROM {source}, (SELECT lo,
      p * CASE WHEN r > 7 THEN 10 WHEN r > 2.8 THEN 5 WHEN r > 1.4 THEN 2 ELSE 1 END AS w
      FROM (SELECT lo, p, cell / p AS r FROM (SELECT lo, cell, pow(10, floor(log10(cell))) AS p
        FROM (SELECT min({z}) AS lo, (max({z}) - min({z})) / 10 AS cell FROM {source}) x) y) u) v"""


def _panels(z: str) -> str:
    return (
        f"SELECT Au_level, AMP_level, N3_level, {z} AS z, band,"
        f" concat('<i>r</i><sub>citr</sub> = ', {number_text('Citr_level')}) AS \"row\","
        f" concat('<i>r</i><sub>Na/H</sub> = ', {number_text('NaH_level')}) AS panel"
        f" FROM ({_banded(z, 'slice_panel_fit')}) b"
    )


for number, z in (("F7_yield_response", "qy"), ("F8_ratio_response", "yellow"),
                  ("F9_target_response", "target")):

    @entry(number, _panels(z), "Au_level AMP_level N3_level z", 5)
    def _(t, z=z):
        design = settle(factorial_design(t), "design")
        levels = {"Citr_level": figures.PANEL_LEVELS, "NaH_level": figures.PANEL_LEVELS}
        return figures.response_panels(yields.response_grid(t.spark, design, levels=levels), z)


@entry("F10_pooled_yields", "SELECT NaH_ratio, AMP_ratio, Citr_ratio, qy * 100 AS qy_percent FROM"
       " yield_au2", "qy_percent", 4)
def _(t):
    rows = yields.pooled_yields(*pooled(t, "au2"))
    return figures.yield_bars(rows, "NaH_ratio", "AMP_ratio", "Citr_ratio")


block("yellow_grid", "SELECT *, " + _polynomial("m_yellow_target_reduced",
                                                [INTERCEPT, *yields.YELLOW_TARGET])
      + " AS target FROM (" + _levels("AMP_level", "NaH_level")
      + ") g, (VALUES (-1.0::DOUBLE), (0.0), (1.0)) c(Citr_level)")


@entry("F11_yellow_response", "SELECT AMP_level, NaH_level, target AS z, band,"
       f" concat('<i>r</i><sub>citr</sub> = ', {number_text('Citr_level')}) AS panel"
       f" FROM ({_banded('target', 'yellow_grid')}) b", "AMP_level NaH_level z", 5)
def _(t):
    design = settle(yields.optimisation_design(*pooled(t, "au3")), "yellow")
    return figures.yellow_panels(yields.yellow_grid(t.spark, design))


@entry("F12_diluted_emission", "SELECT x.file, x.seq, x.wavelength, x.intensity, s.sample,"
       " round_even(s.V_sample / s.V_total, 2) AS conc_rel FROM fpx x JOIN ph s ON x.file = s.file"
       " WHERE s.pH IS NULL AND round_even(s.V_sample / s.V_total, 2) > 0.1 AND x.wavelength BETWEEN"
       " 400 AND 850", "wavelength intensity conc_rel")
def _(t):
    rows = figures.diluted_emission(fp(t), t.ph)
    return rows.select("file", "seq", "wavelength", "intensity", "sample", "conc_rel")


@entry("F13_dilution_fit", """
    WITH d AS (SELECT r.sample, g.i AS place, g.x0, r.conc_rel - g.x0 AS u, r.integral AS y
      FROM dilution r JOIN (SELECT sample, i, lo + (hi - lo) * i / 79 AS x0 FROM (SELECT sample,
          min(conc_rel) AS lo, max(conc_rel) AS hi FROM dilution GROUP BY sample) x,
          range(0, 80) p(i)) g ON r.sample = g.sample),
    h AS (SELECT sample, place, max(abs(u)) AS h FROM (SELECT *, row_number() OVER (PARTITION BY
        sample, place ORDER BY abs(u)) AS k, count(*) OVER (PARTITION BY sample, place) AS n
        FROM d) x WHERE k <= ceil(0.75 * n) GROUP BY sample, place),
    w AS (SELECT d.sample, d.place, d.x0, d.u / h AS u, y,
        pow(1 - pow(least(abs(d.u) / h, 1), 3), 3) AS w
      FROM d JOIN h ON d.sample = h.sample AND d.place = h.place),
    s AS (SELECT sample, place, x0, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2,
        sum(w * u * u * u) AS s3, sum(w * u * u * u * u) AS s4, sum(w * y) AS t0,
        sum(w * u * y) AS t1, sum(w * u * u * y) AS t2 FROM w GROUP BY sample, place, x0)
    SELECT sample, CAST(place AS INTEGER) AS place, x0 AS conc_rel,
      CASE WHEN s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
        > 1e-9 * s0 * s0 * s0 THEN
      (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2))
      / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2))
      END AS fitted
    FROM s""", "conc_rel fitted", 4)
def _(t):
    return quenching.dilution_fit(fp(t), t.ph)


@entry("F14_ph_emission", "SELECT x.file, x.seq, x.wavelength, x.intensity, s.sample, s.pH FROM fpx x"
       " JOIN ph s ON x.file = s.file WHERE s.pH IS NOT NULL AND x.wavelength BETWEEN 400 AND 850",
       "wavelength intensity pH")
def _(t):
    rows = figures.ph_emission(quenching.ph_series(fp(t), ap(t), t.ph))
    return rows.select("file", "seq", "wavelength", "intensity", "sample", "pH")


@entry("F15_dose_points", "SELECT c_Hg, log10(nullif(c_Hg, 0)) AS log_c, sample, pH, rel_integral"
       " FROM dose_resp WHERE c_Hg <> 0", "c_Hg@12 log_c rel_integral")
def _(t):
    rows = figures.dose_points(quenching.dose_response(all_fu(t), t.dose))
    return rows.select("c_Hg", "log_c", "sample", "pH", "rel_integral")


@entry("F16_quenching_points", "SELECT c_Hg, sample, pH, 1 / nullif(rel_integral, 0) - 1 AS quenching"
       " FROM dose_resp WHERE c_Hg < 1e-4", "c_Hg@12 quenching")
def _(t):
    rows = figures.quenching_points(quenching.dose_response(all_fu(t), t.dose))
    return rows.select("c_Hg", "sample", "pH", "quenching")


@entry("F17_normalised_emission", "SELECT * FROM quenched WHERE wavelength BETWEEN 400 AND 850 AND"
       " intensity BETWEEN 0 AND 1", "wavelength c_Hg intensity")
def _(t):
    return figures.normalised_emission(all_fu(t), t.dose)


@entry("F18_ion_bars", "SELECT sample, ion, rel_integral, rel_sd, rel_integral NOT BETWEEN 0.97 AND"
       " 1.03 AS responds FROM ion_resp WHERE ion <> 'ref'", "rel_integral rel_sd", 5)
def _(t):
    rows = figures.ion_bars(quenching.selectivity(all_fu(t), t.ions))
    return rows.select("sample", "ion", "rel_integral", "rel_sd", "responds")
