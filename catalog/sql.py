"""Named SQL blocks the checks are put together from."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from itertools import combinations

from catalog.views import AB_ORDER, FL_ORDER, VIEWS, view_sql

_BLOCKS: dict[str, str] = {name: view_sql(name) for name in VIEWS}


def block(name: str, text: str) -> None:
    """Add ``name`` to the blocks; ``text`` may refer to blocks and tables."""
    _BLOCKS[name] = text


def with_blocks(select: str) -> str:
    """``select`` preceded by every block it refers to, directly or not."""
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"(?:FROM|JOIN|,)\s+([a-z]\w*)\b", text)):
            if word in _BLOCKS and word not in seen:
                seen.add(word)
                visit(_BLOCKS[word])
                order.append(word)

    visit(select)
    if not order:
        return select
    recursive = "RECURSIVE " if any(name.endswith("_solved") for name in order) else ""
    blocks = ",\n".join(f"{name} AS ({_BLOCKS[name]})" for name in order)
    return f"WITH {recursive}{blocks}\n{select}"


# No short decimal, so that no value of the tables lies exactly this far from a tie.
NUDGE = "1.23456789012"


def rounded(select: str, digits: Mapping[str, int]) -> str:
    """The nudge keeps exact ties from falling to either side in the two engines."""
    if not digits:
        return select
    nudged = ", ".join(f'round("{c}" + {NUDGE}e-{d + 2}, {d}) AS "{c}"' for c, d in digits.items())
    return f"SELECT * REPLACE ({nudged}) FROM ({select}) t"


def _cleaned(name: str, source: str, signal: str, order: Sequence[str]) -> None:
    by = f"PARTITION BY file ORDER BY {', '.join(order)}"
    inside = f"CASE WHEN wavelength > 850 AND wavelength < 900 THEN {signal} END"
    block(f"{name}_b", f"SELECT *, {signal} - avg({inside}) OVER (PARTITION BY file) AS bx"
          f" FROM {source}")
    _smoothed(name, f"{name}_b", "bx", signal, by)


def _smoothed(name: str, source: str, x: str, signal: str, by: str) -> None:
    block(f"{name}_m", f"""
        SELECT *, row_number() OVER ({by}) AS i, count(*) OVER (PARTITION BY file) AS n,
          median({x}) OVER ({by} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m5,
          median({x}) OVER ({by} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m3
        FROM {source}""")
    block(f"{name}_y", f"""
        SELECT *, CASE WHEN n >= 5 AND i > 2 AND i <= n - 2 THEN m5
          WHEN n IN (3, 4) AND i > 1 AND i < n THEN m3 ELSE {x} END AS y FROM {name}_m""")
    block(f"{name}_s", f"""
        SELECT *, CASE WHEN n >= 5 AND (i = 2 OR i = n - 1)
          THEN list_sort([lag(y) OVER ({by}), y, lead(y) OVER ({by})])[2] ELSE y END AS s
        FROM {name}_y""")
    block(f"{name}_e", f"""
        SELECT *, lead(s, 1) OVER ({by}) AS a1, lead(s, 2) OVER ({by}) AS a2,
          lag(s, 1) OVER ({by}) AS p1, lag(s, 2) OVER ({by}) AS p2 FROM {name}_s""")
    block(name, f"""
        SELECT * EXCLUDE ({signal}), CASE WHEN bx_null OR n < 3 THEN s
          WHEN i = 1 THEN list_sort([s, a1, 3 * a1 - 2 * a2])[2]
          WHEN i = n THEN list_sort([s, p1, 3 * p1 - 2 * p2])[2] ELSE s END AS {signal}
        FROM (SELECT *, {x} IS NULL AS bx_null FROM {name}_e) t""")


_cleaned("flc", "fl", "intensity", FL_ORDER)
_cleaned("abc", "ab", "absorbance", AB_ORDER)
_cleaned("fuc", "fu", "intensity", FL_ORDER)
_cleaned("fuv", "fu", "intensity", ("wavelength", "intensity"))
_cleaned("auc", "au", "absorbance", AB_ORDER)
_cleaned("fpc", "fp", "intensity", FL_ORDER)
_cleaned("apc", "ap", "absorbance", AB_ORDER)
_smoothed("fls", "fl", "intensity", "intensity",
          f"PARTITION BY file ORDER BY {', '.join(FL_ORDER)}")

_ABSORBANCE = "absorbance <= 1.9 AND wavelength <= 900 AND (wavelength <= 650 OR wavelength >= 665)"
for letter in "lup":
    block(f"f{letter}x", f"SELECT * FROM f{letter}c WHERE wavelength >= 200 AND wavelength <= 900")
block("abx", f"SELECT * FROM abc WHERE {_ABSORBANCE}")
block("aux", f"SELECT * FROM auc WHERE {_ABSORBANCE.removeprefix('absorbance <= 1.9 AND ')}")
block("auy", f"SELECT * FROM auc WHERE {_ABSORBANCE} AND wavelength >= 220")
block("apx", f"SELECT * FROM apc WHERE {_ABSORBANCE}")
for source in ("abx", "aux", "auy", "apx"):
    block(f"{source}365", f"SELECT file, median(absorbance) AS absorbance FROM {source}"
          " WHERE abs(wavelength - 365) <= 3 GROUP BY file")


def strict(agg: str, value: str) -> str:
    return f"CASE WHEN count(*) = count({value}) THEN {agg}({value}) END"


def strict_where(agg: str, value: str, condition: str) -> str:
    inside = f"CASE WHEN {condition} THEN {value} END"
    return (
        f"CASE WHEN count(CASE WHEN {condition} THEN 1 END) = count({inside})"
        f" THEN {agg}({inside}) END"
    )


def _features(name: str, fl: str, a365: str, sheet: str) -> None:
    """Everything per spectrum, the absorbance joined to every point first."""
    block(f"{name}_p", f"""
        SELECT f.file, f.wavelength, f.intensity / nullif(a.absorbance, 0) AS r
        FROM {fl} f LEFT JOIN {a365} a ON f.file = a.file""")
    bands = {"int_365": (360, 370), "int_490": (480, 500), "int_600": (590, 610)}
    means = ", ".join(
        f"{strict_where('avg', 'r', f'wavelength BETWEEN {lo} AND {hi}')} AS {band}"
        for band, (lo, hi) in bands.items()
    )
    block(f"{name}_a", f"""
        SELECT file, {strict_where('sum', 'r', 'wavelength > 400')} AS integral,
          {strict_where('sum', 'r', 'wavelength < 400')} AS scatter, {means}
        FROM {name}_p GROUP BY file HAVING count(CASE WHEN wavelength > 400 THEN 1 END) > 0""")
    block(name, f"SELECT a.*, s.* EXCLUDE (file) FROM {name}_a a"
          f" LEFT JOIN {sheet} s ON a.file = s.file")


_features("feat_ratio", "flx", "abx365", "ratio")
_features("feat_factorial", "fux", "aux365", "factorial")
_features("feat_pooled", "fux", "auy365", "factorial")


def number_text(column: str) -> str:
    """A number with 15 digits at most in the shorter of plain and exponent notation, or NA."""
    x = f"CAST({column} AS DOUBLE)"
    written = f"printf('%.14e', abs({x}))"
    e = f"CAST(split_part({written}, 'e', 2) AS INTEGER)"
    d = f"regexp_replace(replace(split_part({written}, 'e', 1), '.', ''), '^(.+?)0+$', '\\1')"
    plain = (f"CASE WHEN {e} < 0 THEN concat('0.', repeat('0', -{e} - 1), {d})"
             f" WHEN length({d}) <= {e} + 1 THEN rpad({d}, {e} + 1, '0')"
             f" ELSE concat(left({d}, {e} + 1), '.', substr({d}, {e} + 2)) END")
    power = (f"concat(left({d}, 1), CASE WHEN length({d}) > 1 THEN concat('.', substr({d}, 2)) ELSE '' END,"
             f" 'e', CASE WHEN {e} < 0 THEN '-' ELSE '+' END, lpad(CAST(abs({e}) AS VARCHAR), 2, '0'))")
    return (f"CASE WHEN {x} IS NULL THEN 'NA' ELSE concat(CASE WHEN {x} < 0 THEN '-' ELSE '' END,"
            f" CASE WHEN length({plain}) <= length({power}) THEN {plain} ELSE {power} END) END")


_LEVELS = ["Au_level", "AMP_level", "N3_level", "Citr_level", "NaH_level"]
block("yield_ratio", """
    SELECT i.file, i.n3_au, i.type, i.integral, r.integral AS ref_integral,
      i.integral / nullif(r.integral, 0) * 0.54::DOUBLE AS qy
    FROM feat_ratio i LEFT JOIN (SELECT integral FROM feat_ratio WHERE type = 'ref') r
      ON i.type = 'au' WHERE i.type NOT LIKE '%ref%'""")
block("design_factorial", f"""
    SELECT i.file, concat('au', {number_text('i."Au_level"')}, '_AMP', {number_text('i."AMP_level"')},
        '_Citr', {number_text('i."Citr_level"')}, '_NaH', {number_text('i."NaH_level"')},
        '_N3', {number_text('i."N3_level"')}) AS label,
      {', '.join('i.' + c for c in _LEVELS)}, i.integral, r.integral AS ref_integral,
      i.integral / nullif(r.integral, 0) * 0.54::DOUBLE AS qy,
      i.integral / nullif(r.integral, 0) * 0.54::DOUBLE * 100 AS qy_percent,
      i.scatter / nullif(r.scatter, 0) AS rel_scatter, i.int_365, i.int_490, i.int_600,
      i.int_600 / nullif(i.int_490, 0) AS int_600_490
    FROM feat_factorial i LEFT JOIN
      (SELECT integral, scatter FROM feat_factorial WHERE type = 'ref') r ON i.type = 'au'
    WHERE i.type = 'au'""")
for kind in ("au2", "au3"):
    block(f"yield_{kind}", f"""
        SELECT i.*, concat('au', {number_text('i."Au_conc"')}, '_AMP', {number_text('i."AMP_ratio"')},
            '_Citr', {number_text('i."Citr_ratio"')}, '_NaH', {number_text('i."NaH_ratio"')},
            '_N3', {number_text('i."N3_ratio"')}) AS label,
          r.m AS ref_integral, i.integral / nullif(r.m, 0) * 0.54::DOUBLE AS qy
        FROM feat_pooled i, (SELECT avg(integral) AS m FROM feat_pooled WHERE type = 'ref') r
        WHERE i.type = '{kind}' AND i.integral IS NOT NULL""")
    coded = ", ".join(
        f"2 * ({x}_ratio - avg({x}_ratio) OVER ()) / nullif(max({x}_ratio) OVER ()"
        f" - min({x}_ratio) OVER (), 0) AS {x}_level" for x in ("AMP", "Citr", "NaH", "N3")
    )
    block(f"design_{kind}", f"""
        SELECT file, label, AMP_ratio, Citr_ratio, NaH_ratio, N3_ratio, {coded}, qy,
          int_365, int_490, int_600, int_600 / nullif(int_490, 0) AS int_600_490,
          CASE WHEN qy > 0.02 THEN qy * (int_600 / nullif(int_490, 0))
            WHEN qy IS NOT NULL THEN 0 END AS target FROM yield_{kind}""")

block("mixing_sheet", """
    SELECT file, concat(coalesce(comp_1_2, 'NA'), ' < ', coalesce(comp_3, 'NA'), ' < ',
        coalesce(comp_4, 'NA'), ' < ', coalesce(comp_5, 'NA')) AS label,
      comp_5 = 'Au' AS au_last, comp_5 = 'w' AS water_last,
      (comp_4 = 'w' AND comp_5 = 'Au') OR (comp_4 = 'Au' AND comp_5 = 'w') AS ligands_first
    FROM mixing""")


def all_true(flag: str) -> str:
    return (
        f"CASE WHEN count(CASE WHEN NOT {flag} THEN 1 END) > 0 THEN false"
        f" WHEN count({flag}) = count(*) THEN true END AS {flag}"
    )


for name, source, signal in (("mix_fl", "flx", "intensity"), ("mix_ab", "abx", "absorbance")):
    block(name, f"""
        SELECT label, wavelength, avg({signal}) AS {signal}, {all_true('au_last')},
          {all_true('water_last')}, {all_true('ligands_first')}
        FROM {source} x LEFT JOIN mixing_sheet s ON x.file = s.file GROUP BY label, wavelength""")
block("mix_emission", """
    SELECT f.*, a.absorbance, f.intensity / nullif(a.absorbance, 0) AS normalized
    FROM mix_fl f LEFT JOIN (SELECT label, median(absorbance) AS absorbance FROM mix_ab
      WHERE abs(wavelength - 365) <= 3 GROUP BY label) a ON f.label = a.label""")

block("dose_sheet", "SELECT file, c_Hg_stock * V_Hg / 3300::DOUBLE AS c_Hg, sample, pH FROM dose")
block("dose_sums", f"""
    SELECT x.file, s.c_Hg, s.sample, s.pH, {strict('sum', 'intensity')} AS integral
    FROM fux x LEFT JOIN dose_sheet s ON x.file = s.file WHERE wavelength > 400
    GROUP BY x.file, s.c_Hg, s.sample, s.pH""")
block("dose_spread", f"""
    SELECT c_Hg, sample, pH, {strict('stddev_samp', 'integral')} AS sd,
      {strict('median', 'integral')} AS integral
    FROM dose_sums GROUP BY c_Hg, sample, pH""")
block("dose_resp", """
    SELECT d.*, r.integral AS ref, d.integral / nullif(r.integral, 0) AS rel_integral,
      d.sd / nullif(r.integral, 0) AS rel_sd
    FROM dose_spread d LEFT JOIN (SELECT * FROM dose_spread WHERE c_Hg = 0) r
      ON d.sample = r.sample AND d.pH = r.pH""")
block("ion_sums", f"""
    SELECT x.file, s.sample, s.ion, {strict('sum', 'intensity')} AS integral
    FROM fux x LEFT JOIN ions s ON x.file = s.file WHERE wavelength > 400
    GROUP BY x.file, s.sample, s.ion""")
block("ion_spread", f"""
    SELECT sample, ion, {strict('stddev_samp', 'integral')} AS sd,
      {strict('median', 'integral')} AS integral
    FROM ion_sums GROUP BY sample, ion""")
block("ion_resp", """
    SELECT d.*, r.integral AS ref, d.integral / nullif(r.integral, 0) AS rel_integral,
      d.sd / nullif(r.integral, 0) AS rel_sd
    FROM ion_spread d LEFT JOIN (SELECT * FROM ion_spread WHERE ion = 'ref') r
      ON d.sample = r.sample""")
block("dilution", f"""
    SELECT x.file, round_even(s.V_sample / s.V_total, 2) AS conc_rel, min(s.sample) AS sample,
      {strict('sum', 'x.intensity')} AS integral
    FROM fpx x LEFT JOIN ph s ON x.file = s.file WHERE s.pH IS NULL
    GROUP BY x.file, round_even(s.V_sample / s.V_total, 2)""")


def signif(x: str, digits: int) -> str:
    shift = f"({digits - 1} - floor(log10(abs(nullif({x}, 0)))))"
    up, down = f"pow(10, greatest({shift}, 0))", f"pow(10, greatest(-{shift}, 0))"
    return f"CASE WHEN {x} = 0 THEN 0 ELSE round_even({x} * {up} / {down}, 0) * {down} / {up} END"


block("quenched_med", f"""
    SELECT x.wavelength, {signif('(s.c_Hg * 1e6)', 2)} AS c_Hg, s.sample, s.pH,
      {strict('median', 'x.intensity')} AS intensity
    FROM fux x LEFT JOIN dose_sheet s ON x.file = s.file WHERE x.wavelength > 400
    GROUP BY ALL""")
block("quenched", """
    SELECT wavelength, c_Hg, sample,
      concat('pH = ', CASE pH WHEN 'low' THEN '3.8' WHEN 'high' THEN '6.0' END) AS pH,
      CASE WHEN count(*) OVER g = count(intensity) OVER g
        THEN intensity / nullif(max(intensity) OVER g, 0) END AS intensity
    FROM quenched_med WINDOW g AS (PARTITION BY c_Hg, sample, pH)""")


# --- least squares ------------------------------------------------------------------------

def _product(term: str) -> str:
    return "1.0::DOUBLE" if term == "" else "*".join(term.split(":"))


def normal_equations(
    name: str, source: str, y: str, terms: Sequence[str], where: str = "true", by: str = ""
) -> None:
    """``{name}``: per group the matrix of sums of products of [1, terms, y] as nested lists."""
    columns = ["", *terms, y]
    picked = ", ".join(f"{_product(t)} AS v{i}" for i, t in enumerate(columns))
    known = " AND ".join(f"v{i} IS NOT NULL" for i in range(len(columns)))
    rows = ", ".join(
        "[" + ", ".join(f"sum(v{i} * v{j})" for j in range(len(columns))) + "]"
        for i in range(len(columns))
    )
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    block(f"{name}_rows", f"SELECT {lead}{picked} FROM {source} WHERE {where}")
    block(name, f"SELECT {lead}[{rows}] AS g FROM {name}_rows WHERE {known} {group}")


def solved(name: str, systems: str) -> None:
    """Gauss-Jordan elimination of every augmented matrix ``m`` of ``systems``."""
    block(name, f"""
        SELECT *, 0 AS k FROM ({systems}) s
        UNION ALL
        SELECT * REPLACE (list_transform(m, lambda row, i: CASE WHEN i = k + 1
            THEN list_transform(row, lambda v: v / m[k + 1][k + 1])
            ELSE list_transform(row, lambda v, j: v - row[k + 1] * m[k + 1][j] / m[k + 1][k + 1])
            END) AS m, k + 1 AS k)
        FROM {name} WHERE k < len(m)""")


def least_squares(
    name: str, source: str, y: str, terms: Sequence[str], where: str = "true", by: str = ""
) -> None:
    """Blocks ``{name}`` (coefficients), ``{name}_fit`` (sums) and ``{name}_ss`` (type II)."""
    p = len(terms) + 1
    normal_equations(f"{name}_g", source, y, terms, where, by)
    lead = f"{by}, " if by else ""
    factors = [frozenset()] + [frozenset(t.split(":")) for t in terms]
    subsets = {"": list(range(p))}
    for column, term in enumerate(terms, start=1):
        others = [j for j in range(p) if not factors[column] <= factors[j]]
        subsets[term] = [*others, column]
    cases = ", ".join(
        f"('{term}', [{', '.join(str(i + 1) for i in columns)}])"
        for term, columns in subsets.items()
    )
    solved(f"{name}_solved", f"""
        SELECT {lead}g, idx, what, list_transform(idx, lambda i, a:
          list_concat(list_transform(idx, lambda j: g[i][j]), [g[i][{p + 1}]],
            list_transform(range(1, len(idx) + 1), lambda b: CASE WHEN a = b THEN 1.0 ELSE 0.0 END))) AS m
        FROM {name}_g, (VALUES {cases}) c(what, idx)""")
    block(f"{name}_end", f"SELECT * FROM {name}_solved WHERE k = len(m)")
    names = ", ".join(f"'{t}'" for t in ["(Intercept)", *terms])
    block(f"{name}_fit", f"""
        SELECT {lead}m, g[1][1] AS n, g[1][1] - {p} AS df, g[1][{p + 1}] AS sy,
          g[{p + 1}][{p + 1}] AS yy,
          g[{p + 1}][{p + 1}] - list_sum(list_transform(range(1, {p + 1}),
            lambda j: m[j][{p + 1}] * g[j][{p + 1}])) AS rss
        FROM {name}_end WHERE what = ''""")
    block(name, f"""
        SELECT {lead}([{names}])[j] AS term, m[j][{p + 1}] AS coef,
          sqrt(rss / df * m[j][{p + 1} + j]) AS se,
          m[j][{p + 1}] / sqrt(rss / df * m[j][{p + 1} + j]) AS t, df
        FROM {name}_fit, range(1, {p + 1}) r(j)""")
    fit = f"{name}_fit f USING ({by})" if by else f"{name}_fit f ON true"
    block(f"{name}_ss", f"""
        SELECT {lead}e.what AS term, pow(e.m[len(e.m)][len(e.m) + 1], 2)
            / e.m[len(e.m)][2 * len(e.m) + 1] AS ss, 1 AS df, f.rss / f.df AS ms, f.df AS rdf
        FROM {name}_end e JOIN {fit} WHERE e.what <> ''""")


def t_tail(t: str, df: str) -> str:
    """Two-sided tail of t."""
    return f_tail(f"({t}) * ({t})", "1", df)


def f_tail(f: str, df1: str, df2: str) -> str:
    """Upper tail of F: the integral of sin^(df1-1) cos^(df2-1) by Simpson's rule."""
    start = f"atan(sqrt({df1} * ({f}) / {df2}))"
    width = f"(least(pi() / 2, {start} + 40 / sqrt({df2})) - {start})"
    steps = 4000
    angle = f"({start} + i * {width} / {steps})"
    terms = (
        f"list_sum(list_transform(range(0, {steps + 1}), lambda i:"
        f" CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
        f" * pow(sin{angle}, {df1} - 1) * pow(greatest(cos{angle}, 0), {df2} - 1)))"
    )
    beta = f"exp(lgamma({df1} / 2.0) + lgamma({df2} / 2.0) - lgamma(({df1} + {df2}) / 2.0))"
    return f"(2 * {terms} * {width} / {steps} / 3 / {beta})"


def two_way(factors: Sequence[str]) -> list[str]:
    return [*factors, *[f"{a}:{b}" for a, b in combinations(factors, 2)]]
