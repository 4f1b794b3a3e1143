"""Filters, joins, aggregates, ordered operators, scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.registry import entry
from catalog.sql import all_true, number_text, signif, strict, strict_where
from catalog.views import AB_ORDER, FL_ORDER
from spectrafold.functions import numeric, strict as na, text
from spectrafold.operators import aggregates as agg
from spectrafold.operators import design, filters, joins
from spectrafold.operators.cleaning import baseline_correct, running_median
from spectrafold.operators.models import gated_product
from spectrafold.plans import spectra, yields
from spectrafold.plans.mixing import FLAGS, control_label, mixture_spectra, order_sheet
from spectrafold.plans.quenching import PH_LABELS, dose_response, dose_sheet, quenching
from spectrafold.sources.figures import band_polygons

# --- projections and filters ------------------------------------------------------------


@entry("P1_select_drop", "SELECT file, wavelength, intensity FROM fl", "wavelength intensity")
def _(t):
    return t.fl.drop("seq").select("file", "wavelength", "intensity")


@entry("P2_rename", "SELECT file, integral AS ref_integral FROM (SELECT file, sum(intensity)"
       " AS integral FROM fl GROUP BY file) x", "ref_integral", 4)
def _(t):
    return agg.raw_integral(t.fl, ["file"]).withColumnRenamed("integral", "ref_integral")


@entry("P3_derived_columns", "SELECT seq, file, intensity * 2 - wavelength AS shifted,"
       " 'au' AS type FROM fl", "shifted")
def _(t):
    return t.fl.select(
        "seq", "file", (F.col("intensity") * 2 - F.col("wavelength")).alias("shifted"),
        F.lit("au").alias("type"),
    )


@entry("P4_clip_wavelength", "SELECT file, seq, wavelength, 'closed' AS kind FROM fl WHERE"
       " wavelength >= 220 AND wavelength <= 900 UNION ALL SELECT file, seq, wavelength, 'above'"
       " FROM fl WHERE wavelength > 400 UNION ALL SELECT file, seq, wavelength, 'below' FROM fl"
       " WHERE wavelength < 400", "wavelength")
def _(t):
    fl = t.fl.select("file", "seq", "wavelength")
    closed = filters.clip_wavelength(fl, 220, 900).withColumn("kind", F.lit("closed"))
    above = filters.clip_wavelength(fl, 400, lo_open=True).withColumn("kind", F.lit("above"))
    below = filters.clip_wavelength(fl, hi=400, hi_open=True).withColumn("kind", F.lit("below"))
    return closed.unionByName(above).unionByName(below)


@entry("P5_exclude_band", "SELECT file, seq, wavelength FROM fl WHERE wavelength <= 650 OR"
       " wavelength >= 665", "wavelength")
def _(t):
    return filters.exclude_band(t.fl, 650, 665).select("file", "seq", "wavelength")


@entry("P6_below_saturation", "SELECT file, o1, o2, o3, absorbance FROM abc WHERE absorbance <= 1.9",
       "absorbance")
def _(t):
    ab = spectra.cleaned(t.ab, "absorbance", AB_ORDER)
    return filters.below_saturation(ab).select("file", "o1", "o2", "o3", "absorbance")


@entry("P7_sample_predicates", "SELECT f.file, f.seq, s.type, s.a_level FROM fl f JOIN samples s"
       " ON f.file = s.file WHERE s.type IN ('au', 'ref') AND s.type <> 'ref' AND"
       " s.a_level IN (-1, 1) AND s.b_level = 0")
def _(t):
    rows = joins.attach_samples(t.fl, t.samples)
    kept = rows.where(spectra.sample_is("au", "ref")).where(F.col("type") != "ref")
    kept = kept.where(F.col("a_level").isin(-1, 1)).where(F.col("b_level") == 0)
    return kept.select("file", "seq", "type", "a_level")


@entry("P8_null_predicates", "SELECT f.file, f.seq, s.pH IS NULL AS no_ph FROM fp f JOIN ph s"
       " ON f.file = s.file")
def _(t):
    rows = t.fp.join(t.ph, "file")
    return (
        rows.where(F.col("pH").isNull())
        .unionByName(rows.where(F.col("pH").isNotNull()))
        .select("file", "seq", F.col("pH").isNull().alias("no_ph"))
    )


@entry("P9_clip_xy", "SELECT file, o1, o2, o3, wavelength, absorbance FROM ab WHERE wavelength"
       " BETWEEN 280 AND 500 AND absorbance BETWEEN 0 AND 1.25", "wavelength absorbance")
def _(t):
    clipped = filters.clip_xy(t.ab, "wavelength", (280, 500), "absorbance", (0, 1.25))
    return clipped.select("file", "o1", "o2", "o3", "wavelength", "absorbance")


@entry("P10_near_wavelength", "SELECT file, o1, o2, o3, wavelength FROM ab WHERE"
       " abs(wavelength - 365) <= 3", "wavelength")
def _(t):
    return filters.near_wavelength(t.ab, 365, 3).select("file", "o1", "o2", "o3", "wavelength")


@entry("P11_layers", """
    SELECT f.file, f.seq, 'ligands first' AS layer FROM fl f JOIN mixing_sheet s ON f.file = s.file
      WHERE ligands_first
    UNION ALL SELECT f.file, f.seq, 'water last' FROM fl f JOIN mixing_sheet s ON f.file = s.file
      WHERE ligands_first AND water_last
    UNION ALL SELECT f.file, f.seq, 'other' FROM fl f JOIN mixing_sheet s ON f.file = s.file
      WHERE NOT ligands_first""")
def _(t):
    rows = joins.attach_samples(t.fl, order_sheet(t.mixing))
    rules = {
        "ligands first": F.col("ligands_first"),
        "water last": F.col("ligands_first") & F.col("water_last"),
        "other": ~F.col("ligands_first"),
    }
    return filters.layers(rows, rules).select("file", "seq", "layer")


@entry("P12_thresholds", "SELECT file, c_Hg FROM dose_sheet WHERE c_Hg < 4e-5 AND c_Hg <> 0",
       "c_Hg", 12)
def _(t):
    sheet = dose_sheet(t.dose).where(F.col("c_Hg") < 4e-5).where(F.col("c_Hg") != 0)
    return sheet.select("file", "c_Hg")


@entry("P13_text_predicate", "SELECT file, type, type LIKE '%ref%' AS is_ref FROM factorial")
def _(t):
    is_ref = filters.has_text("type", "ref")
    sheet = t.factorial.select("file", "type")
    refs, rest = sheet.where(is_ref), sheet.where(~is_ref)
    return refs.withColumn("is_ref", F.lit(True)).unionByName(
        rest.withColumn("is_ref", F.lit(False))
    )


# --- joins --------------------------------------------------------------------------------


@entry("J1_attach_samples", "SELECT f.file, f.seq, f.intensity, s.type, s.a_level, s.b_level"
       " FROM fu f LEFT JOIN samples s ON f.file = s.file", "intensity")
def _(t):
    rows = joins.attach_samples(t.fu, t.samples)
    return rows.select("file", "seq", "intensity", "type", "a_level", "b_level")


@entry("J3_attach_signal", "SELECT f.file, f.seq, f.intensity, a.absorbance FROM fux f"
       " LEFT JOIN aux365 a ON f.file = a.file", "intensity absorbance")
def _(t):
    a365 = yields.absorbance_365(spectra.absorbance(t.au, AB_ORDER))
    rows = joins.attach_signal(spectra.fluorescence(t.fu, FL_ORDER), a365)
    return rows.select("file", "seq", "intensity", "absorbance")


@entry("J4_reference_self_join", """
    SELECT i.file, i.type, i.integral, r.integral AS ref, i.integral / nullif(r.integral, 0) AS rel
    FROM (SELECT f.file, s.type, sum(f.intensity) AS integral FROM fl f LEFT JOIN samples s
      ON f.file = s.file GROUP BY f.file, s.type) i
    LEFT JOIN (SELECT sum(f.intensity) AS integral FROM fl f JOIN samples s ON f.file = s.file
      WHERE s.type = 'ref') r ON i.type = 'au'""", "integral ref rel", 4)
def _(t):
    rows = joins.attach_samples(agg.raw_integral(t.fl, ["file"]), t.samples)
    rows = joins.normalize_to_reference(
        rows, "integral", filters.has_text("type", "ref"), ["type"], relabel={"type": "au"}
    )
    return rows.select(
        "file", "type", "integral", "ref", na.safe_div("integral", "ref").alias("rel")
    )


@entry("J5_attach_scalar", """
    SELECT file, integral, avg(integral) OVER () AS mean_integral FROM
      (SELECT file, sum(intensity) AS integral FROM fu GROUP BY file) x""",
       "integral mean_integral", 4)
def _(t):
    sums = agg.raw_integral(t.fu, ["file"])
    return joins.attach_scalar(sums, sums.agg(F.avg("integral")), "mean_integral")


@entry("J6_feature_join", """
    SELECT i.file, i.integral, a.int_365, b.int_490, c.int_600 FROM
      (SELECT file, sum(intensity) AS integral FROM fu WHERE wavelength > 400 GROUP BY file) i
      LEFT JOIN (SELECT file, avg(intensity) AS int_365 FROM fu WHERE wavelength >= 360 AND
        wavelength <= 370 GROUP BY file) a ON i.file = a.file
      LEFT JOIN (SELECT file, avg(intensity) AS int_490 FROM fu WHERE wavelength >= 480 AND
        wavelength <= 500 GROUP BY file) b ON i.file = b.file
      LEFT JOIN (SELECT file, avg(intensity) AS int_600 FROM fu WHERE wavelength >= 590 AND
        wavelength <= 610 GROUP BY file) c ON i.file = c.file""",
       "integral int_365 int_490 int_600")
def _(t):
    return agg.spectrum_features(t.fu, ["file"], 400, yields.BANDS).drop("scatter")


@entry("J7_level_grid", """
    SELECT g.a, g.b, g.c, coalesce(n.n, 0) AS n, n.y FROM
      (SELECT -1 + i * 0.05::DOUBLE AS a, -1 + j * 0.05::DOUBLE AS b, -1 + k * 0.05::DOUBLE AS c
       FROM range(0, 41) r(i), range(0, 41) s(j), range(0, 41) u(k)) g
    LEFT JOIN (SELECT round((a + 1) / 0.05::DOUBLE) AS i, round((b + 1) / 0.05::DOUBLE) AS j,
        round((c + 1) / 0.05::DOUBLE) AS k, count(*) AS n, avg(y) AS y
      FROM runs GROUP BY ALL) n
    ON round((g.a + 1) / 0.05::DOUBLE) = n.i AND round((g.b + 1) / 0.05::DOUBLE) = n.j
      AND round((g.c + 1) / 0.05::DOUBLE) = n.k""", "a b c y")
def _(t):
    """The grid with the number of runs and their mean response next to each point."""
    names = ["a", "b", "c"]
    grid = design.level_grid(t.spark, names)
    nearest = {c: -1.0 + F.round((F.col(c) + 1) / 0.05) * F.lit(0.05) for c in names}
    measured = t.runs.select(*names, "y").withColumns(nearest).groupBy(*names).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("y")
    )
    joined = grid.join(measured, names, "left")
    return joined.withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


# --- aggregates -----------------------------------------------------------------------------

@entry("A1_baseline_mean", f"SELECT file, {strict_where('avg', 'intensity', 'wavelength > 850 AND wavelength < 900')}"
       " AS baseline FROM fl GROUP BY file", "baseline")
def _(t):
    inside = (F.col("wavelength") > 850) & (F.col("wavelength") < 900)
    return t.fl.groupBy("file").agg(
        na.strict_avg_where(inside, F.col("intensity")).alias("baseline")
    )


@entry("A2_point_signal", "SELECT file, median(absorbance) AS absorbance FROM ab WHERE"
       " abs(wavelength - 365) <= 3 GROUP BY file", "absorbance")
def _(t):
    return agg.point_signal(t.ab)


_JOINED = (
    "(SELECT f.file, f.wavelength, f.intensity / nullif(a.absorbance, 0) AS r FROM fux f"
    " LEFT JOIN aux365 a ON f.file = a.file) x"
)


def _joined(t):
    a365 = yields.absorbance_365(spectra.absorbance(t.au, AB_ORDER))
    return joins.attach_signal(spectra.fluorescence(t.fu, FL_ORDER), a365)


@entry("A3_normalized_integral", f"SELECT file, {strict('sum', 'r')} AS integral, 'emission' AS"
       f" kind FROM {_JOINED} WHERE wavelength > 400 GROUP BY file UNION ALL SELECT file,"
       f" {strict('sum', 'r')}, 'scatter' FROM {_JOINED} WHERE wavelength < 400 GROUP BY file",
       "integral", 4)
def _(t):
    rows = _joined(t)
    emission = agg.normalized_integral(rows, ["file"], lo=400)
    scatter = agg.normalized_integral(rows, ["file"], hi=400)
    return emission.withColumn("kind", F.lit("emission")).unionByName(
        scatter.withColumn("kind", F.lit("scatter"))
    )


@entry("A4_band_means", f"SELECT file, {strict_where('avg', 'r', 'wavelength BETWEEN 360 AND 370')}"
       f" AS int_365, {strict_where('avg', 'r', 'wavelength BETWEEN 480 AND 500')} AS int_490,"
       f" {strict_where('avg', 'r', 'wavelength BETWEEN 590 AND 610')} AS int_600 FROM {_JOINED}"
       " GROUP BY file", "int_365 int_490 int_600")
def _(t):
    return agg.band_means(_joined(t), yields.BANDS, ["file"])


@entry("A5_raw_integral", "SELECT file, sum(intensity) AS integral FROM fl WHERE wavelength > 400"
       " GROUP BY file", "integral", 4)
def _(t):
    return agg.raw_integral(t.fl, ["file"], lo=400)


@entry("A6_width_normalized_integral", "SELECT file, coalesce(sum(CASE WHEN wavelength > 590 AND"
       " wavelength < 610 THEN intensity END), 0) / 20.0 AS integral FROM fu GROUP BY file",
       "integral")
def _(t):
    return agg.integral(t.fu, 590, 610)


@entry("A7_replicate_average", "SELECT label, wavelength, intensity FROM mix_fl",
       "wavelength intensity")
def _(t):
    return _mixtures(t).select("label", "wavelength", "intensity")


def _mixtures(t):
    return mixture_spectra(spectra.fluorescence(t.fl, FL_ORDER), t.mixing, "intensity")


@entry("A8_all_flags", f"SELECT label, {all_true('au_last')}, {all_true('water_last')},"
       f" {all_true('ligands_first')} FROM fl f LEFT JOIN mixing_sheet s ON f.file = s.file"
       " GROUP BY label")
def _(t):
    rows = joins.attach_samples(t.fl, order_sheet(t.mixing))
    return rows.groupBy("label").agg(*[na.all_true(f).alias(f) for f in FLAGS])


@entry("A9_replicate_median", "SELECT wavelength, sample, median(intensity) AS intensity FROM fu f"
       " JOIN dose d ON f.file = d.file GROUP BY wavelength, sample", "wavelength intensity")
def _(t):
    rows = t.fu.join(t.dose, "file")
    return agg.replicate_median(rows, ["wavelength", "sample"], "intensity")


@entry("A10_replicate_spread", "SELECT c_Hg, sample, pH, sd, integral FROM dose_spread",
       "c_Hg@12 sd integral", 4)
def _(t):
    sums = agg.raw_integral(spectra.fluorescence(t.fu, FL_ORDER), ["file"], lo=400)
    rows = joins.attach_samples(sums, dose_sheet(t.dose))
    return agg.replicate_spread(rows, ["c_Hg", "sample", "pH"], "integral")


@entry("A11_group_representative", "SELECT f.file, min(s.sample) AS sample, sum(intensity) AS"
       " integral FROM fp f JOIN ph s ON f.file = s.file GROUP BY f.file", "integral", 4)
def _(t):
    rows = t.fp.join(t.ph, "file")
    return rows.groupBy("file").agg(
        F.min("sample").alias("sample"), na.strict_sum("intensity").alias("integral")
    )


@entry("A12_group_count", "SELECT file, count(*) AS n FROM fl WHERE wavelength BETWEEN 480 AND 500"
       " GROUP BY file")
def _(t):
    return agg.group_count(filters.clip_wavelength(t.fl, 480, 500), ["file"])


@entry("A13_global_mean", "SELECT avg(integral) AS mean_integral FROM (SELECT file,"
       " sum(intensity) AS integral FROM fu GROUP BY file) x", "mean_integral", 4)
def _(t):
    sums = agg.raw_integral(t.fu, ["file"])
    return sums.agg(na.strict_avg("integral").alias("mean_integral"))


_SUMMARY = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", min({c}) AS min, quantile_cont({c}, 0.25) AS q1, median({c}) AS"
    f" median, avg({c}) AS mean, quantile_cont({c}, 0.75) AS q3, max({c}) AS max FROM runs"
    for c in ("price", "quantity", "y")
)


@entry("A14_numeric_summary", _SUMMARY, "min q1 median mean q3 max")
def _(t):
    return agg.numeric_summary(t.runs, ["price", "quantity", "y"])


# --- ordered operators ------------------------------------------------------------------------


@entry("W1_baseline_correct", "SELECT file, seq, bx AS intensity FROM flc_b", "intensity")
def _(t):
    return baseline_correct(t.fl, 850, 900).select("file", "seq", "intensity")


@entry("W2_running_median", "SELECT file, seq, intensity FROM fls", "intensity")
def _(t):
    return running_median(t.fl, 5, order=FL_ORDER).select("file", "seq", "intensity")


@entry("W3_running_median_ends", "SELECT file, seq, 'head' AS end, i AS place, intensity FROM fls"
       " WHERE i <= 2 UNION ALL SELECT file, seq, 'tail', n + 1 - i, intensity FROM fls WHERE"
       " i >= n - 1", "intensity")
def _(t):
    """The first and last two points; the rank filter prunes rows before they are shuffled."""
    smooth = running_median(t.fl, 5, order=FL_ORDER).select("file", "seq", "wavelength", "intensity")
    ends = []
    for end, order in (("head", F.asc), ("tail", F.desc)):
        w = Window.partitionBy("file").orderBy(*[order(c) for c in FL_ORDER])
        ranked = smooth.withColumn("place", F.row_number().over(w)).where("place <= 2")
        ends.append(ranked.select("file", "seq", F.lit(end).alias("end"),
                                  F.col("place").cast("long").alias("place"), "intensity"))
    return ends[0].unionByName(ends[1])


@entry("W4_normalize_to_max", "SELECT file, seq, intensity / nullif(max(intensity) OVER"
       " (PARTITION BY file), 0) AS intensity FROM fl", "intensity")
def _(t):
    return joins.normalize_to_max(t.fl, "intensity", ["file"]).select("file", "seq", "intensity")


@entry("W5_encode_levels", """
    SELECT seq, grp, price,
      2 * (quantity - avg(quantity) OVER ()) / nullif(max(quantity) OVER () - min(quantity) OVER (), 0)
        AS quantity_level,
      2 * (discount - avg(discount) OVER (PARTITION BY grp)) / nullif(max(discount) OVER
        (PARTITION BY grp) - min(discount) OVER (PARTITION BY grp), 0) AS discount_level
    FROM runs""", "price quantity_level discount_level")
def _(t):
    coded = design.encode_levels(t.runs, {"quantity": "quantity_level"})
    coded = design.encode_levels(coded, {"discount": "discount_level"}, ["grp"])
    return coded.select("seq", "grp", "price", "quantity_level", "discount_level")


@entry("W6_reference_ratio", "SELECT c_Hg, sample, pH, rel_integral, rel_sd FROM dose_resp",
       "c_Hg@12 rel_integral rel_sd")
def _(t):
    response = dose_response(spectra.fluorescence(t.fu, FL_ORDER), t.dose)
    return response.select("c_Hg", "sample", "pH", "rel_integral", "rel_sd")


# --- top-k, order, union ----------------------------------------------------------------------


@entry("K1_top_k", "SELECT seq, price, y FROM runs ORDER BY y DESC, seq, price LIMIT 100",
       "price y")
def _(t):
    return design.top_k(t.runs, "y", 100, ["seq", "price"]).select("seq", "price", "y")


@entry("K2_top_k_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", min({c}) AS min, quantile_cont({c}, 0.25) AS q1, median({c}) AS"
    f" median, avg({c}) AS mean, quantile_cont({c}, 0.75) AS q3, max({c}) AS max FROM"
    " (SELECT * FROM runs ORDER BY y DESC, seq, price LIMIT 100) x"
    for c in ("a", "b", "c", "y")
), "min q1 median mean q3 max")
def _(t):
    return agg.numeric_summary(design.top_k(t.runs, "y", 100, ["seq", "price"]), list("abcy"))


@entry("U1_union_by_name", "SELECT file, wavelength, intensity, NULL::DOUBLE AS absorbance FROM fl"
       " UNION ALL SELECT file, wavelength, NULL, absorbance FROM ab",
       "wavelength intensity absorbance")
def _(t):
    fl = t.fl.select("file", "wavelength", "intensity")
    ab = t.ab.select("file", "wavelength", "absorbance")
    return fl.unionByName(ab, allowMissingColumns=True)


@entry("S10_band_polygons", """
    SELECT p.band, p.corner, p.x, count(f.file) AS n FROM (VALUES ('blue', 1, 480.0::DOUBLE),
      ('blue', 2, 500), ('blue', 3, 500), ('blue', 4, 480), ('yellow', 1, 590), ('yellow', 2, 610),
      ('yellow', 3, 610), ('yellow', 4, 590)) p(band, corner, x)
    LEFT JOIN fl f ON (p.band = 'blue' AND f.wavelength BETWEEN 480 AND 500)
      OR (p.band = 'yellow' AND f.wavelength BETWEEN 590 AND 610)
    GROUP BY p.band, p.corner, p.x""")
def _(t):
    """The polygon corners with the number of points each band covers."""
    covered = F.when(agg.in_band((480, 500)), "blue").when(agg.in_band((590, 610)), "yellow")
    counts = agg.group_count(t.fl.withColumn("band", covered), ["band"])
    joined = band_polygons(t.spark).join(counts, "band", "left")
    return joined.withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


# --- scalar functions ---------------------------------------------------------------------------

_STEM = "concat('Subt2_', lpad(CAST(file AS VARCHAR(9)), 5, '0'))"


@entry("X1_sample_number", f"SELECT seq, file, {_STEM} AS stem, CAST(file AS INTEGER) AS number,"
       " lpad(CAST(file AS VARCHAR), 5, '0') AS code FROM fl")
def _(t):
    rows = t.fl.withColumn("stem", F.expr(_STEM.replace("VARCHAR(9)", "STRING")))
    return rows.select(
        "seq", "file", "stem", text.sample_number(F.col("stem")).alias("number"),
        text.sample_code(F.col("stem")).alias("code"),
    )


@entry("X2_template_label", f"SELECT file, concat('au', {number_text('Au_level')}, '_AMP',"
       f" {number_text('AMP_ratio')}, ' of ', coalesce(type, 'NA')) AS label FROM factorial")
def _(t):
    return text.label(t.factorial, "au{Au_level}_AMP{AMP_ratio} of {type}").select("file", "label")


@entry("X2_number_text", f"SELECT seq, {number_text('small')} AS small, {number_text('large')} AS large,"
       " concat('c = ', CASE WHEN share IS NULL THEN 'NA' ELSE " + number_text("share") + " END) AS label FROM"
       " (SELECT seq, wavelength * 1e-7 AS small, floor(wavelength) * 1e3 AS large,"
       " CASE WHEN seq % 7 > 0 THEN floor(intensity) / 10 + 0.2::DOUBLE END AS share FROM fl) x")
def _(t):
    """Numbers of many sizes as they read in labels."""
    share = F.when(F.col("seq") % 7 > 0, F.floor("intensity") / 10 + F.lit(0.2))
    rows = t.fl.select(
        "seq", text.number_text(F.col("wavelength") * 1e-7).alias("small"),
        text.number_text(F.floor("wavelength") * 1e3).alias("large"), share.alias("share"),
    )
    return text.label(rows, "c = {share}").drop("share")


@entry("X3_component_label", """
    SELECT file, coalesce(nullif(concat_ws('+',
      CASE WHEN AMP_ratio IS NULL THEN 'NA' WHEN AMP_ratio <> 0 THEN 'AMP' END,
      CASE WHEN Citr_ratio IS NULL THEN 'NA' WHEN Citr_ratio <> 0 THEN 'citr' END,
      CASE WHEN N3_ratio IS NULL THEN 'NA' WHEN N3_ratio <> 0 THEN 'N<sub>3</sub>' END), ''), ' ')
      AS label FROM factorial""")
def _(t):
    return t.factorial.select("file", control_label().alias("label"))


@entry("X4_remove_literals", """
    SELECT file, replace(replace(concat(CASE WHEN AMP_ratio <> 0 THEN 'AMP' ELSE ' ' END, '+',
      CASE WHEN Citr_ratio <> 0 THEN 'citr' ELSE ' ' END, '+',
      CASE WHEN N3_ratio <> 0 THEN 'N3' ELSE ' ' END), ' +', ''), '+ ', '') AS label
    FROM factorial""")
def _(t):
    parts = [("AMP_ratio", "AMP"), ("Citr_ratio", "citr"), ("N3_ratio", "N3")]
    names = [F.when(F.col(c) != 0, F.lit(n)).otherwise(F.lit(" ")) for c, n in parts]
    joined = F.concat_ws("+", *names)
    return t.factorial.select("file", text.remove_literals(joined, " +", "+ ").alias("label"))


@entry("X5_conditional", "SELECT file, CASE WHEN absorbance > 0.5 THEN absorbance END AS absorbance,"
       " CASE WHEN absorbance IS NULL THEN NULL WHEN absorbance > 1 THEN 'high' ELSE 'low' END"
       " AS kind FROM abx365", "absorbance")
def _(t):
    a = F.col("absorbance")
    a365 = yields.absorbance_365(spectra.absorbance(t.ab, AB_ORDER))
    kind = F.when(a.isNotNull(), F.when(a > 1, F.lit("high")).otherwise(F.lit("low")))
    return a365.select("file", F.when(a > 0.5, a).alias("absorbance"), kind.alias("kind"))


@entry("X6_order_flags", "SELECT f.seq, s.* FROM fl f LEFT JOIN mixing_sheet s ON f.file = s.file")
def _(t):
    sheet = order_sheet(t.mixing).select("file", "label", *FLAGS)
    rows = joins.attach_samples(t.fl, sheet)
    return rows.select("seq", F.when(F.col("label").isNotNull(), F.col("file")).alias("file"),
                       "label", *FLAGS)


@entry("X7_round_half_even", """
    SELECT seq, CASE WHEN x - lo < hi - x THEN lo WHEN x - lo > hi - x THEN hi
      WHEN floor(x * 100) % 2 = 0 THEN lo ELSE hi END AS rounded
    FROM (SELECT seq, x, floor(x * 100) / 100 AS lo, ceil(x * 100) / 100 AS hi
      FROM (SELECT seq, price / 3 AS x FROM runs) r) c""", "rounded")
def _(t):
    return t.runs.select("seq", numeric.round_half_even(F.col("price") / 3, 2).alias("rounded"))


@entry("X8_signif", f"SELECT seq, {signif('(price * 1e-6)', 2)} AS two, {signif('(price * 1000)', 3)}"
       " AS three FROM runs", "two three", 9)
def _(t):
    return t.runs.select(
        "seq", numeric.signif(F.col("price") * 1e-6, 2).alias("two"),
        numeric.signif(F.col("price") * 1000, 3).alias("three"),
    )


@entry("X9_ordered_category", "SELECT file, CASE pH WHEN 'low' THEN '3.8' WHEN 'high' THEN '6.0'"
       " END AS label, CASE pH WHEN 'low' THEN 1 WHEN 'high' THEN 2 END AS place FROM dose"
       " UNION ALL SELECT file, CASE type WHEN 'au' THEN 'au' WHEN 'ref' THEN 'ref' END,"
       " CASE type WHEN 'au' THEN 1 WHEN 'ref' THEN 2 END FROM factorial")
def _(t):
    ph = F.col("pH")
    kind = F.col("type")
    doses = t.dose.select(
        "file", text.category(ph, PH_LABELS).alias("label"),
        text.category_rank(ph, ["low", "high"]).cast("int").alias("place"),
    )
    types = t.factorial.select(
        "file", text.category(kind, {"au": "au", "ref": "ref"}).alias("label"),
        text.category_rank(kind, ["au", "ref"]).cast("int").alias("place"),
    )
    return doses.unionByName(types)


@entry("X10_concentration", "SELECT file, c_Hg FROM dose_sheet", "c_Hg", 12)
def _(t):
    return dose_sheet(t.dose).select("file", "c_Hg")


@entry("X11_quantum_yield", "SELECT seq, y / nullif(quantity - 25, 0) * 0.54::DOUBLE AS qy FROM runs",
       "qy")
def _(t):
    rows = t.runs.select(
        "seq", F.col("y").alias("integral"), (F.col("quantity") - 25).alias("ref_integral")
    )
    return yields.quantum_yield(rows).select("seq", "qy")


@entry("X12_quenching_transform", "SELECT c_Hg, sample, pH, 1 / nullif(rel_integral, 0) - 1 AS"
       " quenching, log10(nullif(c_Hg, 0)) AS log_c FROM dose_resp", "c_Hg@12 quenching log_c")
def _(t):
    rows = quenching(dose_response(spectra.fluorescence(t.fu, FL_ORDER), t.dose))
    return rows.select("c_Hg", "sample", "pH", "quenching", "log_c")


@entry("X16_trimmed_number", "SELECT seq, intensity AS number, NULL::DOUBLE AS bad FROM fl", "number")
def _(t):
    padded = F.concat(F.lit("  "), F.col("intensity").cast("string"), F.lit(" "))
    return t.fl.select(
        "seq", text.trimmed_number(padded).alias("number"),
        text.trimmed_number(F.concat(padded, F.lit("nm"))).alias("bad"),
    )


@entry("X17_band_ratio", """
    SELECT file, int_600 / nullif(int_490, 0) AS int_600_490 FROM
      (SELECT file, avg(CASE WHEN wavelength BETWEEN 590 AND 610 THEN intensity END) AS int_600,
        avg(CASE WHEN wavelength BETWEEN 480 AND 500 THEN intensity END) AS int_490
       FROM fu GROUP BY file) x""", "int_600_490")
def _(t):
    bands = agg.band_means(t.fu.withColumn("one", F.lit(1.0)), yields.BANDS, ["file"], divisor="one")
    return bands.select("file", na.safe_div("int_600", "int_490").alias("int_600_490"))


@entry("X18_gated_target", "SELECT seq, CASE WHEN y > 5 THEN y * a ELSE 0 END AS target FROM runs",
       "target")
def _(t):
    return t.runs.select("seq", gated_product(F.col("y"), 5, F.col("a")).alias("target"))


@entry("X19_percent", "SELECT seq, discount * 100 AS percent FROM runs", "percent")
def _(t):
    return t.runs.select("seq", (F.col("discount") * 100).alias("percent"))


@entry("C1_clean_fluorescence", "SELECT f.file, f.seq, f.wavelength, f.intensity, s.type FROM flx f"
       " LEFT JOIN samples s ON f.file = s.file", "wavelength intensity")
def _(t):
    rows = spectra.with_samples(spectra.fluorescence(t.fl, FL_ORDER), t.samples)
    return rows.select("file", "seq", "wavelength", "intensity", "type")


@entry("C2_clean_absorbance", "SELECT a.file, a.o1, a.o2, a.o3, a.wavelength, a.absorbance, s.type"
       " FROM abx a LEFT JOIN samples s ON a.file = s.file", "wavelength absorbance")
def _(t):
    rows = spectra.with_samples(spectra.absorbance(t.ab, AB_ORDER), t.samples)
    return rows.select("file", "o1", "o2", "o3", "wavelength", "absorbance", "type")
