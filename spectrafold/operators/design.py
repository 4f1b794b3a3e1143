"""Experimental designs: coded levels, level grids, model terms, top-k."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrafold.functions.strict import safe_div, strict_avg, strict_max, strict_min
from spectrafold.operators.joins import left_join_null_safe


def encode_levels(
    df: DataFrame, columns: Mapping[str, str], keys: Sequence[str] = ()
) -> DataFrame:
    """Set ``2 (x - mean) / (max - min)`` under the given names; a constant column is NULL.

    The statistics are one aggregate row (per key), attached as a scalar or by a join, so
    no window ever gathers the table.
    """
    facts = []
    for column in columns:
        facts += [
            strict_avg(column).alias(f"_avg_{column}"),
            strict_max(column).alias(f"_max_{column}"),
            strict_min(column).alias(f"_min_{column}"),
        ]
    if keys:
        joined = left_join_null_safe(df, df.groupBy(*keys).agg(*facts), keys)

        def fact(kind: str, column: str) -> Column:
            return F.col(f"_{kind}_{column}")
    else:
        row = df.agg(*facts).select(F.struct("*").alias("_facts"))
        joined = df.withColumn("_facts", row.scalar())

        def fact(kind: str, column: str) -> Column:
            return F.col("_facts")[f"_{kind}_{column}"]

    coded = {
        name: safe_div(
            2 * (F.col(column) - fact("avg", column)), fact("max", column) - fact("min", column)
        )
        for column, name in columns.items()
    }
    kept = [c for c in df.columns if c not in coded]
    return joined.select(*kept, *[c.alias(name) for name, c in coded.items()])


def level_grid(
    spark: SparkSession,
    names: Sequence[str],
    lo: float = -1.0,
    hi: float = 1.0,
    step: float = 0.05,
    levels: Mapping[str, Sequence[float]] | None = None,
) -> DataFrame:
    """Every combination of the levels ``lo, lo + step, .., hi``; the first name runs fastest.

    The levels are decoded from a row number, so the grid is generated in parallel. ``levels``
    keeps only those of a name that are listed (levels of the grid); no other row is made.
    """
    count = round((hi - lo) / step) + 1
    size, columns = 1, []
    for name in names:
        wanted = [round((v - lo) / step) for v in (levels or {}).get(name, ())] or list(range(count))
        place = F.expr(f"pmod(id div {size}, {len(wanted)})")
        if len(wanted) < count:
            place = F.array(*[F.lit(w) for w in wanted])[place.cast("int")]
        columns.append((F.lit(float(lo)) + place * F.lit(float(step))).alias(name))
        size *= len(wanted)
    return spark.range(size).select(*columns)


def two_way(factors: Sequence[str], drop: Sequence[str] = ()) -> list[str]:
    """Main effects and all products of two factors, without the terms in ``drop``."""
    terms = [*factors, *[f"{a}:{b}" for a, b in combinations(factors, 2)]]
    gone = {frozenset(t.split(":")) for t in drop}
    return [t for t in terms if frozenset(t.split(":")) not in gone]


def term_value(term: str) -> Column:
    """The product of the factors of ``term``; ``(Intercept)`` is 1."""
    if term == "(Intercept)":
        return F.lit(1.0)
    value = None
    for factor in term.split(":"):
        column = F.col(factor).cast("double")
        value = column if value is None else value * column
    return value


def design_matrix(df: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Add a column per product term, named like ``a:b``."""
    return df.withColumns({t: term_value(t) for t in terms if ":" in t})


def top_k(df: DataFrame, score: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    """The ``k`` rows with the largest score; NULL scores never count."""
    order = [F.col(score).desc(), *[F.col(c).asc() for c in ties]]
    return df.where(F.col(score).isNotNull()).orderBy(*order).limit(k)


def band(df: DataFrame, z: str, bands: int = 10, name: str = "band") -> DataFrame:
    """Number the equal-width bands of ``z`` from 1, about ``bands`` of them.

    The width is 1, 2, 5 or 10 times a power of ten, whichever lies closest to the range
    divided by ``bands``; band borders are multiples of the width.
    """
    cell = (F.max(z) - F.min(z)) / F.lit(float(bands))
    facts = df.agg(F.min(z).alias("lo"), cell.alias("cell")).withColumn(
        "power", F.pow(F.lit(10.0), F.floor(F.log10(F.nullif("cell", F.lit(0.0)))))
    )
    ratio = F.col("cell") / F.col("power")
    # The unit changes at the ratios 1.4, 2.8 and 7.
    unit = F.when(ratio > 7, 10.0).when(ratio > 2.8, 5.0).when(ratio > 1.4, 2.0).otherwise(1.0)
    row = facts.select(F.struct("lo", (unit * F.col("power")).alias("width")).alias("_band"))
    first = F.floor(F.col("_band")["lo"] / F.col("_band")["width"])
    place = F.floor(F.col(z) / F.col("_band")["width"]) - first + 1
    number = F.when(F.col("_band")["width"].isNull(), F.lit(1)).otherwise(place).cast("long")
    return df.withColumn("_band", row.scalar()).withColumn(name, number).drop("_band")
