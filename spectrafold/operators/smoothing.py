"""Local regression of one column on another, in work per row that does not grow with the places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafold.operators.joins import left_join_null_safe
from spectrafold.operators.splits import cut_groups, split_points, whole_groups, with_slice
from spectrafold.session import settle

VALUES = 5_000  # different x between two split points, on average
DEGREE = 2  # of the local polynomial
TRICUBE = ((0, 1), (3, -3), (6, 3), (9, -1))  # (1 - |u|^3)^3: power of |u|, coefficient
POWERS = 2 * DEGREE + 9  # highest power of u in a weighted sum


def local_regression(
    df: DataFrame, x: str, y: str, keys: Sequence[str], span: float = 0.75, points: int = 80, every: int = VALUES
) -> DataFrame:
    """Local quadratic fit at ``points`` equally spaced places over the range of ``x``.

    Each place uses the ``ceil(span n)`` rows of its group nearest to it, with tricube weights. A
    place with fewer than three distinct weighted ``x``, or a window without width, gives NULL.

    The windows' ends and middles cut the range of a group into cells, three for a place at most. Inside a
    cell every weight is a polynomial of x, so a row is placed in its cell by a binary search and
    counts in that cell's moments about its centre, which are pre-aggregated before they are shuffled. A
    place puts the moments of its cells together. A cell with one different x is weighted directly.
    Sums keep some twelve digits; where a fit extrapolates from rows crowded at the rim of its window,
    five of them are left in the result.

    ``df`` is read several times; when it is costly, hand in settled rows (``session.settle``).
    """
    rows = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    rows = rows.dropna(subset=["_x", "_y"])
    spots = settle(window_widths(rows, keys, span, points, every), "windows")
    # Settled: a filter on a cell's bounds would be expanded through every step of the binary search.
    cells = settle(_cell_moments(rows, spots, keys), "cells")

    inside = left_join_null_safe(spots.where("_h > 0"), cells, keys).where("_lo >= _at - _h AND _lo < _at + _h")
    sums = _weighted(inside).groupBy(*keys, "_place").agg(
        *[F.sum(f"_w{k}").alias(f"_s{k}") for k in range(2 * DEGREE + 1)],
        *[F.sum(f"_v{k}").alias(f"_t{k}") for k in range(DEGREE + 1)],
    )
    s0, s1, s2, s3, s4 = (F.col(f"_s{i}") for i in range(5))
    t0, t1, t2 = (F.col(f"_t{i}") for i in range(3))
    minor0, minor1, minor2 = s2 * s4 - s3 * s3, s1 * s4 - s2 * s3, s1 * s3 - s2 * s2
    whole = s0 * minor0 - s1 * minor1 + s2 * minor2
    fitted = (t0 * minor0 - t1 * minor1 + t2 * minor2) / F.nullif(whole, F.lit(0.0))
    solvable = whole > F.lit(1e-9) * s0 * s0 * s0
    return left_join_null_safe(spots, sums, [*keys, "_place"]).select(
        *keys, F.col("_place").alias("place"), F.col("_at").alias(x),
        F.when(solvable, fitted).alias("fitted"),
    )


def window_widths(rows: DataFrame, keys: Sequence[str], span: float, points: int, every: int) -> DataFrame:
    """Keys, _place, _at and _h: distance of the ``ceil(span n)``-th nearest ``_x``.

    In a group without split points the distances of its different values are counted. In the others
    the slices between split points are: each slice has a least and a greatest distance from a place,
    which bound the width looked for, and only the values of the few slices that reach
    between the bounds are ranked.
    """
    spot = [*keys, "_place"]
    names = [f"`{k}`" for k in keys]
    group = ", ".join([*names, "_place"])
    upto = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    ranges = rows.groupBy(*keys).agg(
        F.min("_x").alias("_lo"), F.max("_x").alias("_hi"),
        F.ceil(F.count(F.lit(1)) * F.lit(float(span))).alias("_q"),
    )
    spots = ranges.selectExpr("*", f"explode(sequence(0, {points - 1})) AS _place").selectExpr(
        *names, "_place", f"_lo + (_hi - _lo) * _place / {max(points - 1, 1)} AS _at", "greatest(_q, 1) AS _q"
    )

    def nearest(values: DataFrame) -> DataFrame:
        """The distance at which ``_n`` adds up to ``_q``."""
        far = values.selectExpr(*names, "_place", "_at", "_q", "_n", "abs(_x - _at) AS _d")
        far = far.selectExpr("*", f"sum(_n) OVER (PARTITION BY {group} ORDER BY _d {upto}) AS _cum")
        return far.groupBy(*spot, "_at").agg(F.expr("min(CASE WHEN _cum >= _q THEN _d END)").alias("_h"))

    splits = split_points(rows.select(*keys, "_x"), keys, ["_x"], every)
    whole = whole_groups(rows, splits.drop("_splits"), keys).groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_n"))
    widths = nearest(_met(whole, spots, keys))
    if splits.isEmpty():
        return widths

    sliced = with_slice(cut_groups(rows.select(*keys, "_x"), splits, keys), ["_x"])
    slices = sliced.groupBy(*keys, "_slice").agg(
        F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count(F.lit(1)).alias("_n")
    )
    bounds = _met(slices, spots, keys).selectExpr(
        "*", "greatest(_lo - _at, _at - _hi, 0D) AS _least", "greatest(abs(_lo - _at), abs(_hi - _at)) AS _most"
    )
    bounds = bounds.selectExpr("*", *[
        f"sum(_n) OVER (PARTITION BY {group} ORDER BY {end} {upto}) AS _by{end}" for end in ("_least", "_most")
    ]).selectExpr("*", *[
        f"min(CASE WHEN _by{end} >= _q THEN {end} END) OVER (PARTITION BY {group}) AS _bound{end}"
        for end in ("_least", "_most")
    ]).selectExpr(
        "*", f"sum(CASE WHEN _most < _bound_least THEN _n ELSE 0 END) OVER (PARTITION BY {group}) AS _before"
    )
    wanted = bounds.where("_least <= _bound_most AND _most >= _bound_least").selectExpr(
        *[f"`{k}` AS `_k_{k}`" for k in keys], "_slice AS _k__slice", "_place", "_at", "_q - _before AS _q"
    )
    values = sliced.groupBy(*keys, "_slice", "_x").agg(F.count(F.lit(1)).alias("_n"))
    return widths.unionByName(nearest(cut_groups(values, settle(wanted, "rims"), [*keys, "_slice"])))


def _met(left: DataFrame, spots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` with each place of their group."""
    renamed = spots.selectExpr(*[f"`{k}` AS `_k_{k}`" for k in keys], "_place", "_at", "_q")
    if not keys:
        return left.join(renamed)
    return cut_groups(left, renamed, keys)


def _cell_moments(rows: DataFrame, spots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per cell: its lower bound, centre, half width, outermost x, and moments of z (``_z``) and of y z (``_yz``).

    z is x about the cell's centre, in units of half its width.
    """
    ends = spots.selectExpr(*[f"`{k}`" for k in keys], "explode(array(_at - _h, _at, _at + _h)) AS _end")
    edges = ends.groupBy(*keys).agg(F.sort_array(F.collect_set("_end")).alias("_edges"))
    placed = left_join_null_safe(rows, edges, keys).withColumn("_splits", F.col("_edges"))
    placed = with_slice(placed, ["_x"]).selectExpr(
        *[f"`{k}`" for k in keys], "_x", "_y", "get(_edges, _slice - 1) AS _lo", "get(_edges, _slice) AS _hi"
    )
    placed = placed.selectExpr(
        "*", "coalesce((_lo + _hi) / 2, _lo) AS _centre", "coalesce((_hi - _lo) / 2, 0D) AS _half"
    ).selectExpr("*", "coalesce((_x - _centre) / nullif(_half, 0D), 0D) AS _z0")
    return placed.groupBy(*keys, "_lo", "_centre", "_half").agg(
        F.min("_x").alias("_first"), F.max("_x").alias("_last"),
        F.array(*[F.sum(F.expr(f"pow(_z0, {j})")) for j in range(POWERS + 1)]).alias("_z"),
        F.array(*[F.sum(F.expr(f"pow(_z0, {j}) * _y")) for j in range(POWERS - DEGREE + 1)]).alias("_yz"),
    )


def _weighted(inside: DataFrame) -> DataFrame:
    """What a cell adds to the weighted sums of u^k (``_wk``) and y u^k (``_vk``) of a place.

    u = a + b z is the distance from the place in units of the window's width.
    """
    def of_powers(moments: str, highest: int) -> str:
        """Sums of u^p for p from 0, from those of z^j: binomial terms, none larger than the rows counted."""
        term = (
            "factorial(p) / factorial(j) / factorial(p - j) * pow(_a, p - j) * pow(_b, j) * "
            f"element_at({moments}, j + 1)"
        )
        inner = f"aggregate(sequence(0, p), 0D, (s, j) -> s + {term})"
        return f"IF(_first < _last, transform(sequence(0, {highest}), p -> {inner}), NULL)"

    def added(k: int, moments: str, alone: str) -> str:
        parts = [f"{c} * {'_sign * ' if p % 2 else ''}{moments}[{k + p}]" for p, c in TRICUBE]
        return f"coalesce({' + '.join(parts)}, _weight * pow(_u, {k}) * {alone}[0])"

    base = inside.selectExpr(
        "*", "(_centre - _at) / _h AS _a", "_half / _h AS _b", "IF(_lo >= _at, 1D, -1D) AS _sign",
        "(_first - _at) / _h AS _u",
    ).selectExpr(
        "*", f"{of_powers('_z', POWERS)} AS _uz", f"{of_powers('_yz', POWERS - DEGREE)} AS _uy",
        "pow(1 - pow(least(abs(_u), 1D), 3), 3) AS _weight",
    )
    return base.selectExpr(
        "*", *[f"{added(k, '_uz', '_z')} AS _w{k}" for k in range(2 * DEGREE + 1)],
        *[f"{added(k, '_uy', '_yz')} AS _v{k}" for k in range(DEGREE + 1)],
    )
