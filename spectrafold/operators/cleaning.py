"""Baseline correction and smoothing of spectra held in one long table.

A spectrum is the set of rows that share ``key``; its order is always explicit. An ordinary
spectrum is cleaned in one task after one shuffle on ``key``. A long one is cut at split points, every
``slice_rows`` rows on average, so that its rows spread over as many tasks as it needs. The split
points are places in the explicit order, tie-breaks and signal included, so neither an outlying
wavelength nor thousands of equal ones make a slice longer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafold.functions.numeric import med3, median_of
from spectrafold.functions.strict import strict_avg_where
from spectrafold.operators.joins import left_join_null_safe
from spectrafold.operators.splits import cut_groups, rows_of_cut_groups, split_points, whole_groups, with_slice
from spectrafold.session import settle

POINTS = 1_000_000  # of a slice, on average


def baseline_correct(
    df: DataFrame, lo: float, hi: float, signal: str = "intensity", key: str = "file"
) -> DataFrame:
    """Subtract from each spectrum its mean signal in the open window ``(lo, hi)``.

    A spectrum without a point in the window gets NULL. The means are pre-aggregated before
    any shuffle, then joined back.
    """
    inside = (F.col("wavelength") > lo) & (F.col("wavelength") < hi)
    offsets = df.groupBy(key).agg(strict_avg_where(inside, F.col(signal)).alias("_offset"))
    return (
        left_join_null_safe(df, offsets, [key])
        .withColumn(signal, F.col(signal) - F.col("_offset"))
        .select(*df.columns)
    )


def running_median(
    df: DataFrame,
    k: int = 3,
    signal: str = "intensity",
    key: str = "file",
    order: Sequence[str] = ("wavelength",),
    slice_rows: int = POINTS,
    inventory: DataFrame | None = None,
) -> DataFrame:
    """Centred running median of odd width ``k``, with Tukey's rule at both ends.

    ``inventory`` as made by ``spectrum_inventory``; without it, it is made from ``df``.
    """
    return _clean(df, k, None, signal, key, order, slice_rows, inventory)


def clean_spectra(
    df: DataFrame,
    signal: str = "intensity",
    key: str = "file",
    order: Sequence[str] = ("wavelength",),
    baseline: tuple[float, float] = (850.0, 900.0),
    k: int = 5,
    slice_rows: int = POINTS,
    inventory: DataFrame | None = None,
) -> DataFrame:
    """Baseline correction followed by the running median, sharing one shuffle.

    The baseline is a constant shift, with which the median and its end rule commute.
    ``inventory`` as made by ``spectrum_inventory`` with the same baseline; without it, it is made from
    ``df``, which is then read once more for the columns of the order.
    """
    return _clean(df, k, baseline, signal, key, order, slice_rows, inventory)


def spectrum_inventory(
    df: DataFrame,
    signal: str = "intensity",
    key: str = "file",
    order: Sequence[str] = ("wavelength",),
    baseline: tuple[float, float] | None = None,
    slice_rows: int = POINTS,
) -> DataFrame:
    """Split points of the spectra that are cut, and their mean signal in the baseline window.

    It can be stored beside a landed table and handed to every cleaning of that table, of a
    subset of its spectra too; building a query then starts no job.
    """
    rows = df.withColumn(signal, F.col(signal).cast("double"))
    points = split_points(rows, [key], _full_order(order, signal), slice_rows)
    if baseline is None:
        return points.withColumn("_offset", F.lit(0.0))
    inside = "wavelength > {} AND wavelength < {}".format(*baseline)
    mean = F.expr(_window_mean(inside, signal=f"`{signal}`"))
    offsets = rows_of_cut_groups(rows, points, [key]).groupBy(key).agg(mean.alias("_offset"))
    known = points.join(offsets, F.col(f"_k_{key}").eqNullSafe(F.col(key))).drop(key)
    return known if not points.take(1) else settle(known, "inventory")


def _full_order(order: Sequence[str], signal: str) -> list[str]:
    """``order`` with the signal as its last tie-break."""
    return [*order, *([] if signal in order else [signal])]


def _clean(
    df: DataFrame,
    k: int,
    baseline: tuple[float, float] | None,
    signal: str,
    key: str,
    order: Sequence[str],
    slice_rows: int,
    inventory: DataFrame | None,
) -> DataFrame:
    if k < 1 or k % 2 == 0:
        raise ValueError("the width of a running median must be odd")
    if inventory is None:
        inventory = spectrum_inventory(df, signal, key, order, baseline, slice_rows)
    columns = [f"`{c}`" for c in df.columns]
    kept = [c for c in columns if c != f"`{signal}`"]
    rows = df.selectExpr(*kept, f"CAST(`{signal}` AS DOUBLE) AS _x")
    order = ["_x" if c == signal else c for c in _full_order(order, signal)]
    inside = "wavelength > {} AND wavelength < {}".format(*baseline) if baseline else "FALSE"
    value = "_y - _offset" if baseline else "_y"
    result = [value + f" AS `{signal}`" if c == f"`{signal}`" else c for c in columns]

    # Whole spectra: the mean comes from the window the smoother sorts for anyway.
    extra = [_window_mean(inside, over=_everything([key], order)) + " AS _offset"]
    whole = whole_groups(rows, inventory.select(f"_k_{key}"), [key])
    whole = _lined_up(whole, [key], order, k, extra if baseline else [])
    smooth = _with_ends(whole, [key], order, k).selectExpr(*result)

    # Cut spectra: medians inside a slice are final; the thin rims of all slices, put
    # together, hold every neighbour of the points at the slice borders.
    sliced = with_slice(cut_groups(rows, inventory, [key]), order)
    # Dealt by both: a join on the key alone must not leave a spectrum in one task.
    sliced = sliced.repartition(F.col(key), F.col("_slice"))
    lined = _lined_up(sliced, [key, "_slice"], order, k)
    half = k // 2
    reach = max(half + 3, 3 * half - 1)
    interior = f"_pos > {half} AND _tail > {half}"
    inner = lined.where(interior).selectExpr("*", f"{_median(half)} AS _y")
    rim = lined.where(f"_pos <= {reach} OR _tail <= {reach}").selectExpr(
        *[f"`{c}`" for c in sliced.columns], f"NOT ({interior}) AS _border"
    )
    borders = _with_ends(_lined_up(rim, [key], order, k), [key], order, k).where("_border")

    inner, borders = inner.selectExpr(*result), borders.selectExpr(*result)
    return smooth.unionByName(inner).unionByName(borders)


def _window_mean(inside: str, over: str = "", signal: str = "_x") -> str:
    """Mean of the points inside the window; NULL if there are none or one is NULL."""
    here = f"CASE WHEN {inside} THEN {signal} END"
    rows, known = f"count(CASE WHEN {inside} THEN 1 END)", f"count({here})"
    return f"CASE WHEN {rows} {over} = {known} {over} THEN avg({here}) {over} END"


def _by(parts: Sequence[str], order: Sequence[str]) -> str:
    names = ", ".join(f"`{c}`" for c in parts)
    return f"PARTITION BY {names} ORDER BY " + ", ".join(f"`{c}`" for c in order)


def _everything(parts: Sequence[str], order: Sequence[str]) -> str:
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    return f"OVER ({_by(parts, order)} {frame})"


def _around(column: str, reach: int, by: str) -> list[str]:
    """Neighbours of ``column``: ``column_p1`` is the previous row, ``column_n1`` the next."""
    found = []
    for i in range(1, reach + 1):
        found.append(f"lag({column}, {i}) OVER ({by}) AS {column}_p{i}")
        found.append(f"lead({column}, {i}) OVER ({by}) AS {column}_n{i}")
    return found


def _near(column: str, offset: int) -> str:
    if offset == 0:
        return column
    return f"{column}_{'n' if offset > 0 else 'p'}{abs(offset)}"


def _median(half: int) -> str:
    return median_of([_near("_x", i) for i in range(-half, half + 1)])


def _lined_up(
    df: DataFrame, parts: Sequence[str], order: Sequence[str], k: int, extra: Sequence[str] = ()
) -> DataFrame:
    """Position from either end and the neighbours of each point within half a width."""
    by = _by(parts, order)
    size = f"count(1) {_everything(parts, order)}"
    return df.selectExpr(
        "*", f"row_number() OVER ({by}) AS _pos", f"{size} AS _size",
        *_around("_x", k // 2, by), *extra,
    ).selectExpr("*", "_size - _pos + 1 AS _tail")


def _with_ends(df: DataFrame, parts: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """Add ``_y``: the running median, with the end rule near both ends.

    Point 2 takes the median of the first three, point 3 of the first five, and so on, over
    a series whose outer ``h`` points are raw and whose others are medians. The first point
    is the median of itself, point 2 and the line through points 2 and 3. A spectrum
    shorter than ``k`` uses the largest odd width that fits.
    """
    by = _by(parts, order)
    series, around, seconds, value = [], [], [], "_x"
    for h in range(1, k // 2 + 1):
        outer = f"_pos <= {h} OR _tail <= {h}"
        series.append(f"CASE WHEN {outer} THEN _x ELSE {_median(h)} END AS _s{h}")
        around += _around(f"_s{h}", max(h - 1, 4 if h >= 3 else 2), by)
        for end, towards in (("head", 1), ("tail", -1)):
            for place in (2, 3):
                seconds.append(f"{_settled(h, place, 1, towards)} AS _{end}{h}_{place}")
        value = f"CASE WHEN _size > {2 * h} THEN {_end_rule(h)} ELSE {value} END"
    return (
        df.selectExpr("*", *series)
        .selectExpr("*", *around)
        .selectExpr("*", *seconds)
        .selectExpr("*", f"{value} AS _y")
    )


def _settled(h: int, place: int, seen_from: int, towards: int) -> str:
    """Point ``place`` counted from an end, as seen from point ``seen_from``."""
    reached = range(1, 2 * place) if place <= h else [place]
    return median_of([_near(f"_s{h}", (j - seen_from) * towards) for j in reached])


def _outermost(first: str, second: str, third: str) -> str:
    line = f"(3 * {second} - 2 * {third})"
    return f"CASE WHEN {first} + {line} IS NOT NULL THEN {med3(first, second, line)} END"


def _end_rule(h: int) -> str:
    places = []
    for count_from, end, towards in (("_pos", "head", 1), ("_tail", "tail", -1)):
        second, third = f"_{end}{h}_2", f"_{end}{h}_3"
        if h == 1 and towards < 0:
            # Of three points the head is settled before the tail looks at it.
            head = _outermost(third, second, "_x")
            third = f"(CASE WHEN _size = 3 THEN {head} ELSE {third} END)"
        places.append(f"WHEN {count_from} = 1 THEN {_outermost('_x', second, third)}")
        for i in range(2, h + 1):
            places.append(f"WHEN {count_from} = {i} THEN {_settled(h, i, i, towards)}")
    return f"CASE {' '.join(places)} ELSE _s{h} END"
