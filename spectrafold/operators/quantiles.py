"""Exact interpolated quantiles per group, for groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafold.operators.splits import cut_groups, split_points, whole_groups, with_slice
from spectrafold.session import settle

VALUES = 50_000  # different values between two split points, on average


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    every: int = VALUES,
    interpolate: bool = True,
) -> DataFrame:
    """One row per group with a column per entry of ``probabilities``.

    Quantiles interpolate between neighbouring values (0.5 of an even count is the mean of
    the two middle ones); without ``interpolate`` they are the value of rank ``ceil(p n)``.
    A NULL in the group makes its quantiles NULL.

    A group without split points is one aggregation, which holds its different values. In the
    others every row belongs to the slice between two split points: slices are counted (before any
    shuffle), the ranks sought are located in them, and only the rows of those slices are shuffled
    and ranked, each slice on its own. So no window or buffer holds a share of a group, however
    large it is.

    ``df`` is read once to choose the split points, right away, and once more if there are any, to
    count the slices; then to aggregate. When it is costly, hand in settled rows (``session.settle``).
    """
    names = [f"`{k}`" for k in keys]
    rows = df.selectExpr(*names, f"CAST(`{value}` AS DOUBLE) AS _v")
    points = split_points(rows, keys, ["_v"], every)
    groups = points.drop("_splits")
    light = _in_one_task(whole_groups(rows, groups, keys), names, probabilities, interpolate)
    if points.isEmpty():
        return light
    return light.unionByName(_selected(rows, points, keys, probabilities, interpolate))


def _in_one_task(
    rows: DataFrame, names: Sequence[str], probabilities: Mapping[str, float], interpolate: bool
) -> DataFrame:
    wanted = ", ".join(f"{float(p)}D" for p in probabilities.values())
    kind = "percentile_cont" if interpolate else "percentile_disc"
    found = rows.groupBy(*names).agg(
        F.expr(f"{kind}(array({wanted})) WITHIN GROUP (ORDER BY _v)").alias("_q"),
        F.expr("count(1) = count(_v)").alias("_whole"),
    )
    return found.selectExpr(
        *names, *[f"IF(_whole, _q[{i}], NULL) AS `{n}`" for i, n in enumerate(probabilities)]
    )


def placed_values(rows: DataFrame, points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the cut groups with their slice."""
    return with_slice(cut_groups(rows, points, keys), ["_v"])


def _selected(
    rows: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    probabilities: Mapping[str, float],
    interpolate: bool,
) -> DataFrame:
    """Quantiles of the cut groups: ranks are located in slices, then within them."""
    names = [f"`{k}`" for k in keys]
    group = ", ".join(names)
    values = placed_values(rows, points, keys)
    sizes = values.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_c"), F.expr("count_if(_v IS NULL)").alias("_unknown")
    )
    upto = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    sizes = sizes.selectExpr(
        *names, "_slice", "_c",
        f"sum(_c) OVER (PARTITION BY {group} ORDER BY _slice {upto}) AS _upto",
        f"sum(_c) OVER (PARTITION BY {group}) AS _n",
        f"sum(_unknown) OVER (PARTITION BY {group}) AS _unknown",
    )
    at = [
        f"((_n - 1) * {float(p)}D + 1)" if interpolate else f"greatest(ceil(_n * {float(p)}D), 1)"
        for p in probabilities.values()
    ]
    ranks = [f"{end}({spot})" for spot in at for end in ("floor", "ceil")]
    sought = " OR ".join(f"({rank} > _upto - _c AND {rank} <= _upto)" for rank in ranks)
    wanted = sizes.where(sought).selectExpr(
        *[f"`{k}` AS `_k_{k}`" for k in keys], "_slice AS _k__slice", "_upto - _c AS _before", "_n", "_unknown"
    )
    # Stored, so that its size is known and the rows outside are dropped where they are read.
    wanted = settle(wanted, "ranks")
    inside = cut_groups(values, wanted, [*keys, "_slice"])
    counts = inside.groupBy(*keys, "_slice", "_before", "_n", "_unknown", "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = counts.selectExpr(
        "*", f"_before + sum(_c) OVER (PARTITION BY {group}, _slice ORDER BY _v {upto}) AS _cum"
    )
    found = [
        F.expr(f"min(CASE WHEN _cum >= {end}({spot}) THEN _v END)").alias(f"_{end}{i}")
        for i, spot in enumerate(at) for end in ("floor", "ceil")
    ]
    picked = ranked.groupBy(*keys, "_n", "_unknown").agg(*found)
    out = []
    for i, (name, spot) in enumerate(zip(probabilities, at)):
        share = f"({spot} - floor({spot}))"
        between = f"IF({share} = 0, _floor{i}, (1 - {share}) * _floor{i} + {share} * _ceil{i})"
        out.append(f"IF(_unknown = 0, {between}, NULL) AS `{name}`")
    return picked.selectExpr(*names, *out)


def exact_median(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    name: str | None = None,
    every: int = VALUES,
) -> DataFrame:
    return exact_quantiles(df, keys, value, {name or value: 0.5}, every)
