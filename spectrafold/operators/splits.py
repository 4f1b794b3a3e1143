"""Split points that cut long groups into slices of bounded size.

Operators that must see a group in order (running median, exact quantiles) take a group whole
unless it has split points. Split points are rows of the group itself, chosen by a hash of their
place in the order: one in ``every`` on average. So a slice between two of them has ``every``
different places on average, whatever the values are (an outlier or a crowded stretch moves
nothing), and exceeds twenty times that with a probability of e^-20. Choosing them is a
filter, so nothing but the few chosen rows is aggregated or shuffled.

A group with a single chosen row stays whole: otherwise a few of a billion small groups would be
cut for nothing. A group of more than twenty times ``every`` places stays whole with a
probability of 4e-8.

The table of split points grows with the rows (one in ``every``); no join with it is forced, and
Spark knows its size because it is stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafold.session import settle


def _place(order: Sequence[str]) -> str:
    if len(order) == 1:
        return f"`{order[0]}`"
    return "named_struct({})".format(", ".join(f"'p{i}', `{c}`" for i, c in enumerate(order)))


def split_points(df: DataFrame, keys: Sequence[str], order: Sequence[str], every: int) -> DataFrame:
    """Groups that are cut: their ``keys`` (as ``_k_key``) and ``_splits``, sorted places in ``order``.

    The result is stored. Without any it is an empty relation the optimizer knows of: it then
    removes from the plan whatever concerns cut groups.
    """
    names = [f"`{k}`" for k in keys]
    hashed = ", ".join([*names, *[f"`{c}`" for c in order]])
    chosen = df.where(f"pmod(xxhash64({hashed}), {every}) = 0").selectExpr(*names, f"{_place(order)} AS __place")
    points = chosen.groupBy(*keys).agg(F.sort_array(F.collect_set("__place")).alias("_splits"))
    points = points.selectExpr(*[f"`{k}` AS `_k_{k}`" for k in keys], "_splits").where("size(_splits) > 1")
    points = settle(points, "splits")
    return points.limit(0) if points.isEmpty() else points


def _matched(df: DataFrame, points: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    # Null-safe: the NULL group is a group like any other.
    match = F.expr(" AND ".join(f"`{k}` <=> `_k_{k}`" for k in keys))
    return df.join(points, match, how)


def whole_groups(df: DataFrame, points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the groups that are not cut."""
    return _matched(df, points, keys, "left_anti")


def cut_groups(df: DataFrame, points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the groups that are cut, with the other columns of ``points``."""
    return _matched(df, points, keys, "inner").drop(*[f"_k_{k}" for k in keys])


def rows_of_cut_groups(df: DataFrame, points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the groups that are cut, and nothing else."""
    return _matched(df, points, keys, "left_semi")


def with_slice(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``_slice`` instead of ``_splits``: how many of them are at or before the row's place.

    Found by halving steps inside one expression. As a chain of columns they would double with each step
    wherever the optimizer follows a slice number to where it comes from.
    """
    kept = [f"`{c}`" for c in df.columns if c != "_splits"]
    steps = "sequence(CAST(floor(log2(size(_splits))) AS INT), 0, -1)"
    seen = f"get(_splits, s + shiftleft(1, b) - 1) <= {_place(order)}"
    search = f"aggregate({steps}, 0, (s, b) -> s + IF({seen}, shiftleft(1, b), 0))"
    return df.selectExpr(*kept, f"{search} AS _slice")
