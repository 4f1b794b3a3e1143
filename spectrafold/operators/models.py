"""Linear models from one distributed aggregate.

Every model needs only the means and co-moments of its terms and response. They are sums taken
about the means of each group (a large offset of a column cancels nothing), in two pre-aggregated
passes over the rows, whatever their number; what is left is one row per group with at most a
few hundred numbers, solved in place by ``mapInPandas``. The intercept follows from the means.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrafold.functions.strict import safe_div
from spectrafold.functions.tails import f_tail, t_tail
from spectrafold.operators.design import term_value
from spectrafold.operators.joins import left_join_null_safe
from spectrafold.session import ship

INTERCEPT = "(Intercept)"
# A term whose variance left after the earlier terms falls below this share is aliased.
ALIAS_SHARE = 1e-10
# Aggregates of one pass; with its keys it stays below spark.sql.codegen.maxFields (100).
TOGETHER = 80


def moments(df: DataFrame, y: str, terms: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows, means and co-moments of the terms and ``y``; rows with a NULL drop out.

    Two passes over ``df``: the means of each group, then plain sums of products of what is left
    after taking them off. So no offset cancels, and both passes are sums in generated code.
    """
    names = [f"_t{i}" for i in range(len(terms) + 1)]
    values = [*[term_value(t) for t in terms], F.col(y).cast("double")]
    rows = df.select(*by, *[v.alias(n) for v, n in zip(values, names)]).dropna(subset=names)
    centre = rows.groupBy(*by).agg(*[F.avg(n).alias(f"_c{n}") for n in names])
    centres = [f"_c{n}" for n in names]
    if by:
        rows = left_join_null_safe(rows, centre, by)
    else:
        one = centre.select(F.struct(*centres)).scalar()
        rows = rows.withColumn("_c", one).select(*names, *[F.col(f"_c.{c}") for c in centres])
    rows = rows.select(*by, *centres, *[(F.col(n) - F.col(f"_c{n}")).alias(n) for n in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = [F.count(F.lit(1)).cast("double"), *[F.max(c) for c in centres], *[F.sum(n) for n in names]]
    sums += [F.sum(F.col(a) * F.col(b)) for a, b in pairs]
    found = _aggregated(rows, [F.coalesce(s, F.lit(0.0)) for s in sums], by)

    # What the means left over by rounding add to the products is taken off again.
    size = len(names)
    at = lambda i: F.col("_sums")[i]
    n = F.greatest(at(0), F.lit(1.0))
    means = [at(1 + i) + at(1 + size + i) / n for i in range(size)]
    place = {name: 1 + size + i for i, name in enumerate(names)}
    shared = [
        (at(1 + 2 * size + k) - at(place[a]) * at(place[b]) / n) / n for k, (a, b) in enumerate(pairs)
    ]
    return found.select(*by, F.array(at(0), *means, *shared).alias("_moments"))


def _aggregated(rows: DataFrame, facts: Sequence[Column], by: Sequence[str]) -> DataFrame:
    """``_sums``: the aggregates ``facts`` per group as one array.

    Spark gives up generated code for aggregates of more columns than ``TOGETHER``, so more are
    taken in several passes.
    """
    found, parts = None, []
    for lo in range(0, len(facts), TOGETHER):
        name = f"_part{lo}"
        part = rows.groupBy(*by).agg(F.array(*facts[lo : lo + TOGETHER]).alias(name))
        parts.append(name)
        if found is None:
            found = part
        elif by:
            found = left_join_null_safe(found, part, by)
        else:
            found = found.withColumn(name, part.select(name).scalar())
    return found.select(*by, F.concat(*parts).alias("_sums"))


def _matrix(flat: Iterable[float], size: int) -> np.ndarray:
    full = np.zeros((size, size))
    full[np.triu_indices(size)] = np.asarray(list(flat), dtype=float)
    return full + np.triu(full, 1).T


class _Fit:
    """Least squares with an intercept. Column 0 is the intercept, column j the j-th term."""

    def __init__(self, flat: Sequence[float], size: int):
        self.n, self.mean = int(round(flat[0])), np.asarray(flat[1 : size + 1], dtype=float)
        centred = _matrix(flat[size + 1 :], size) * self.n
        self.xx, self.xy, self.yy = centred[:-1, :-1], centred[:-1, -1], float(centred[-1, -1])
        everything = range(size)
        self.kept = [0, *self._independent(everything)] if self.n else []
        self.df = self.n - len(self.kept)
        self.rss = self.residual(everything)
        self.ms = self.rss / self.df if self.df > 0 else math.nan
        own = [j - 1 for j in self.kept[1:]]
        block = self.xx[np.ix_(own, own)]
        slopes = np.linalg.solve(block, self.xy[own]) if own else np.zeros(0)
        inverse = np.linalg.inv(block) if own else np.zeros((0, 0))
        at = self.mean[:-1][own]
        if self.n:
            self.coef = np.append(self.mean[-1] - at @ slopes, slopes)
            self.variance = np.append(1.0 / self.n + at @ inverse @ at, np.diag(inverse))

    def _independent(self, columns: Iterable[int]) -> list[int]:
        """The terms that are not a combination of the intercept and earlier ones."""
        kept: list[int] = []
        for column in columns:
            j = column - 1
            if j < 0 or self.xx[j, j] <= 1e-18 * self.n * self.mean[j] ** 2:
                continue
            left = self.xx[j, j]
            if kept:
                cross = self.xx[kept, j]
                left -= cross @ np.linalg.solve(self.xx[np.ix_(kept, kept)], cross)
            if left > ALIAS_SHARE * self.xx[j, j]:
                kept.append(j)
        return [j + 1 for j in kept]

    def residual(self, columns: Iterable[int]) -> float:
        """Residual sum of squares of the intercept and these columns."""
        kept = [j - 1 for j in self._independent(columns)]
        if not kept:
            return self.yy
        b = np.linalg.solve(self.xx[np.ix_(kept, kept)], self.xy[kept])
        return max(self.yy - float(self.xy[kept] @ b), 0.0)

    def rank(self, columns: Iterable[int]) -> int:
        return len(self._independent(columns))


def _known(value: float | None) -> float | None:
    return None if value is None or math.isnan(value) else float(value)


def _tail_t(t: float, df: int) -> float | None:
    return t_tail(t, df) if df > 0 and not math.isnan(t) else None


def _tail_f(f: float, df1: int, df2: int) -> float | None:
    return f_tail(f, df1, df2) if df1 > 0 and df2 > 0 and not math.isnan(f) else None


def _coefficients(fit: _Fit, terms: Sequence[str]) -> Iterator[tuple]:
    place = {column: i for i, column in enumerate(fit.kept)}
    for column, term in enumerate([INTERCEPT, *terms]):
        if column not in place:
            yield term, None, None, None, None
            continue
        i = place[column]
        coef = float(fit.coef[i])
        se = math.sqrt(fit.ms * fit.variance[i]) if fit.df > 0 else math.nan
        t = coef / se if se > 0 else math.nan
        yield term, coef, _known(se), _known(t), _tail_t(t, fit.df)


def _quality(fit: _Fit, terms: Sequence[str]) -> Iterator[tuple]:
    if not fit.kept:
        return
    total = fit.yy
    model_df = len(fit.kept) - 1
    r2 = 1.0 - fit.rss / total if total > 0 else math.nan
    adjusted = 1.0 - (1.0 - r2) * (fit.n - 1) / fit.df if fit.df > 0 else math.nan
    sigma = math.sqrt(fit.ms) if fit.df > 0 else math.nan
    f = (total - fit.rss) / model_df / fit.ms if model_df > 0 and fit.ms > 0 else math.nan
    yield (
        fit.n, fit.df, model_df, _known(r2), _known(adjusted), _known(sigma), _known(f),
        _tail_f(f, model_df, fit.df),
    )


def _type_two(fit: _Fit, terms: Sequence[str]) -> Iterator[tuple]:
    """A term is tested given every term that does not contain it."""
    factors = [frozenset(), *[frozenset(t.split(":")) for t in terms]]
    for column, term in enumerate(terms, start=1):
        others = [j for j in range(len(factors)) if not factors[column] <= factors[j]]
        both = sorted([*others, column])
        df1 = fit.rank(both) - fit.rank(others)
        if df1 == 0:
            yield term, None, 0, None, None
            continue
        ss = max(fit.residual(others) - fit.residual(both), 0.0)
        f = ss / df1 / fit.ms if fit.df > 0 and fit.ms > 0 else math.nan
        yield term, ss, df1, _known(f), _tail_f(f, df1, fit.df)
    yield "Residuals", fit.rss, fit.df, None, None


def _solve(
    df: DataFrame, y: str, terms: Sequence[str], by: Sequence[str], report, columns: str
) -> DataFrame:
    sums = moments(df, y, terms, by)
    out = T.StructType([sums.schema[k] for k in by] + T._parse_datatype_string(columns).fields)
    names, terms, by = out.names, list(terms), list(by)
    ship(df.sparkSession)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record in batch.itertuples(index=False):
                fit = _Fit(record[-1], len(terms) + 1)
                rows += [(*record[:-1], *line) for line in report(fit, terms)]
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return sums.mapInPandas(solve, out)


def ols(df: DataFrame, y: str, terms: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Coefficients per group: term, coef, se, t, p. An aliased term has NULLs."""
    return _solve(
        df, y, terms, by, _coefficients,
        "term string, coef double, se double, t double, p double",
    )


def ols_summary(df: DataFrame, y: str, terms: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Quality of the fit per group."""
    return _solve(
        df, y, terms, by, _quality,
        "n long, df long, model_df long, r2 double, adj_r2 double, sigma double, f double,"
        " p double",
    )


def anova_type2(df: DataFrame, y: str, terms: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Type-II analysis of variance per group: term, ss, df, f, p, and the residual line."""
    return _solve(
        df, y, terms, by, _type_two, "term string, ss double, df long, f double, p double"
    )


def score(df: DataFrame, coefs: DataFrame, terms: Sequence[str], name: str) -> DataFrame:
    """Add the fitted polynomial over ``terms`` (a subset of the fitted ones is allowed).

    The coefficients are one struct that Spark computes once and hands to every task; each
    row is scored inside generated code. A term that was not fitted fails the query.
    """
    def coefficient(term: str) -> Column:
        hit = F.col("term") == term
        missing = F.raise_error(F.lit(f"term {term} is not in the model"))
        return F.when(F.max(hit), F.max(F.when(hit, F.col("coef")))).otherwise(missing)

    row = coefs.agg(*[coefficient(t).alias(f"c{i}") for i, t in enumerate(terms)])
    parts = []
    for i, term in enumerate(terms):
        factors = [] if term == INTERCEPT else [f"`{f}`" for f in term.split(":")]
        parts.append(" * ".join([f"_coef.c{i}", *factors]))
    scored = df.withColumn("_coef", row.select(F.struct("*")).scalar())
    return scored.withColumn(name, F.expr(" + ".join(parts))).drop("_coef")


def gated_product(gate: Column, threshold: float, factor: Column) -> Column:
    """``gate * factor`` where the gate is above the threshold, else 0; unknown stays NULL."""
    return F.when(gate > threshold, gate * factor).when(gate.isNotNull(), F.lit(0.0))


def origin_slope(df: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    """Slope of the least-squares line through the origin per group."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return pairs.groupBy(*keys).agg(
        safe_div(F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) * F.col(x))).alias("slope"),
        F.count(F.lit(1)).alias("n"),
    )
