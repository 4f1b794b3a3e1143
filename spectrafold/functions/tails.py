"""Upper tail of the F distribution (and with it two-sided t), for p-values of a few terms."""

from __future__ import annotations

import math


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated by Lentz's method.

    An error if it does not settle.
    """
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    result = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            result *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return result
    raise ArithmeticError(f"no convergence for a={a}, b={b}, x={x}")


def _correction(z: float) -> float:
    """What Stirling's formula leaves of lgamma, for z of at least 1e3."""
    return 1 / (12 * z) - 1 / (360 * z**3)


def _log_beta(a: float, b: float) -> float:
    """lgamma(a) + lgamma(b) - lgamma(a + b), without the difference of large numbers."""
    a, b = min(a, b), max(a, b)
    if b < 1e3:
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    if a < 1e3:
        change = _correction(b) - _correction(a + b)
        return math.lgamma(a) + a - a * math.log(a + b) - (b - 0.5) * math.log1p(a / b) + change
    change = _correction(a) + _correction(b) - _correction(a + b)
    return (
        0.5 * math.log(2 * math.pi) - (a - 0.5) * math.log1p(b / a) - b * math.log1p(a / b)
        - 0.5 * math.log(b) + change
    )


def incomplete_beta(a: float, b: float, x: float, rest: float | None = None) -> float:
    """Regularised incomplete beta function I_x(a, b). ``rest`` is 1 - x where that is known exactly."""
    rest = 1.0 - x if rest is None else rest
    if x <= 0.0 or rest <= 0.0:
        return 0.0 if x <= 0.0 else 1.0
    log_x = math.log(x) if x < 0.5 else math.log1p(-rest)
    log_rest = math.log(rest) if rest < 0.5 else math.log1p(-x)
    front = math.exp(a * log_x + b * log_rest - _log_beta(a, b))
    # Very close to 1 the first fraction subtracts nearly equal numbers; its counterpart does not.
    close = a > 1e6 and a * rest < b + 30.0
    if rest > (b + 1.0) / (a + b + 2.0) and not close:
        return front * _fraction(a, b, x) / a
    return 1.0 - front * _fraction(b, a, rest) / b


def f_tail(f: float, df1: float, df2: float) -> float:
    """P(F > f) with ``df1`` and ``df2`` degrees of freedom."""
    if math.isinf(f):
        return 0.0
    whole = df2 + df1 * f
    return incomplete_beta(df2 / 2.0, df1 / 2.0, df2 / whole, df1 * f / whole)


def t_tail(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    return f_tail(t * t, 1.0, df)
