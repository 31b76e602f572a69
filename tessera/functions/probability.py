"""Tail probabilities of test statistics: plain functions, and Arrow-batched columns of them.

Statistics are one row a test, so these columns never run over a large table.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY, _EPS = 1e-300, 1e-15


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x): a series of P below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * _EPS:
            k += 1
            term *= x / k
            total += term
        return 1 - total * scale
    return scale * _fraction(lambda i: (-i * (i - a) if i else 1.0, x + 2 * i + 1 - a))


def _fraction(step) -> float:
    """A continued fraction a0 / (b0 + a1 / (b1 + ...)) by the modified Lentz method; ``step(i)`` gives (a, b)."""
    f, c, d = _TINY, _TINY, 0.0
    for i in range(100_000):
        a, b = step(i)
        d = 1 / ((b + a * d) or _TINY)
        c = (b + a / c) or _TINY
        f *= c * d
        if abs(c * d - 1) < _EPS:
            break
    return f


def beta_lower(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_lower(b, a, 1 - x)

    def step(i: int) -> tuple[float, float]:
        m = i // 2
        if i == 0:
            return 1.0, 1.0
        if i % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return scale / a * _fraction(step)


def chisq_p(x: float, df: float) -> float:
    """P(chi-square of df degrees >= x)."""
    return gamma_upper(df / 2, x / 2)


def f_p(f: float, df1: float, df2: float) -> float:
    """P(F >= f)."""
    return beta_lower(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def t_p(t: float, df: float) -> float:
    """Two-tailed P(|T| >= |t|)."""
    return beta_lower(df / 2, 0.5, df / (df + t * t))


def z_p(z: float) -> float:
    """Two-tailed P(|Z| >= |z|)."""
    return math.erfc(abs(z) / math.sqrt(2))


def ks_p(x: float) -> float:
    """Kolmogorov's tail 2 sum (-1)^(k-1) exp(-2 k^2 x^2); 1 near 0, where the series doesn't settle."""
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def r_p(r: float, n: float) -> float:
    """Two-tailed p of a correlation, by t."""
    return 0.0 if abs(r) >= 1 else t_p(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


_FUNCTIONS = {f.__name__: f for f in (normal_cdf, chisq_p, f_p, t_p, z_p, ks_p, r_p)}


def probability(name: str, *arguments: Column) -> Column:
    """One of the functions above over columns; null where an argument is null."""
    of = _FUNCTIONS[name]

    def run(frame: pd.DataFrame) -> pd.Series:
        rows = frame.itertuples(index=False, name=None)
        return pd.Series([None if any(pd.isna(v) for v in r) else of(*map(float, r)) for r in rows], dtype="float64")

    return F.pandas_udf(run, "double")(F.struct(*[a.cast("double").alias(f"a{i}") for i, a in enumerate(arguments)]))
