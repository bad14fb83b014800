"""Distribution tail probabilities for the two-sample tests.

The statistics themselves are computed by Spark; these p-value helpers
run on already-aggregated rows (one per feature / test) through a pandas
UDF. No scipy in the runtime: regularised incomplete gamma and beta are
evaluated with the standard series / continued-fraction expansions.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_EPS = 1e-15
_FPMIN = 1e-300


def _gammainc_lower_series(a: float, x: float) -> float:
    s = term = 1.0 / a
    n = a
    for _ in range(10_000):
        n += 1
        term *= x / n
        s += term
        if abs(term) < abs(s) * _EPS:
            break
    return s * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _gammainc_upper_cf(a: float, x: float) -> float:
    b = x + 1 - a
    c = 1 / _FPMIN
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = _FPMIN if abs(d) < _FPMIN else d
        c = b + an / c
        c = _FPMIN if abs(c) < _FPMIN else c
        d = 1 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < _EPS:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        return 1.0 - _gammainc_lower_series(a, x)
    return _gammainc_upper_cf(a, x)


def chi2_sf(x: float, df: float) -> float:
    if x is None or df is None or df <= 0 or (isinstance(x, float) and math.isnan(x)):
        return float("nan")
    return gammaincc(df / 2.0, x / 2.0)


def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1, a - 1
    c, d = 1.0, 1 - qab * x / qap
    d = _FPMIN if abs(d) < _FPMIN else d
    d = 1 / d
    h = d
    for m in range(1, 10_000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1 + aa * d
        d = _FPMIN if abs(d) < _FPMIN else d
        c = 1 + aa / c
        c = _FPMIN if abs(c) < _FPMIN else c
        d = 1 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1 + aa * d
        d = _FPMIN if abs(d) < _FPMIN else d
        c = 1 + aa / c
        c = _FPMIN if abs(c) < _FPMIN else c
        d = 1 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < _EPS:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1 - math.exp(lbt) * _betacf(b, a, 1 - x) / b


def t_two_sided_p(t: float, df: float) -> float:
    if t is None or df is None or df <= 0 or math.isnan(t):
        return float("nan")
    return betainc(df / 2.0, 0.5, df / (df + t * t))


@F.pandas_udf(DoubleType())
def chi2_sf_udf(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(a, b) for a, b in zip(x, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_p_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_p(a, b) for a, b in zip(t, df)], dtype="float64")


def ks_pvalue(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic two-sample KS p-value Q(sqrt(nm/(n+m)) * D) as a column
    expression: 2 * sum_k (-1)^(k-1) exp(-2 k^2 lambda^2), clipped to [0, 1];
    1 for lambda < 0.2 where the series has not converged and Q = 1 anyway."""
    lam = F.sqrt(n * m / (n + m)) * d
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
                         lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * series)))
