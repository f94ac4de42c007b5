"""Closed-form statistics as column expressions over already aggregated rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rounded(value: Column | str, digits: int = 4) -> Column:
    """Round for reporting; NaN and infinities become null, negative zero becomes zero.

    A string is read as a SQL expression, which costs one call instead of many.
    """
    if isinstance(value, str):
        shown = f"round({value}, {digits})"
        return F.expr(
            f"CASE WHEN isnan({value}) OR abs({value}) = double('infinity') THEN NULL "
            f"WHEN {shown} = 0 THEN 0.0D ELSE {shown} END")
    finite = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    shown = F.round(value, digits)
    return F.when(finite, F.when(shown == 0, F.lit(0.0)).otherwise(shown))


def share(part: str, whole: str, digits: int = 4) -> Column:
    """Rounded quotient of two SQL expressions, 0 for an empty whole."""
    return F.expr(f"CASE WHEN {whole} > 0 THEN round({part} / {whole}, {digits}) ELSE 0.0D END")


def cramers_v(chi2: Column, n: Column, rows: Column, cols: Column) -> Column:
    """Bias-corrected association of an ``rows`` x ``cols`` table with statistic ``chi2``."""
    r, k = rows.cast("double"), cols.cast("double")
    excess = F.greatest(F.lit(0.0), chi2 / n - (k - 1) * (r - 1) / (n - 1))
    r_c = r - (r - 1) * (r - 1) / (n - 1)
    k_c = k - (k - 1) * (k - 1) / (n - 1)
    room = F.least(r_c - 1, k_c - 1)
    usable = (F.least(r, k) > 1) & (n > 1) & (room > 0)
    return F.coalesce(F.when(usable, F.round(F.sqrt(excess / room), 4)), F.lit(0.0))


def yates_chi2(chi2: Column, n: Column, row_product: Column, col_product: Column) -> Column:
    """Continuity-corrected statistic of a 2x2 table.

    All four cells deviate from expectation by the same amount d, so ``chi2 = d^2 * sum(1/E)`` and
    the correction only shrinks d by at most one half.
    """
    inverse_e = n * n * n / (row_product * col_product)
    d = F.sqrt(F.greatest(chi2, F.lit(0.0)) / inverse_e)
    shrunk = d - F.least(F.lit(0.5), d)
    return shrunk * shrunk * inverse_e


def ks_p_value(d: str, n1: str, n2: str) -> Column:
    """Asymptotic two-sample Kolmogorov p-value of three SQL expressions.

    The alternating series converges fast for large lambda; below 0.6 the dual theta series is used.
    """
    lam = f"({d} * sqrt({n1} * {n2} / ({n1} + {n2})))"
    tail = " + ".join(f"{(-1) ** (j - 1)}D * exp({-2 * j * j}D * {lam} * {lam})" for j in range(1, 12))
    head = " + ".join(f"exp({-((2 * j - 1) ** 2) * np.pi ** 2 / 8.0!r}D / ({lam} * {lam}))" for j in range(1, 6))
    return F.expr(
        f"greatest(0.0D, least(1.0D, CASE WHEN {lam} <= 1e-9D THEN 1.0D WHEN {lam} < 0.6D "
        f"THEN 1.0D - {float(np.sqrt(2 * np.pi))!r}D / {lam} * ({head}) ELSE 2.0D * ({tail}) END))")


def _incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (vectorised)."""
    from math import lgamma

    tiny = 1e-300
    swap = x > (a + 1) / (a + b + 2)
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    x = np.where(swap, 1 - x, x)
    log_front = np.array([
        lgamma(p + q) - lgamma(p) - lgamma(q) for p, q in zip(a, b)
    ]) + a * np.log(np.maximum(x, tiny)) + b * np.log(np.maximum(1 - x, tiny))
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    total = d.copy()
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            total = total * d * c
    value = np.exp(log_front) * total / a
    return np.where(swap, 1 - value, value)


@F.pandas_udf(T.DoubleType())
def correlation_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation coefficient (Student t with n-2 degrees of freedom).

    Runs on summary rows only: one row per audited column.
    """
    r_v, n_v = r.to_numpy(float), n.to_numpy(float)
    out = np.full(len(r_v), np.nan)
    ok = np.isfinite(r_v) & (n_v > 2)
    if ok.any():
        dof = n_v[ok] - 2
        r2 = np.minimum(r_v[ok] ** 2, 1.0)
        out[ok] = np.where(r2 >= 1.0, 0.0, _incomplete_beta(dof / 2, np.full(ok.sum(), 0.5), 1 - r2))
    return pd.Series(out)
