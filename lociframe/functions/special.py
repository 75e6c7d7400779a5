"""Distribution functions as Column expressions.

Normal and chi-square tails are built from Spark's own expressions; their short sums run in ``aggregate``. The
incomplete beta and the hypergeometric tail take tens to hundreds of steps and run over Arrow batches in numpy.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Five-term polynomial for erf (Abramowitz and Stegun 7.1.26).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body`` without repeating its expression."""
    return F.transform(F.array(value), body)[0]


def erf(x: Column) -> Column:
    def body(v: Column) -> Column:
        t = 1.0 / (1.0 + ERF_P * F.abs(v))
        poly = F.lit(ERF_A[4])
        for a in reversed(ERF_A[:4]):
            poly = poly * t + a
        return F.signum(v) * (1.0 - poly * t * F.exp(-v * v))

    return let(x.cast("double"), body)


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1.0 + erf(z / math.sqrt(2.0)))


def erfc(x: Column) -> Column:
    """1 - erf(x) for x >= 0 without the difference: the product form, and from 5 on a continued fraction."""

    def body(v: Column) -> Column:
        t = 1.0 / (1.0 + ERF_P * v)
        poly = F.lit(ERF_A[4])
        for a in reversed(ERF_A[:4]):
            poly = poly * t + a
        below = v
        for i in range(16, 0, -1):
            below = v + (i / 2.0) / below
        return F.exp(-v * v) * F.when(v < 5.0, poly * t).otherwise(1.0 / (math.sqrt(math.pi) * below))

    return let(x.cast("double"), body)


def normal_two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), erfc(F.abs(z) / math.sqrt(2.0)))


def lgamma(z: Column) -> Column:
    """ln Γ(z) for z > 0: Stirling series after shifting the argument up by eight."""

    def body(v: Column) -> Column:
        w = v + 8.0
        shift = v
        for i in range(1, 8):
            shift = shift * (v + float(i))
        series = 1 / (12 * w) - 1 / (360 * w**3) + 1 / (1260 * w**5) - 1 / (1680 * w**7)
        return (w - 0.5) * F.ln(w) - w + 0.5 * math.log(2 * math.pi) + series - F.ln(shift)

    return let(z.cast("double"), body)


def ln_factorial(n: Column) -> Column:
    return lgamma(n + 1.0)


def _lgamma_array(z: np.ndarray) -> np.ndarray:
    w = z + 8.0
    shift = z * (z + 1) * (z + 2) * (z + 3) * (z + 4) * (z + 5) * (z + 6) * (z + 7)
    series = 1 / (12 * w) - 1 / (360 * w**3) + 1 / (1260 * w**5) - 1 / (1680 * w**7) + 1 / (1188 * w**9)
    return (w - 0.5) * np.log(w) - w + 0.5 * math.log(2 * math.pi) + series - np.log(shift)


def _betainc_array(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta of whole arrays: even-odd contracted continued fraction on the side
    that converges fast, with as many steps as the largest a + b asks for."""
    out = np.full(x.shape, np.nan)
    out[x <= 0] = 0.0
    out[x >= 1] = 1.0
    live = np.flatnonzero((x > 0) & (x < 1) & np.isfinite(a) & np.isfinite(b))
    if live.size == 0:
        return out
    a, b, x = a[live], b[live], x[live]
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    # Forward recurrence for numerators and denominators, rescaled by the denominator at each step.
    p0, q0, p1, q1 = np.zeros_like(x), np.ones_like(x), np.ones_like(x), np.ones_like(x)
    last = np.ones_like(x)
    for m in range(int(100 + 6 * math.sqrt(float(np.max(a + b))))):
        coefs = (
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
            (m + 1) * (b - m - 1) * x / ((a + 2 * m + 1) * (a + 2 * m + 2)),
        )
        for c in coefs:
            p0, p1 = p1, p1 + c * p0
            q0, q1 = q1, q1 + c * q0
        scale = np.where(q1 == 0, 1.0, q1)
        p0, p1, q0, q1 = p0 / scale, p1 / scale, q0 / scale, q1 / scale
        if np.all(np.abs(p1 - last) <= 1e-15 * np.abs(p1)):
            break
        last = p1
    front = np.exp(a * np.log(x) + b * np.log1p(-x) + _lgamma_array(a + b) - _lgamma_array(a) - _lgamma_array(b)) / a
    tail = np.minimum(1.0, front * p1)
    out[live] = np.where(flip, 1.0 - tail, tail)
    return out


@F.pandas_udf(DoubleType())
def _betainc_udf(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
    values = _betainc_array(a.to_numpy(float), b.to_numpy(float), x.to_numpy(float))
    return pd.Series(values).where(pd.notna(values))


def betainc(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta I_x(a, b).

    It goes to Arrow batches: its continued fraction needs tens of steps per row, which numpy takes over a whole batch
    at once. It runs on reduced rows only.
    """
    return _betainc_udf(a.cast("double"), b.cast("double"), x.cast("double"))


def student_t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided tail of Student's t; null when df is not positive."""
    return betainc(df / 2.0, F.lit(0.5), df / (df + t * t))


@F.pandas_udf(DoubleType())
def _t_quantile_udf(q: pd.Series, df: pd.Series) -> pd.Series:
    q, df = q.to_numpy(float), df.to_numpy(float)
    lo, hi = np.zeros_like(q), np.full_like(q, 1e4)
    for _ in range(80):
        mid = (lo + hi) / 2
        upper = 0.5 * _betainc_array(df / 2, np.full_like(df, 0.5), df / (df + mid * mid))
        lo, hi = np.where(upper > 1 - q, mid, lo), np.where(upper > 1 - q, hi, mid)
    return pd.Series((lo + hi) / 2)


def student_t_quantile(q: Column, df: Column) -> Column:
    """Quantile of Student's t for q of at least one half, by bisection."""
    return _t_quantile_udf(q.cast("double"), df.cast("double"))


def chi2_sf(x: Column, k: Column) -> Column:
    """Upper tail of chi-square for whole degrees of freedom k, by the finite sums in y = x/2 with terms from their logs."""

    def body(s: Column) -> Column:
        y, k = s["y"], s["k"]
        half = F.floor(k / 2).cast("int")
        shift = F.when(k % 2 == 0, 1.0).otherwise(0.5)  # powers 0, 1, ... of y, or 1/2, 3/2, ...
        terms = F.when(half < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), half))
        total = F.aggregate(terms, F.lit(0.0), lambda acc, i: acc + F.exp((i - shift) * F.ln(y) - y - lgamma(i - shift + 1.0)))
        return total + F.when(k % 2 == 0, 0.0).otherwise(erfc(F.sqrt(y)))

    packed = F.struct((x.cast("double") / 2.0).alias("y"), k.cast("int").alias("k"))
    return F.when(k < 1, F.lit(None).cast("double")).when(x <= 0, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), let(packed, body)))
    )


def _hypergeom_array(a: np.ndarray, n: np.ndarray, k: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Upper tails of whole arrays, see hypergeom_sf."""
    least, most = np.maximum(n + k - t, 0), np.minimum(n, k)
    out = np.where(a > most, 0.0, 1.0)
    live = np.flatnonzero((a <= most) & (a > least))
    a, n, k, t, least, most = (v[live].astype(float) for v in (a, n, k, t, least, most))
    upper = a > np.floor((n + 1) * (k + 1) / (t + 2))
    i = np.where(upper, a, a - 1)
    ln = lambda u: _lgamma_array(u + 1.0)
    choose = lambda u, v: ln(u) - ln(v) - ln(u - v)
    term = np.exp(choose(k, i) + choose(t - k, n - i) - choose(t, n))
    total, steps = np.zeros_like(term), np.where(upper, most - i, i - least)
    for _ in range(int(steps.max(initial=0)) + 1):
        total += term
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(upper, (k - i) * (n - i) / ((i + 1) * (t - k - n + i + 1)), i * (t - k - n + i) / ((k - i + 1) * (n - i + 1)))
        i, steps = np.where(upper, i + 1, i - 1), steps - 1
        term = np.where(steps < 0, 0.0, term * ratio)
        if np.all(term <= 1e-18 * total):
            break
    out[live] = np.clip(np.where(upper, total, 1 - total), 0.0, 1.0)
    return out


@F.pandas_udf(DoubleType())
def _hypergeom_udf(a: pd.Series, n: pd.Series, k: pd.Series, t: pd.Series) -> pd.Series:
    known = (a.notna() & n.notna() & k.notna() & t.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[known] = _hypergeom_array(*(v.to_numpy(float)[known].astype(np.int64) for v in (a, n, k, t)))
    return pd.Series(out).where(known)


def hypergeom_sf(hits: Column, drawn: Column, marked: Column, total: Column) -> Column:
    """P(X >= hits) for ``drawn`` items out of ``total`` of which ``marked`` are marked.

    The tail that doesn't hold the mode is summed, from its largest term (from its log) by ratios of neighbours, as far
    as terms count. Like the incomplete beta it goes over whole Arrow batches of reduced rows.
    """
    return _hypergeom_udf(*(c.cast("long") for c in (hits, drawn, marked, total)))


def beta_cdf_int(x: Column, a: Column, b: Column) -> Column:
    """Beta(a, b) distribution function for whole a, b: the binomial tail P(Bin(a+b-1, x) >= a)."""
    return betainc(a, b, x)
