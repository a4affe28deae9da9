"""Tail probabilities. Spark SQL has no erf, so the normal tail is an expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chebyshev coefficients of the complementary error function
# (relative error below 1.2e-7), constant term first.
ERFC_COEFFICIENTS = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)


def erfc(x: Column) -> Column:
    z = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + z * F.lit(0.5))
    poly = F.lit(ERFC_COEFFICIENTS[-1])
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = F.lit(c) + t * poly
    upper = t * F.exp(-z * z + poly)
    return F.when(x >= 0, upper).otherwise(F.lit(2.0) - upper)


def normal_two_sided(z: Column) -> Column:
    return erfc(F.abs(z) / F.lit(math.sqrt(2.0)))


def normal_two_sided_value(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of a chi-square with whole degrees of freedom (finite sums)."""
    if x <= 0 or df <= 0:
        return 1.0
    half = x / 2.0
    if df % 2 == 0:
        term = total = 1.0
        for k in range(1, df // 2):
            term *= half / k
            total += term
        return math.exp(-half) * total
    total = math.erfc(math.sqrt(half))
    term = math.sqrt(half) / math.gamma(1.5)
    add = 0.0
    for k in range((df - 1) // 2):
        add += term
        term *= half / (k + 1.5)
    return total + math.exp(-half) * add


def student_two_sided(t: float, df: float) -> float:
    """Two-sided Student t tail through the incomplete beta continued fraction."""
    if df <= 0:
        return float("nan")
    x = df / (df + t * t)
    return _reg_beta(x, df / 2.0, 0.5)


def _reg_beta(x: float, a: float, b: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x > (a + 1) / (a + b + 2):
        return 1.0 - front / b * _beta_fraction(1.0 - x, b, a)
    return front / a * _beta_fraction(x, a, b)


def _beta_fraction(x: float, a: float, b: float) -> float:
    # evaluated from the far end: 400 terms are ample for the degrees used here
    value = 1.0
    for m in range(400, 0, -1):
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        value = 1.0 + odd / (1.0 + even / value)
    return 1.0 / value
