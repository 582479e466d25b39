"""Numeric column expressions, with DuckDB twins where both sides need the same formula."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chebyshev coefficients of log(erfc(z) * exp(z*z) / t) in t = 2 / (2 + z), relative error under 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    z = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * z)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = F.lit(c) + t * poly
    tail = t * F.exp(-z * z + poly)
    return F.when(x >= 0, tail).otherwise(F.lit(2.0) - tail)


def ccdf(z: Column) -> Column:
    """Standard normal upper tail."""
    return F.lit(0.5) * erfc(z / F.lit(math.sqrt(2.0)))


def ccdf_sql(z: str) -> str:
    """DuckDB twin of ``ccdf``; ``z`` is used more than once, so pass a column."""
    a = f"(abs({z}) / {math.sqrt(2.0)!r}e0)"
    t = f"(1e0 / (1e0 + 0.5e0 * {a}))"
    poly = f"{ERFC[-1]!r}e0"
    for c in reversed(ERFC[:-1]):
        poly = f"({c!r}e0 + {t} * {poly})"
    tail = f"({t} * exp(-{a} * {a} + {poly}))"
    return f"(0.5e0 * (case when {z} >= 0 then {tail} else 2e0 - {tail} end))"


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def r6(x: Column) -> Column:
    """Rounded for comparison; negative zero becomes zero."""
    return F.round(x, 6) + F.lit(0.0)


def gaussian_tail(mean: Column, variance: Column, threshold: Column) -> Column:
    """P(X >= threshold) with continuity correction; a step where the variance vanishes; 1 for thresholds up to 0."""
    z = (threshold - F.lit(0.5) - mean) / F.sqrt(F.greatest(variance, F.lit(1e-12)))
    step = F.when(mean >= threshold - F.lit(0.5), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(threshold <= 0, F.lit(1.0)).when(variance <= 1e-12, step).otherwise(ccdf(z))


def log_choose(n: Column, k: Column, log_factorials: Column) -> Column:
    """ln C(n, k) from an array of ln i! (index 0 first); null where k is outside 0..n."""
    at = lambda i: F.element_at(log_factorials, (i + 1).cast("int"))
    return F.when((k >= 0) & (k <= n), at(n) - at(k) - at(n - k))


def log_factorial_array(top: int) -> Column:
    return F.array(*[F.lit(math.lgamma(i + 1)) for i in range(top + 1)])
