"""Normal and chi-square tails as column expressions: series, continued fraction
and Newton's steps, each a fold over a short array, so no value leaves the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import col

NEWTON_STEPS = 8


def _fold(steps: int, start: Column, step) -> Column:
    """step(value, i) for i from `steps` down to 1, from start."""
    return F.aggregate(F.sequence(F.lit(steps), F.lit(1), F.lit(-1)), start, step)


def gamma_tail(a: float, x: Column | str) -> Column:
    """The regularised upper incomplete gamma function Q(a, x) for a > 0; 1 for x <= 0, null for null.

    Below a + 1 it is 1 less the power series, taken from its last term inwards;
    from there on Legendre's continued fraction, likewise. Some 14 digits.
    """
    if a <= 0:
        raise ValueError("a must be above 0")
    x = col(x).cast("double")
    steps = 80 + int(12 * math.sqrt(a))
    series = _fold(steps, F.lit(1.0), lambda s, i: 1 + s * x / (a + i))
    below = 1 - F.exp(a * F.log(x) - x - math.lgamma(a + 1)) * series
    fraction = _fold(steps, x + (2 * steps + 1 - a), lambda t, i: x + (2 * i - 1 - a) - i * (i - a) / t)
    beyond = F.exp(a * F.log(x) - x - math.lgamma(a)) / fraction
    return F.when(x <= 0, 1.0).when(x < a + 1, below).when(x.isNotNull(), F.when(x < float("inf"), beyond).otherwise(0.0))


def erfc(x: Column | str) -> Column:
    """The complementary error function."""
    x = col(x).cast("double")
    tail = gamma_tail(0.5, x * x)
    return F.when(x < 0, 2 - tail).otherwise(tail)


def normal_cdf(x: Column | str) -> Column:
    return erfc(-col(x) / math.sqrt(2)) / 2


def normal_quantile(p: Column | str) -> Column:
    """Infinite values, at 0 and 1, become 0; null for null and outside of [0, 1].

    Newton's steps on the log of the tail: it is concave, and the start lies
    beyond the root, so steps come from one side and never pass it.
    """
    p = col(p).cast("double")
    q = F.least(p, 1 - p)
    log_q = F.log(q)

    def step(z: Column, _: Column) -> Column:
        tail = erfc(z / math.sqrt(2)) / 2
        density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        return z + (F.log(tail) - log_q) * tail / density

    z = _fold(NEWTON_STEPS, F.sqrt(-2 * log_q), step)
    return F.when((p == 0) | (p == 1) | (p == 0.5), 0.0).when((p > 0) & (p < 0.5), -z).when((p > 0.5) & (p < 1), z)


def chi2_sf(x: Column | str, df: float = 1) -> Column:
    """The chance that a chi-square value of df degrees is above x."""
    return gamma_tail(df / 2, col(x) / 2)
