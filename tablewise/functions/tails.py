"""Tail probabilities of test statistics as column expressions.

The incomplete gamma and beta functions are continued fractions, folded from their far end; the number of their terms grows
with the square root of the parameters, as their convergence needs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of a continued fraction: so many, and so many more for each unit of the parameters' square root.
TERMS, MORE_TERMS = 60, 8
#: Steps up to where Stirling's series of the logarithm of the gamma function has double precision.
SHIFT = 10
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z > 0."""
    up = z + SHIFT
    series = sum((F.lit(c) / F.pow(up, 2 * i + 1) for i, c in enumerate(STIRLING)), (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi))
    steps = z
    for i in range(1, SHIFT):
        steps = steps * (z + i)
    return series - F.log(steps)


def _fraction(size: Column, last: float, term: Callable[[Column, Column], Column]) -> Column:
    """Folds ``term(rest, k)`` for falling k; ``size`` sets how far out the fold begins."""
    ks = F.sequence((TERMS + MORE_TERMS * F.sqrt(size)).cast("int"), F.lit(1), F.lit(-1))
    return F.aggregate(ks, F.lit(last), lambda rest, k: term(rest, k.cast("double")))


def gamma_tail(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function Q(a, x) for a > 0 and x >= 0."""
    scale = F.exp(a * F.log(x) - x - log_gamma(a))
    beyond = scale / (x + 1 - a + _fraction(a + x, 0.0, lambda rest, k: k * (a - k) / (x + 2 * k + 1 - a + rest)))
    # Below the mean the complement converges: P(a, x) = scale / a * (1 + x / (a + 1) * (1 + x / (a + 2) * ...)).
    within = scale / a * _fraction(a + x, 1.0, lambda rest, k: 1 + rest * x / (a + k))
    return F.when(x <= 0, 1.0).when(x < a + 1, 1 - within).otherwise(beyond)


def beta_share(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b) for 0 <= x <= 1."""

    def share(x: Column, a: Column, b: Column) -> Column:
        scale = F.exp(a * F.log(x) + b * F.log(1 - x) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)) / a

        def term(rest: Column, k: Column) -> Column:
            m = F.floor(k / 2)
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return 1 + F.when(k % 2 == 0, even).otherwise(odd) / rest

        return scale / _fraction(a + b, 1.0, term)

    near = F.when(x < (a + 1) / (a + b + 2), share(x, a, b)).otherwise(1 - share(1 - x, b, a))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(near)


def chi_square_tail(statistic: Column, dof: Column) -> Column:
    """Probability of a chi-square value at least as large; null without degrees of freedom."""
    return F.when(dof > 0, gamma_tail(dof.cast("double") / 2, statistic.cast("double") / 2))


def t_two_sided(t: Column, dof: Column) -> Column:
    """Probability of a t value at least as far from zero; null without degrees of freedom."""
    t, dof = t.cast("double"), dof.cast("double")
    return F.when(dof > 0, beta_share(dof / (dof + t * t), dof / 2, F.lit(0.5)))
