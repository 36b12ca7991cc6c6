"""Numeric column helpers that keep the expected results under ANSI mode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewise.functions.text import strip

#: What counts as a number written as text. ``try_cast`` alone also takes '1d', '1f' and hex floats.
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^(?i)[+-]?(inf|infinity|nan)$"


def float_div(numerator: Column, denominator: Column) -> Column:
    """Floating division: x/0 is +-inf and 0/0 is NaN, where ``/`` would raise."""
    a, b = numerator.cast("double"), denominator.cast("double")
    return (
        F.when((b == 0) & (a > 0), F.lit(float("inf")))
        .when((b == 0) & (a < 0), F.lit(float("-inf")))
        .when((b == 0) & (a == 0), F.lit(float("nan")))
        .otherwise(a / b)
    )


def lenient_double(text: Column) -> Column:
    """Text to double; anything that is not a plain number becomes null."""
    trimmed = strip(text)
    return F.when(trimmed.rlike(PLAIN_NUMBER), trimmed.try_cast("double"))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation that is null, not an error, when a side is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def clip(value: Column, low, high) -> Column:
    """Limit to [low, high]; null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def band_index(value: Column, edges: Sequence[float], right_closed: bool = True) -> Column:
    """0-based band of ``value`` among ``edges``; right-closed means an edge belongs to the band below."""
    branches = F.when(value.isNull(), None)
    for i, edge in enumerate(edges):
        branches = branches.when(value <= edge if right_closed else value < edge, F.lit(i))
    return branches.otherwise(F.lit(len(edges)))


def band_label(value: Column, edges: Sequence[float], labels: Sequence[str], right_closed: bool = True) -> Column:
    if len(labels) != len(edges) + 1:
        raise ValueError("bands need one label more than edges")
    return F.get(F.array(*map(F.lit, labels)), band_index(value, edges, right_closed))
