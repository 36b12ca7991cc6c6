"""Checks that uncover a known trap in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.functions.numeric import lenient_double, safe_corr
from tablewise.functions.types import ident


def simpson(df: DataFrame, stratum: str, group: str, a, b, measure: str) -> DataFrame:
    """Gap between two groups over all rows and within each stratum, and whether it reverses.

    Sums and counts by (stratum, group) are enough for both, so the table is scanned once.
    """
    value, g = F.col(ident(measure)), F.col(ident(group))
    cells = (
        df.where(g.isin(a, b))
        .groupBy(F.col(ident(stratum)).alias("stratum"))
        .agg(
            *[F.sum(F.when(g == k, value)).alias(f"s{i}") for i, k in enumerate((a, b))],
            *[F.count(F.when(g == k, value)).alias(f"n{i}") for i, k in enumerate((a, b))],
        )
    )
    overall = cells.agg(
        (F.try_divide(F.sum("s0"), F.sum("n0")) - F.try_divide(F.sum("s1"), F.sum("n1"))).alias("overall_gap")
    )
    gap = (F.try_divide("s0", "n0") - F.try_divide("s1", "n1")).alias("gap")
    out = cells.select("stratum", gap).join(F.broadcast(overall))  # one row
    return out.withColumn("reversed", F.signum("gap") * F.signum("overall_gap") < 0)


def missing_by_group(df: DataFrame, group: str, column: str) -> DataFrame:
    """Share of missing values in each group; unequal shares mean the gaps are not random."""
    missing = F.col(ident(column)).isNull()
    return df.groupBy(F.col(ident(group))).agg(
        F.count("*").alias("n"), F.avg(missing.cast("double")).alias("missing_rate")
    )


def small_groups(df: DataFrame, group: str, limit: int = 5) -> DataFrame:
    return df.groupBy(F.col(ident(group))).agg(F.count("*").alias("n")).where(F.col("n") < limit)


def corr_text(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of two columns of numbers held as text; other text counts as missing."""
    x, y = lenient_double(F.col(ident(a))), lenient_double(F.col(ident(b)))
    return df.agg(F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).alias("n"), safe_corr(x, y).alias("r"))
