"""Statistics, trends and cohorts over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewise.functions.numeric import float_div
from tablewise.functions.tails import chi_square_tail, t_two_sided
from tablewise.functions.types import columns_where, ident, is_numeric
from tablewise.operators.ordered import group_quantiles, group_totals, match_keys, tie_ranks
from tablewise.operators.stats import column_quantiles, correlations, stacked


def describe(df: DataFrame, columns: Sequence[str] | None = None, *, bound: int | None = None) -> DataFrame:
    """Count, mean, std, variance, min, quartiles, max, skew and excess kurtosis of each column."""
    values = {c: F.col(ident(c)) for c in columns or columns_where(df, is_numeric)}

    def moments(x: Column) -> dict[str, Column]:
        return {
            "n": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "variance": F.var_samp(x),
            "min": F.min(x), "max": F.max(x), "skew": F.skewness(x), "kurtosis": F.kurtosis(x),
        }

    places = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    middle = column_quantiles(df, values, places, bound=bound)
    return stacked(df, values, moments).drop("at").join(F.broadcast(middle), "column")  # one row for each column


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(a, b, r) for every ordered pair, the diagonal included."""
    columns = list(columns or columns_where(df, is_numeric))
    half = correlations(df, columns)
    other = half.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")
    names = F.array(*map(F.lit, columns))
    one = df.agg(F.count("*").alias("n")).select(F.explode(names).alias("a"))
    diagonal = one.select("a", F.col("a").alias("b"), F.lit(1.0).alias("r"))
    return half.unionByName(other).unionByName(diagonal)


def zscores(df: DataFrame, column: str) -> DataFrame:
    """Adds ``z``; mean and deviation are one row joined by broadcast."""
    x = F.col(ident(column))
    moments = df.agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    z = (x - F.col("_m")) / F.nullif("_s", F.lit(0.0))
    return df.join(F.broadcast(moments)).withColumn("z", z).drop("_m", "_s")


def above_quantile(df: DataFrame, column: str, p: float, *, bound: int | None = None) -> DataFrame:
    """Adds ``is_high``: whether the value lies above the ``p`` quantile of the column."""
    cut = group_quantiles(df.select(ident(column)), [], column, {"_cut": p}, bound=bound)
    return df.join(F.broadcast(cut)).withColumn("is_high", F.col(ident(column)) > F.col("_cut")).drop("_cut")


def group_outliers(df: DataFrame, by: Sequence[str], column: str, deviations: float = 3.0) -> DataFrame:
    """Adds ``is_outlier``: above its own group's mean by more than ``deviations`` deviations."""
    x = F.col(ident(column))
    out = group_totals(df, by, _m=F.avg(x), _s=F.stddev_samp(x))
    flag = F.coalesce(x > F.col("_m") + deviations * F.col("_s"), F.lit(False))
    return out.withColumn("is_outlier", flag).drop("_m", "_s")


def share_in_group(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Adds the group total and the row's share of it."""
    out = group_totals(df, by, group_total=F.sum(ident(column)))
    share = float_div(F.col(ident(column)), F.col("group_total"))
    return out.withColumn("share", share)


def ranked(
    df: DataFrame, by: Sequence[str], column: str, *, descending: bool = True, bound: int | None = None
) -> DataFrame:
    """Adds min, average and dense rank within the group; equal values share them."""
    ranks = tie_ranks(df, by, column, descending=descending, bound=bound).drop("ties")
    return match_keys(df, ranks, [*by, column])


def trend(df: DataFrame, when: str, measure: str) -> DataFrame:
    """Monthly totals with growth on the month and on the year, and the three-month average.

    The windows run over one row a month.
    """
    monthly = df.groupBy(F.date_trunc("month", ident(when)).alias("month")).agg(
        F.sum(ident(measure)).alias("total")
    )
    w = Window.orderBy("month")
    total = F.col("total")
    recent = w.rowsBetween(-2, 0)
    return monthly.withColumns(
        {
            "mom_growth": float_div(total - F.lag("total").over(w), F.lag("total").over(w)),
            "yoy_growth": float_div(total, F.lag("total", 12).over(w)) - 1,
            "avg_3mo": F.when(F.count("*").over(recent) == 3, F.avg("total").over(recent)),
        }
    )


def welch(df: DataFrame, group: str, a, b, measure: str) -> DataFrame:
    """Welch's t, its degrees of freedom and two-sided p-value for two groups, from one scan of their moments."""
    x = F.col(ident(measure)).cast("double")

    def moments(value) -> list[Column]:
        mine = F.when(F.col(ident(group)) == F.lit(value), x)
        return [F.count(mine), F.avg(mine), F.var_samp(mine)]

    names = ["na", "ma", "va", "nb", "mb", "vb"]
    row = df.agg(*[e.alias(n) for e, n in zip(moments(a) + moments(b), names)])
    ea, eb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    tested = row.select(
        ((F.col("ma") - F.col("mb")) / F.sqrt(ea + eb)).alias("t"),
        (
            (ea + eb) * (ea + eb) / (ea * ea / (F.col("na") - 1) + eb * eb / (F.col("nb") - 1))
        ).alias("df"),
    )
    return tested.withColumn("p", t_two_sided(F.col("t"), F.col("df")))


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    a, b = F.col(ident(x)).cast("double"), F.col(ident(y)).cast("double")
    return df.agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square statistic, degrees of freedom and p-value of the cross-tab of two columns.

    Empty cells count with their expected value, without building the full grid: the sum over all
    cells of (o - e)^2 / e equals the sum over filled cells of o^2 / e, less the number of rows.
    """
    cells = df.where(F.col(ident(a)).isNotNull() & F.col(ident(b)).isNotNull()).groupBy(
        F.col(ident(a)).alias("a"), F.col(ident(b)).alias("b")
    ).agg(F.count("*").cast("double").alias("o"))
    rows = cells.groupBy("a").agg(F.sum("o").alias("ra"))
    columns = cells.groupBy("b").agg(F.sum("o").alias("rb"))
    total = cells.agg(
        F.sum("o").alias("n"), F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb")
    )
    terms = cells.join(rows, "a").join(columns, "b").withColumn(
        "term", F.col("o") * F.col("o") / (F.col("ra") * F.col("rb"))
    )
    summed = terms.agg(F.sum("term").alias("s"))
    tested = total.join(F.broadcast(summed)).select(  # one row each
        (F.col("n") * (F.col("s") - 1)).alias("chi2"),
        ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("dof"),
    )
    return tested.withColumn("p", chi_square_tail(F.col("chi2"), F.col("dof")))


def cohorts(df: DataFrame, user: str, when: str) -> DataFrame:
    """(cohort, months_since, active, retention): users by the month of their first event.

    Users are reduced to one row for each active month before anything else, so a user with a third
    of all events costs no more than the months they were active.
    """
    months = df.select(ident(user), F.date_trunc("month", ident(when)).alias("month")).distinct()
    first = months.groupBy(user).agg(F.min("month").alias("cohort"))
    since = (F.year("month") - F.year("cohort")) * 12 + F.month("month") - F.month("cohort")
    active = (
        months.join(first, user)
        .groupBy("cohort", since.alias("months_since"))
        .agg(F.count("*").alias("active"))
    )
    size = active.where("months_since = 0").select("cohort", F.col("active").alias("size"))
    return active.join(size, "cohort").select(
        "cohort", "months_since", "active", (F.col("active") / F.col("size")).alias("retention")
    )


def retention_table(cohort_rows: DataFrame, months: Sequence[int] | None = None) -> DataFrame:
    """Cohorts down, months since the first event across: the months named, or all that occur."""
    return cohort_rows.groupBy("cohort").pivot("months_since", None if months is None else list(months)).agg(F.max("retention"))
