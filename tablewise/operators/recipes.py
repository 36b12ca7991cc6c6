"""The common shapes of an analytic question, each as a function of a table and column names.

Every function returns an :class:`Answer`: the result and what it used, so that the checks in
``critique`` need not guess which columns and aggregates stand behind a number.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewise.functions.numeric import band_index, float_div, safe_corr
from tablewise.functions.types import ident, is_numeric
from tablewise.operators.ordered import carried_ranks, group_quantiles, match_keys
from tablewise.operators.stats import wide

#: Groups smaller than this are left out where a rate or a ranking of means is asked for.
MIN_GROUP = 30
CONFIDENCE_95 = 1.96


@dataclass(frozen=True)
class Answer:
    df: DataFrame
    shape: str
    columns: tuple[str, ...]
    aggregates: tuple[str, ...]
    handles_nulls: bool = False


def _c(name: str) -> Column:
    return F.col(ident(name))


def _pct(part: Column, whole: Column) -> Column:
    return F.round(float_div(part, whole) * 100, 1)


def total_by_category(df: DataFrame, category: str, measure: str) -> Answer:
    out = df.groupBy(_c(category)).agg(F.sum(_c(measure)).alias("total_measure"))
    return Answer(out.orderBy(F.desc("total_measure"), category), "total", (category, measure), ("sum",))


def mean_by_category(df: DataFrame, category: str, measure: str) -> Answer:
    out = df.groupBy(_c(category)).agg(
        F.avg(_c(measure)).alias("mean_measure"), F.count("*").alias("n")
    )
    return Answer(out.orderBy(F.desc("mean_measure"), category), "mean", (category, measure), ("mean", "count"))


def ratio_by_category(df: DataFrame, category: str, numerator: str, denominator: str) -> Answer:
    """Ratio of the sums, which is not the mean of the row ratios."""
    out = (
        df.groupBy(_c(category))
        .agg(
            F.sum(_c(numerator)).alias("num"),
            F.sum(_c(denominator)).alias("den"),
            F.count("*").alias("n"),
        )
        .where(F.col("den") > 0)
        .withColumn("ratio", F.col("num") / F.col("den"))
    )
    return Answer(
        out.orderBy(F.desc("ratio"), category), "ratio", (category, numerator, denominator), ("sum", "count")
    )


def top_rows(df: DataFrame, measure: str, key: str, n: int = 10) -> Answer:
    """``key`` settles ties, so the answer does not depend on the layout of the data."""
    out = df.orderBy(_c(measure).desc_nulls_last(), _c(key)).limit(n)
    return Answer(out, "top_rows", (measure,), ())


def spearman(df: DataFrame, a: str, b: str, *, slices: int | None = None) -> DataFrame:
    """Pearson correlation of average-tie ranks, over rows where both values are present.

    Equal (a, b) pairs are counted first, and each pair carries its two ranks from slice to slice;
    nothing is joined on a value.
    """
    pairs = (
        df.select(_c(a).cast("double").alias("a"), _c(b).cast("double").alias("b"))
        .dropna()
        .groupBy("a", "b")
        .agg(F.count("*").cast("double").alias("w"))
    )
    ranked = carried_ranks(pairs, "a", "b", "w", "rank_a", slices=slices)
    ranked = carried_ranks(ranked, "b", "a", "w", "rank_b", slices=slices)
    w, x, y = F.col("w"), F.col("rank_a"), F.col("rank_b")
    moments = ranked.agg(
        F.sum(w).alias("n"),
        (F.sum(w * x) / F.sum(w)).alias("mx"),
        F.max(x).alias("hx"), F.min(x).alias("lx"), F.max(y).alias("hy"), F.min(y).alias("ly"),
        F.sum(w * x * y).alias("xy"), F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"),
    )
    # Average ranks always have mean (n + 1) / 2, which keeps the sums well conditioned.
    mean = (F.col("n") + 1) / 2
    cov = F.col("xy") - F.col("n") * mean * mean
    var = (F.col("xx") - F.col("n") * mean * mean) * (F.col("yy") - F.col("n") * mean * mean)
    varies = (F.col("hx") > F.col("lx")) & (F.col("hy") > F.col("ly"))
    return moments.select(F.when(varies, cov / F.nullif(F.sqrt(var), F.lit(0.0))).alias("spearman"))


def correlation(df: DataFrame, a: str, b: str, *, slices: int | None = None) -> Answer:
    """Pearson and Spearman side by side; a gap between them points at outliers or a curve."""
    pearson = df.agg(safe_corr(_c(a), _c(b)).alias("pearson"))
    out = pearson.join(F.broadcast(spearman(df, a, b, slices=slices)))  # one row each
    return Answer(out, "correlation", (a, b), ("pearson", "spearman"))


def counts_shares(df: DataFrame, category: str) -> Answer:
    counts = df.groupBy(_c(category)).agg(F.count("*").alias("n"))
    out = _with_share(counts, "n", "pct")
    return Answer(out.orderBy(F.desc("n"), category), "counts", (category,), ("count",))


def _with_share(groups: DataFrame, column: str, name: str) -> DataFrame:
    total = groups.agg(F.sum(column).alias("_total"))  # one row
    share = _pct(F.col(column), F.col("_total"))
    return groups.join(F.broadcast(total)).withColumn(name, share).drop("_total")


def over_time(df: DataFrame, when: str, measure: str, period: str = "month") -> Answer:
    out = (
        df.groupBy(F.date_trunc(period, _c(when)).alias(period))
        .agg(F.sum(_c(measure)).alias("total_measure"))
        .orderBy(period)
    )
    return Answer(out, "over_time", (when, measure), ("sum",))


def compare_groups(df: DataFrame, group: str, measure: str, *, bound: int | None = None) -> Answer:
    moments = df.groupBy(_c(group).alias(group)).agg(
        F.count("*").alias("n"),
        F.avg(_c(measure)).alias("mean_measure"),
        F.stddev_samp(_c(measure)).alias("std_measure"),
    )
    middle = group_quantiles(df.select(_c(group), _c(measure)), [group], measure, {"median_measure": 0.5}, bound=bound)
    out = match_keys(moments, middle, [group]).select(
        group, "n", "mean_measure", "median_measure", "std_measure"
    ).orderBy(group)
    return Answer(out, "compare", (group, measure), ("mean", "median", "std", "count"))


def distinct_per_category(df: DataFrame, category: str, item: str) -> Answer:
    """Distinct values spread by (category, value) before they are counted, so no category is a hot spot."""
    out = df.groupBy(_c(category)).agg(F.count_distinct(_c(item)).alias("distinct_ids"))
    return Answer(out.orderBy(F.desc("distinct_ids"), category), "distinct", (category, item), ("n_unique",))


def filter_aggregate(df: DataFrame, condition: Column, measure: str, used: Sequence[str] = ()) -> Answer:
    out = df.where(condition).agg(F.count("*").alias("n"), F.sum(_c(measure)).alias("total_measure"))
    return Answer(out, "filter", (*used, measure), ("sum", "count"))


def share_of_total(df: DataFrame, category: str, measure: str) -> Answer:
    totals = df.groupBy(_c(category)).agg(F.sum(_c(measure)).alias("total_measure"))
    out = _with_share(totals, "total_measure", "pct_of_total")
    return Answer(out.orderBy(F.desc("pct_of_total"), category), "share", (category, measure), ("sum",))


def missing_by_column(df: DataFrame) -> Answer:
    counts = wide(df, df.columns, lambda c: {"nulls": F.count_if(c.isNull()), "_rows": F.count("*")})
    out = counts.where(F.col("nulls") > 0).select(
        "column", "nulls", _pct(F.col("nulls"), F.col("_rows")).alias("pct")
    )
    return Answer(out.orderBy(F.desc("nulls"), "column"), "missing", tuple(df.columns), ("null_count",), True)


def outlier_rows(df: DataFrame, measure: str, *, bound: int | None = None) -> Answer:
    """Rows outside the quartile fences. The fences are one row, joined by broadcast."""
    fences = group_quantiles(df.select(_c(measure)), [], measure, {"_q1": 0.25, "_q3": 0.75}, bound=bound)
    reach = 1.5 * (F.col("_q3") - F.col("_q1"))
    value = _c(measure)
    out = (
        df.join(F.broadcast(fences))
        .where((value < F.col("_q1") - reach) | (value > F.col("_q3") + reach))
        .drop("_q1", "_q3")
        .orderBy(value.desc())
    )
    return Answer(out, "outliers", (measure,), ("quantile",))


def crosstab(
    df: DataFrame, row: str, column: str, measure: str, values: Sequence | None = None, fill=None
) -> Answer:
    """Totals with one column for each value; empty cells are null unless ``fill`` is given."""
    out = df.groupBy(_c(row)).pivot(column, list(values) if values else None).agg(F.sum(_c(measure)))
    if fill is not None:
        out = out.fillna(fill)
    return Answer(out.orderBy(row), "crosstab", (row, column, measure), ("sum",))


def period_change(df: DataFrame, when: str, measure: str, period: str = "month") -> Answer:
    """Change against the previous period present in the data, in percent."""
    totals = df.groupBy(F.date_trunc(period, _c(when)).alias("period")).agg(
        F.sum(_c(measure)).alias("total_measure")
    )
    before = F.lag("total_measure").over(Window.orderBy("period"))  # one row for each period
    change = F.round(float_div(F.col("total_measure") - before, before) * 100, 1)
    return Answer(
        totals.withColumn("pct_change", change).orderBy("period"), "period_change", (when, measure), ("sum",)
    )


def rate_by_category(df: DataFrame, category: str, flag: str, min_group: int = MIN_GROUP) -> Answer:
    """Percentage of rows whose flag is set; groups below ``min_group`` rows are noise and left out."""
    yes = _c(flag).cast("boolean").cast("int")
    out = (
        df.groupBy(_c(category))
        .agg(F.round(F.avg(yes) * 100, 1).alias("rate_pct"), F.count("*").alias("n"))
        .where(F.col("n") >= min_group)
        .orderBy(F.desc("rate_pct"), category)
    )
    return Answer(out, "rate", (category, flag), ("mean", "count"))


def top_groups(
    df: DataFrame, category: str, measure: str, n: int = 10, min_group: int = MIN_GROUP
) -> Answer:
    out = (
        df.groupBy(_c(category))
        .agg(F.round(F.avg(_c(measure)), 2).alias("avg_measure"), F.count("*").alias("n"))
        .where(F.col("n") >= min_group)
        .orderBy(F.desc("avg_measure"), category)
        .limit(n)
    )
    return Answer(out, "top_groups", (category, measure), ("mean", "count"))


def by_bands(
    df: DataFrame,
    banded: str,
    measure: str,
    edges: Sequence[float],
    labels: Sequence[str],
    right_closed: bool = True,
) -> Answer:
    index = band_index(_c(banded), edges, right_closed)
    out = (
        df.groupBy(index.alias("_band"))
        .agg(F.round(F.avg(_c(measure)), 2).alias("avg_measure"), F.count("*").alias("n"))
        .orderBy("_band")
        .select(
            F.get(F.array(*map(F.lit, labels)), F.col("_band")).alias("band"), "avg_measure", "n"
        )
    )
    return Answer(out, "bands", (banded, measure), ("mean", "count"))


def distribution(df: DataFrame, measure: str, *, bound: int | None = None) -> Answer:
    x = _c(measure)
    moments = df.agg(
        F.count(x).alias("n"),
        F.round(F.avg(x), 2).alias("mean"),
        F.round(F.stddev_samp(x), 2).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )
    places = {"median": 0.5, "p25": 0.25, "p75": 0.75}
    middle = group_quantiles(df.select(x), [], measure, places, bound=bound).select(
        *[F.round(p, 2).alias(p) for p in places]
    )
    out = moments.join(F.broadcast(middle)).select(
        "n", "mean", "median", "std", "min", "p25", "p75", "max"
    )
    return Answer(out, "distribution", (measure,), ("mean", "median", "std", "quantile"))


def two_categories(df: DataFrame, first: str, second: str, measure: str) -> Answer:
    out = (
        df.groupBy(_c(first), _c(second))
        .agg(F.round(F.avg(_c(measure)), 2).alias("avg_measure"), F.count("*").alias("n"))
        .orderBy(first, second)
    )
    return Answer(out, "two_categories", (first, second, measure), ("mean", "count"))


def mode_per_category(df: DataFrame, category: str, value: str) -> Answer:
    """Most frequent value of each category; the smaller value wins a tie."""
    counts = df.groupBy(_c(category), _c(value)).agg(F.count("*").alias("n"))
    best = F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), _c(value)))
    out = counts.groupBy(category).agg(best.alias("_b")).select(category, f"_b.{value}", "_b.n")
    return Answer(out.orderBy(category), "mode", (category, value), ("count",))


def driver_effect(df: DataFrame, driver: str, outcome: str) -> Answer:
    """A numeric driver is correlated with the outcome; any other kind is compared by its values."""
    if is_numeric(df.schema[driver].dataType):
        out = df.agg(F.round(safe_corr(_c(driver), _c(outcome)), 3).alias("pearson"))
        return Answer(out, "driver", (driver, outcome), ("pearson",))
    out = (
        df.groupBy(_c(driver))
        .agg(F.round(F.avg(_c(outcome)), 2).alias("avg_outcome"), F.count("*").alias("n"))
        .orderBy(F.desc("avg_outcome"), driver)
    )
    return Answer(out, "driver", (driver, outcome), ("mean", "count"))


def difference_ci(df: DataFrame, group: str, measure: str) -> Answer:
    """Difference of the means of the first two groups, by key, with its 95% interval."""
    summary = df.groupBy(_c(group)).agg(
        F.avg(_c(measure)).alias("mean"), F.stddev_samp(_c(measure)).alias("sd"), F.count("*").alias("n")
    )
    two = summary.orderBy(group).limit(2).withColumn("_place", F.row_number().over(Window.orderBy(group)))
    cell = F.struct("mean", "sd", "n")
    pair = two.agg(
        F.max(F.when(F.col("_place") == 1, cell)).alias("a"), F.max(F.when(F.col("_place") == 2, cell)).alias("b")
    )
    error = F.sqrt(
        F.col("a.sd") * F.col("a.sd") / F.col("a.n") + F.col("b.sd") * F.col("b.sd") / F.col("b.n")
    )
    diff = F.col("a.mean") - F.col("b.mean")
    interval = pair.select(
        F.round(diff, 3).alias("difference"),
        F.round(diff - CONFIDENCE_95 * error, 3).alias("ci_low"),
        F.round(diff + CONFIDENCE_95 * error, 3).alias("ci_high"),
    )
    out = summary.join(F.broadcast(interval)).orderBy(group)  # interval is one row
    return Answer(out, "difference", (group, measure), ("mean", "std", "count"))
