"""Consulting workflows: several operators, one result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.numeric import float_div
from tablewise.functions.types import ident
from tablewise.operators import quality
from tablewise.operators.stats import nulls_distinct


def _c(name: str) -> Column:
    return F.col(ident(name))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Key values on more than one row, with their row counts."""
    return df.groupBy(_c(key)).agg(F.count("*").alias("n")).where("n > 1")


def first_look(df: DataFrame, key: str) -> DataFrame:
    """Nulls and distinct values by column, with duplicated rows and keys of the table."""
    keys = duplicate_keys(df, key).agg(F.count("*").alias("duplicated_keys"))
    copies = quality.duplicates(df).select("duplicate_rows")
    # Both are one row.
    return nulls_distinct(df).join(F.broadcast(copies)).join(F.broadcast(keys))


def metric_change(
    df: DataFrame, segment: str, current: Column, prior: Column, revenue: str, order: str
) -> DataFrame:
    """Revenue, orders and average order value of two periods by segment, and their difference.

    One scan with conditional sums; orders are reduced to (segment, period, order) first, so the
    distinct counts need no expansion of the input.
    """
    period = F.when(current, "current").when(prior, "prior")
    orders = (
        df.withColumn("_period", period)
        .where(F.col("_period").isNotNull())
        .groupBy(_c(segment), "_period", _c(order))
        .agg(F.sum(_c(revenue)).alias("_r"))
    )

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("_period") == name, F.col("_r"))), F.lit(0))

    def count(name: str) -> Column:
        return F.count_if(F.col("_period") == name)

    wide = orders.groupBy(segment).agg(
        total("current").alias("current_revenue"),
        total("prior").alias("prior_revenue"),
        count("current").alias("current_orders"),
        count("prior").alias("prior_orders"),
    )
    return wide.withColumns(
        {
            "delta": F.col("current_revenue") - F.col("prior_revenue"),
            "current_aov": F.try_divide("current_revenue", "current_orders"),
            "prior_aov": F.try_divide("prior_revenue", "prior_orders"),
        }
    ).orderBy("delta", segment)


def mix_shift(df: DataFrame, segment: str, period: Column, order: str) -> DataFrame:
    """Each segment's share of the orders of a period."""
    counts = (
        df.select(_c(segment), period.alias("period"), _c(order).alias("_o"))
        .where(F.col("period").isNotNull())
        .groupBy(segment, "period")
        .agg(F.count_distinct("_o").alias("orders"))
    )
    totals = counts.groupBy("period").agg(F.sum("orders").alias("_total"))
    joined = counts.join(totals, "period")
    return joined.withColumn("share_of_orders", F.col("orders") / F.col("_total")).drop("_total")


def segment_summary(df: DataFrame, segment: str, customer: str, revenue: str) -> DataFrame:
    """Customers, revenue, revenue per order row and per customer, and the share of the total."""
    customers = df.groupBy(_c(segment), _c(customer).alias("_who")).agg(
        F.sum(_c(revenue)).alias("_r"), F.count(_c(revenue)).alias("_n")
    )
    out = customers.groupBy(segment).agg(
        F.count("_who").alias("customers"), F.sum("_r").alias("total_revenue"), F.sum("_n").alias("_n")
    )
    total = out.agg(F.sum("total_revenue").alias("_all"))  # one row
    share = F.round(float_div(F.col("total_revenue"), F.col("_all")) * 100, 1)
    return out.join(F.broadcast(total)).select(
        segment,
        "customers",
        "total_revenue",
        float_div(F.col("total_revenue"), F.col("_n")).alias("avg_revenue_per_order"),
        float_div(F.col("total_revenue"), F.col("customers")).alias("revenue_per_customer"),
        share.alias("pct_of_total"),
    )


def kpis(df: DataFrame, revenue: str, order: str, customer: str) -> DataFrame:
    """One row: revenue, orders, customers, average order value and revenue per customer.

    The two distinct counts are separate aggregates: each is a shuffle of its own distinct values,
    where one aggregate would expand every row twice.
    """
    money = df.agg(F.sum(_c(revenue)).alias("total_revenue"))
    orders = df.agg(F.count_distinct(_c(order)).alias("total_orders"))
    customers = df.agg(F.count_distinct(_c(customer)).alias("total_customers"))
    row = money.join(F.broadcast(orders)).join(F.broadcast(customers))  # one row each
    return row.withColumns(
        {
            "avg_order_value": F.round(float_div(F.col("total_revenue"), F.col("total_orders")), 2),
            "revenue_per_customer": F.round(float_div(F.col("total_revenue"), F.col("total_customers")), 2),
        }
    )


def row_rules(when: str, measure: str, today: Column) -> dict[str, Column]:
    """Conditions a row should not meet; shared by the batch and the streaming sweep."""
    return {
        "missing_dates": _c(when).isNull(),
        "negative_measures": _c(measure) < 0,
        "future_dates": _c(when) > today,
    }


def quality_sweep(df: DataFrame, key: str, when: str, measure: str, today: Column) -> DataFrame:
    """(issue, n): rows breaking a rule, and duplicated keys."""
    rules = row_rules(when, measure, today)
    rows = df.agg(*[F.count_if(test).alias(name) for name, test in rules.items()])
    keys = duplicate_keys(df, key).agg(F.count("*").alias("duplicated_keys"))
    row = rows.join(F.broadcast(keys))  # one row each
    cells = [F.struct(F.lit(c).alias("issue"), F.col(c).alias("n")) for c in row.columns]
    return row.select(F.inline(F.array(*cells)))


def yoy_decomposition(
    df: DataFrame, dimensions: Sequence[str], measure: str, this: Column, last: Column
) -> DataFrame:
    """A measure in two date windows by dimensions, with the change in percent."""

    def total(window: Column) -> Column:
        return F.sum(F.when(window, _c(measure)))

    out = df.where(this | last).groupBy(*[_c(d) for d in dimensions]).agg(
        total(this).alias("this_period"), total(last).alias("last_period")
    )
    change = F.try_divide(F.col("this_period") - F.col("last_period"), F.col("last_period"))
    return out.withColumn("yoy_pct", F.round(change.cast("double") * 100, 1)).orderBy("yoy_pct", *dimensions)
