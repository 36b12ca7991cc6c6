"""R1-R23: the question shapes on the order tables."""

from pyspark.sql import functions as F

from queries.base import query
from tablewise.operators import recipes as R


def money(df, *names):
    """Amounts as exact decimals, so that totals do not depend on the order of addition."""
    return df.withColumns({n: F.col(n).cast("decimal(18,2)") for n in names})


def as_double(df, *names):
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def day(df, *names):
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd") for n in names})


@query("r01_total_by_category", "lineitem", sql="""
SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_measure
FROM lineitem GROUP BY 1""")
def r01(lineitem):
    df = R.total_by_category(money(lineitem, "l_extendedprice"), "l_returnflag", "l_extendedprice").df
    return as_double(df, "total_measure")


@query("r02_mean_by_category", "orders", sql="""
SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean_measure, count(*) AS n FROM orders GROUP BY 1""")
def r02(orders):
    df = R.mean_by_category(orders, "o_orderpriority", "o_totalprice").df
    return df.withColumn("mean_measure", F.round("mean_measure", 4))


@query("r03_ratio_by_category", "lineitem", sql="""
SELECT l_returnflag, CAST(num AS DOUBLE) AS num, CAST(den AS DOUBLE) AS den, n,
       round(CAST(num AS DOUBLE) / CAST(den AS DOUBLE), 6) AS ratio
FROM (SELECT l_returnflag, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS num,
             sum(CAST(l_quantity AS DECIMAL(18,2))) AS den, count(*) AS n FROM lineitem GROUP BY 1)
WHERE den > 0""")
def r03(lineitem):
    df = R.ratio_by_category(
        money(lineitem, "l_extendedprice", "l_quantity"), "l_returnflag", "l_extendedprice", "l_quantity"
    ).df
    ratio = F.round(F.col("num").cast("double") / F.col("den").cast("double"), 6)
    return as_double(df.withColumn("ratio", ratio), "num", "den")


@query("r04_top_rows", "orders", sql="""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def r04(orders):
    return R.top_rows(orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice", "o_orderkey").df


@query("r05_correlation", "lineitem", sql="""
WITH ranked AS (
  SELECT l_quantity AS x, l_extendedprice AS y,
         rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rx,
         rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS ry
  FROM lineitem)
SELECT round(corr(x, y), 8) AS pearson, round(corr(rx, ry), 8) AS spearman FROM ranked""")
def r05(lineitem):
    df = R.correlation(lineitem, "l_quantity", "l_extendedprice").df
    return df.select(F.round("pearson", 8).alias("pearson"), F.round("spearman", 8).alias("spearman"))


@query("r06_counts_shares", "customer", sql="""
SELECT c_mktsegment, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER () * 100, 1) AS pct
FROM customer GROUP BY 1""")
def r06(customer):
    return R.counts_shares(customer, "c_mktsegment").df


@query("r07_over_time", "orders", sql="""
SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_measure FROM orders GROUP BY 1""")
def r07(orders):
    df = R.over_time(money(orders, "o_totalprice"), "o_orderdate", "o_totalprice").df
    return as_double(day(df, "month"), "total_measure")


@query("r08_compare_groups", "orders", sql="""
SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean_measure,
       round(quantile_cont(o_totalprice, 0.5), 4) AS median_measure,
       round(stddev_samp(o_totalprice), 4) AS std_measure FROM orders GROUP BY 1""")
def r08(orders):
    df = R.compare_groups(orders, "o_orderstatus", "o_totalprice").df
    return df.withColumns({c: F.round(c, 4) for c in ("mean_measure", "median_measure", "std_measure")})


@query("r09_distinct_per_category", "orders", sql="""
SELECT o_orderpriority, count(DISTINCT o_custkey) AS distinct_ids FROM orders GROUP BY 1""")
def r09(orders):
    return R.distinct_per_category(orders, "o_orderpriority", "o_custkey").df


@query("r10_filter_aggregate", "lineitem", sql="""
SELECT count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_measure
FROM lineitem WHERE l_returnflag = 'R'""")
def r10(lineitem):
    df = R.filter_aggregate(
        money(lineitem, "l_extendedprice"), F.col("l_returnflag") == "R", "l_extendedprice", ["l_returnflag"]
    ).df
    return as_double(df, "total_measure")


@query("r11_share_of_total", "lineitem", sql="""
SELECT l_linestatus, CAST(total_measure AS DOUBLE) AS total_measure,
       round(CAST(total_measure AS DOUBLE) / sum(CAST(total_measure AS DOUBLE)) OVER () * 100, 1) AS pct_of_total
FROM (SELECT l_linestatus, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total_measure FROM lineitem GROUP BY 1)""")
def r11(lineitem):
    df = R.share_of_total(money(lineitem, "l_extendedprice"), "l_linestatus", "l_extendedprice").df
    return as_double(df, "total_measure")


@query("r12_missing_by_column", "lineitem", sql="""
SELECT * FROM (
  SELECT 'l_discount' AS "column", CAST(count_if(nullif(l_discount, 0) IS NULL) AS BIGINT) AS nulls,
         round(CAST(count_if(nullif(l_discount, 0) IS NULL) AS BIGINT) * 1.0 / count(*) * 100, 1) AS pct FROM lineitem
  UNION ALL
  SELECT 'l_tax', CAST(count_if(nullif(l_tax, 0.08) IS NULL) AS BIGINT),
         round(CAST(count_if(nullif(l_tax, 0.08) IS NULL) AS BIGINT) * 1.0 / count(*) * 100, 1) FROM lineitem)
WHERE nulls > 0""")
def r12(lineitem):
    return R.missing_by_column(
        lineitem.select(
            "l_orderkey",
            F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
            F.nullif("l_tax", F.lit(0.08)).alias("l_tax"),
        )
    ).df


@query("r13_outlier_rows", "events", sql="""
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, value FROM events, q
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def r13(events):
    return R.outlier_rows(events.select("event_id", "value"), "value").df


@query("r14_crosstab", "lineitem", sql="""
SELECT l_returnflag,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_linestatus = 'F') AS DOUBLE) AS F,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_linestatus = 'O') AS DOUBLE) AS O
FROM lineitem GROUP BY 1""")
def r14(lineitem):
    df = R.crosstab(
        money(lineitem, "l_extendedprice"), "l_returnflag", "l_linestatus", "l_extendedprice", ["F", "O"]
    ).df
    return as_double(df, "F", "O")


@query("r15_period_change", "orders", sql="""
WITH m AS (SELECT date_trunc('month', o_orderdate) AS period,
                  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_measure
           FROM orders GROUP BY 1)
SELECT strftime(period, '%Y-%m-%d') AS period, total_measure,
       round((total_measure - lag(total_measure) OVER (ORDER BY period))
             / lag(total_measure) OVER (ORDER BY period) * 100, 1) AS pct_change FROM m""")
def r15(orders):
    df = R.period_change(money(orders, "o_totalprice"), "o_orderdate", "o_totalprice").df
    return as_double(day(df, "period"), "total_measure")


@query("r16_rate_by_category", "documents", "labels", sql="""
SELECT lang, round(avg(quality) * 100, 1) AS rate_pct, count(*) AS n
FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(*) >= 30""")
def r16(documents, labels):
    return R.rate_by_category(documents.select("doc_id", "lang").join(labels, "doc_id"), "lang", "quality").df


@query("r17_top_groups", "lineitem", sql="""
SELECT l_suppkey, round(avg(l_quantity), 2) AS avg_measure, count(*) AS n FROM lineitem
GROUP BY 1 HAVING count(*) >= 30 ORDER BY avg_measure DESC, l_suppkey LIMIT 10""")
def r17(lineitem):
    return R.top_groups(lineitem, "l_suppkey", "l_quantity").df


@query("r18_bands", "customer", sql="""
SELECT CASE WHEN c_acctbal <= 0 THEN 'negative' WHEN c_acctbal <= 3000 THEN 'low'
            WHEN c_acctbal <= 6000 THEN 'middle' ELSE 'high' END AS band,
       round(avg(c_acctbal), 2) AS avg_measure, count(*) AS n FROM customer GROUP BY 1""")
def r18(customer):
    labels = ["negative", "low", "middle", "high"]
    return R.by_bands(customer, "c_acctbal", "c_acctbal", [0, 3000, 6000], labels).df


@query("r19_distribution", "orders", sql="""
SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 2) AS mean,
       round(quantile_cont(o_totalprice, 0.5), 2) AS median, round(stddev_samp(o_totalprice), 2) AS std,
       min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 2) AS p25,
       round(quantile_cont(o_totalprice, 0.75), 2) AS p75, max(o_totalprice) AS max FROM orders""")
def r19(orders):
    return R.distribution(orders, "o_totalprice").df


@query("r20_two_categories", "lineitem", sql="""
SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 2) AS avg_measure, count(*) AS n
FROM lineitem GROUP BY 1, 2""")
def r20(lineitem):
    return R.two_categories(lineitem, "l_returnflag", "l_linestatus", "l_extendedprice").df


@query("r21_mode_per_category", "part", sql="""
SELECT p_brand, p_type, n FROM (
  SELECT p_brand, p_type, count(*) AS n,
         row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS rn
  FROM part GROUP BY 1, 2) WHERE rn = 1""")
def r21(part):
    return R.mode_per_category(part, "p_brand", "p_type").df


@query("r22_driver_effect", "orders", sql="""
SELECT o_orderpriority, round(avg(o_totalprice), 2) AS avg_outcome, count(*) AS n FROM orders GROUP BY 1""")
def r22(orders):
    return R.driver_effect(orders, "o_orderpriority", "o_totalprice").df


@query("r22_driver_effect_numeric", "lineitem", sql="""
SELECT round(corr(l_quantity, l_extendedprice), 3) AS pearson FROM lineitem""")
def r22_numeric(lineitem):
    return R.driver_effect(lineitem, "l_quantity", "l_extendedprice").df


@query("r23_difference_ci", "lineitem", sql="""
WITH s AS (SELECT l_linestatus, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS sd,
                  count(*) AS n FROM lineitem GROUP BY 1),
p AS (SELECT a.mean - b.mean AS d, sqrt(a.sd * a.sd / a.n + b.sd * b.sd / b.n) AS se
      FROM s a, s b WHERE a.l_linestatus = 'F' AND b.l_linestatus = 'O')
SELECT l_linestatus, round(mean, 4) AS mean, round(sd, 4) AS sd, n, round(d, 3) AS difference,
       round(d - 1.96 * se, 3) AS ci_low, round(d + 1.96 * se, 3) AS ci_high FROM s, p""")
def r23(lineitem):
    df = R.difference_ci(lineitem, "l_linestatus", "l_extendedprice").df
    return df.withColumns({"mean": F.round("mean", 4), "sd": F.round("sd", 4)})
