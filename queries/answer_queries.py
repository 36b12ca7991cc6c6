"""C, W, V and X: checks on answers, workflows, chart data and planted traps."""

from pyspark.sql import functions as F

from queries.base import query
from queries.recipe_queries import as_double, day, money
from tablewise.functions.numeric import float_div
from tablewise.operators import chartdata as V
from tablewise.operators import checks as X
from tablewise.operators import critique as C
from tablewise.operators import recipes as R
from tablewise.operators import workflows as W
from tablewise.plans.profile import profile


# ---- critique ------------------------------------------------------------------------------------


# The rates come from the SQL; that one row came back of a question for a breakdown over time is given.
@query("c_review", "events", sql="""
WITH e AS (SELECT nullif(value, 0.01) AS v FROM events),
q AS (SELECT quantile_cont(v, 0.25) AS q1, median(v) AS med, quantile_cont(v, 0.75) AS q3 FROM e),
s AS (SELECT median(abs(v - med)) AS mad FROM e, q),
f AS (SELECT greatest(count_if(v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)),
                      count_if(abs(v - med) * 0.6745 / mad > 3.5)) / (SELECT count(*) FROM e) AS outliers,
             avg((v - (SELECT avg(v) FROM e)) ** 3) / pow(avg((v - (SELECT avg(v) FROM e)) ** 2), 1.5) AS skew,
             count_if(v IS NULL) / count(*) AS nulls FROM e, q, s)
SELECT * FROM (
  SELECT 'correlation-outliers' AS code, 'serious' AS severity, false AS fatal FROM f WHERE outliers >= 0.01
  UNION ALL SELECT 'mean-on-skewed', 'warning', false FROM f WHERE abs(skew) >= 2
  UNION ALL SELECT 'unacknowledged-nulls', 'warning', false FROM f WHERE nulls >= 0.05
  UNION ALL SELECT 'ungrouped-result', 'serious', false
  UNION ALL SELECT 'short-trend', 'warning', false)""")
def c_review(events):
    df = events.select("event_type", "user_id", F.nullif("value", F.lit(0.01)).alias("value"))
    answer = R.Answer(df.agg(F.avg("value").alias("mean_value")), "mean", ("event_type", "value"), ("mean", "pearson"))
    source, question = profile(df, name="events"), "mean value per event type over time"
    facts = C.result_facts(answer.df).join(F.broadcast(C.source_facts(source, answer, question)))
    return C.caveats(facts, C.source_rules(answer) + C.result_rules(question)).select("code", "severity", "fatal")


@query("c_source_size", "region", "events", sql="""
SELECT 'region' AS source, 'small-source' AS code, 'warning' AS severity, 'the source has ' || count(*) || ' rows only' AS message
FROM region HAVING count(*) BETWEEN 1 AND 29
UNION ALL
SELECT 'events', 'sampled-source', 'serious', 'computed on ' || count(*) FILTER (('0x' || substr(md5('0:' || event_id), 1, 8))::BIGINT % 3 = 0)
  || ' sampled rows of about ' || count(*) || ': it describes the sample' FROM events""")
def c_source_size(region, events):
    """What the size of the source says: few rows, or a sample of them."""

    def of(name, df, **sampling):
        answer = R.Answer(df.agg(F.count("*").alias("n")), "counts_shares", (), ())
        facts = C.result_facts(answer.df).join(F.broadcast(C.source_facts(profile(df, name=name, **sampling), answer, "how many")))  # one row each
        return C.caveats(facts, C.source_rules(answer)).select(F.lit(name).alias("source"), "code", "severity", "message")

    return of("region", region).unionByName(of("events", events, sample_key="event_id", stride=3))


@query("c_tiny_groups", "events", sql="""
WITH g AS (SELECT user_id, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1, 2)
SELECT count(*) AS rows, 'tiny-groups' AS code, 'warning' AS severity, false AS fatal, CAST(count_if(n < 5) AS BIGINT)
  || ' of ' || count(*) || ' groups have fewer than 5 rows (smallest: ' || min(n) || ')' AS message FROM g""")
def c_tiny(events):
    return C.result_caveats(events.groupBy("user_id", F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("n")))


def supplier_tests(lineitem):
    """A two-sided p-value for each supplier: is its mean quantity different from the overall mean?"""
    whole = lineitem.agg(F.avg("l_quantity").alias("m"), F.stddev_samp("l_quantity").alias("s"))
    each = lineitem.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("mean"), F.count("*").alias("n"))
    z = F.abs(F.col("mean") - F.col("m")) / (F.col("s") / F.sqrt("n"))
    return each.join(F.broadcast(whole)).select("l_suppkey", normal_tail(z).alias("p_value"))


def normal_tail(z):
    """Two-sided normal tail by a logistic approximation, good to about 0.0002."""
    return F.lit(2.0) / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


@query("c_multiple_comparisons", "lineitem", sql="""
WITH w AS (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem),
e AS (SELECT l_suppkey, avg(l_quantity) AS mean, count(*) AS n FROM lineitem GROUP BY 1),
p AS (SELECT 2.0 / (1 + exp(1.5976 * z + 0.07056 * z * z * z)) AS p_value
      FROM (SELECT abs(mean - m) / (s / sqrt(n)) AS z FROM e, w))
SELECT count(*) AS rows, 'multiple-comparisons' AS code, 'serious' AS severity, false AS fatal,
  count(*) || ' p-values, ' || CAST(count_if(p_value < 0.05) AS BIGINT) || ' below 0.05; chance alone gives about '
  || CAST(round(count(*) * 0.05) AS BIGINT) AS message FROM p HAVING count(*) >= 10""")
def c_comparisons(lineitem):
    return C.result_caveats(supplier_tests(lineitem))


@query("c_non_finite", "lineitem", sql="""
WITH g AS (SELECT l_orderkey, sum(l_extendedprice) AS a, sum(l_discount) AS b FROM lineitem GROUP BY 1)
SELECT count(*) AS rows, 'non-finite' AS code, 'serious' AS severity, true AS fatal,
  'ratio holds ' || CAST(count_if(b = 0) AS BIGINT) || ' values that are not finite numbers' AS message FROM g""")
def c_non_finite(lineitem):
    groups = lineitem.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("a"), F.sum("l_discount").alias("b"))
    return C.result_caveats(groups.select("l_orderkey", float_div(F.col("a"), F.col("b")).alias("ratio")))


@query("c_singleton_groups", "lineitem", sql="""
WITH g AS (SELECT l_orderkey, stddev_samp(l_quantity) AS std_quantity FROM lineitem GROUP BY 1)
SELECT count(*) AS rows, 'singleton-groups' AS code, 'warning' AS severity, false AS fatal,
  CAST(count_if(std_quantity IS NULL OR std_quantity = 0) AS BIGINT) || ' of ' || count(*)
  || ' groups have no spread in std_quantity: they hold a single row' AS message FROM g""")
def c_singletons(lineitem):
    return C.result_caveats(lineitem.groupBy("l_orderkey").agg(F.stddev_samp("l_quantity").alias("std_quantity")))


@query("c_empty_result", "customer", sql="""
SELECT count(*) AS rows, 'empty-result' AS code, 'serious' AS severity, true AS fatal, 'null in every row: mean_rank' AS message
FROM (SELECT c_mktsegment, avg(TRY_CAST(c_name AS DOUBLE)) AS x FROM customer GROUP BY 1) HAVING count(x) = 0""")
def c_empty(customer):
    return C.result_caveats(
        customer.groupBy("c_mktsegment").agg(F.avg(F.col("c_name").try_cast("double")).alias("mean_rank")))


@query("c_short_trend", "orders", sql="""
WITH y AS (SELECT count(DISTINCT year(o_orderdate) // 10) AS n FROM orders)
SELECT n AS rows, 'short-trend' AS code, 'warning' AS severity, false AS fatal,
       n || ' points are too few to show a direction' AS message FROM y WHERE n < 3""")
def c_trend(orders):
    decades = orders.groupBy(F.floor(F.year("o_orderdate") / 10).alias("decade")).agg(F.avg("o_totalprice").alias("price"))
    return C.result_caveats(decades, "growth of prices by decade").where(F.col("code").isNotNull())


@query("c_verdict", "events", sql="""
WITH g AS (SELECT user_id, count(*) AS n, stddev_samp(value) AS sd, max(value) AS hi FROM events GROUP BY 1),
c AS (SELECT user_id, CASE WHEN n < 80 THEN 0.15 ELSE 0 END AS w1, CASE WHEN hi > 300 THEN 0.30 ELSE 0 END AS w2,
             user_id % 10 = 0 AS void FROM g)
SELECT user_id, CAST(w1 > 0 AS BIGINT) + CAST(w2 > 0 AS BIGINT) + CAST(void AS BIGINT) AS caveats, NOT void AS answered,
  CASE WHEN void THEN 'unsound' WHEN w1 + w2 > 0 THEN 'qualified' ELSE 'sound' END AS verdict,
  round(CAST((1 - w1) * (1 - w2) * CASE WHEN void THEN 0.7 * 0.2 ELSE 1 END AS DOUBLE) - 1e-12, 2) AS confidence FROM c""")
def c_verdict(events):
    groups = events.groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("hi"))

    def caveat(test, code, severity, fatal=False):
        return F.when(
            test,
            F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(fatal).alias("fatal")),
        )

    found = F.array_compact(
        F.array(
            caveat(F.col("n") < 80, "tiny-groups", "warning"),
            caveat(F.col("hi") > 300, "mean-on-skewed", "serious"),
            caveat(F.col("user_id") % 10 == 0, "empty-result", "serious", True),
        )
    )
    rows = groups.select("user_id", F.lit(None).cast("boolean").alias("answered"), F.inline_outer(found))
    return C.verdicts(rows, ["user_id"])


# ---- workflows -----------------------------------------------------------------------------------

_LINEITEM = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"
).split()
_FIRST = """SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls,
  round((count(*) - count({c})) / count(*), 6) AS null_rate, count(DISTINCT {c}) AS "distinct" FROM lineitem"""


@query("w1_first_look", "lineitem", sql="SELECT * FROM (" + " UNION ALL ".join(
    _FIRST.replace("{c}", c) for c in _LINEITEM) + """),
  (SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicate_rows),
  (SELECT count(*) AS duplicated_keys FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1))""")
def w1(lineitem):
    df = W.first_look(lineitem, "l_orderkey")
    return df.withColumn("null_rate", F.round("null_rate", 6))


@query("w2_metric_change", "orders", sql="""
WITH o AS (SELECT o_orderpriority, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS r, year(o_orderdate) AS y FROM orders)
SELECT o_orderpriority, CAST(sum(r) FILTER (y = 1999) AS DOUBLE) AS current_revenue, CAST(sum(r) FILTER (y = 1998) AS DOUBLE) AS prior_revenue,
  count(DISTINCT o_orderkey) FILTER (y = 1999) AS current_orders, count(DISTINCT o_orderkey) FILTER (y = 1998) AS prior_orders,
  CAST(sum(r) FILTER (y = 1999) - sum(r) FILTER (y = 1998) AS DOUBLE) AS delta,
  round(CAST(sum(r) FILTER (y = 1999) AS DOUBLE) / count(DISTINCT o_orderkey) FILTER (y = 1999), 4) AS current_aov,
  round(CAST(sum(r) FILTER (y = 1998) AS DOUBLE) / count(DISTINCT o_orderkey) FILTER (y = 1998), 4) AS prior_aov
FROM o WHERE y IN (1998, 1999) GROUP BY 1""")
def w2(orders):
    year = F.year("o_orderdate")
    df = W.metric_change(money(orders, "o_totalprice"), "o_orderpriority", year == 1999, year == 1998, "o_totalprice", "o_orderkey")
    df = as_double(df, "current_revenue", "prior_revenue", "delta")
    return df.withColumns({
        f"{p}_aov": F.round(F.col(f"{p}_revenue") / F.col(f"{p}_orders"), 4) for p in ("current", "prior")
    })


@query("w3_mix_shift", "orders", sql="""
WITH c AS (SELECT o_orderpriority, year(o_orderdate) AS period, count(DISTINCT o_orderkey) AS orders FROM orders
           WHERE year(o_orderdate) IN (1998, 1999) GROUP BY 1, 2)
SELECT o_orderpriority, period, orders, round(orders / sum(orders) OVER (PARTITION BY period), 8) AS share_of_orders FROM c""")
def w3(orders):
    year = F.year("o_orderdate").cast("long")
    df = W.mix_shift(orders, "o_orderpriority", F.when(year.isin(1998, 1999), year), "o_orderkey")
    return df.withColumn("share_of_orders", F.round("share_of_orders", 8))


@query("w4_segment_summary", "orders", "customer", sql="""
WITH j AS (SELECT c_mktsegment, o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS r FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT c_mktsegment, count(DISTINCT o_custkey) AS customers, CAST(sum(r) AS DOUBLE) AS total_revenue,
  round(CAST(sum(r) AS DOUBLE) / count(r), 4) AS avg_revenue_per_order,
  round(CAST(sum(r) AS DOUBLE) / count(DISTINCT o_custkey), 4) AS revenue_per_customer,
  round(CAST(sum(r) AS DOUBLE) / (SELECT CAST(sum(r) AS DOUBLE) FROM j) * 100, 1) AS pct_of_total FROM j GROUP BY 1""")
def w4(orders, customer):
    joined = money(orders, "o_totalprice").join(
        customer.select("c_custkey", "c_mktsegment"), orders["o_custkey"] == customer["c_custkey"]
    )
    df = as_double(W.segment_summary(joined, "c_mktsegment", "o_custkey", "o_totalprice"), "total_revenue")
    return df.withColumns({c: F.round(c, 4) for c in ("avg_revenue_per_order", "revenue_per_customer")})


@query("w5_kpis", "orders", sql="""
SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue, count(DISTINCT o_orderkey) AS total_orders,
  count(DISTINCT o_custkey) AS total_customers,
  round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(DISTINCT o_orderkey), 2) AS avg_order_value,
  round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(DISTINCT o_custkey), 2) AS revenue_per_customer FROM orders""")
def w5(orders):
    return as_double(W.kpis(money(orders, "o_totalprice"), "o_totalprice", "o_orderkey", "o_custkey"), "total_revenue")


@query("w6_quality_sweep", "customer", "orders", sql="""
WITH d AS (SELECT o_custkey, o_orderdate, nullif(o_orderdate, (SELECT min(o_orderdate) FROM orders)) AS day, c_acctbal
           FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT 'missing_dates' AS issue, CAST(count_if(day IS NULL) AS BIGINT) AS n FROM d
UNION ALL SELECT 'negative_measures', CAST(count_if(c_acctbal < 0) AS BIGINT) FROM d
UNION ALL SELECT 'future_dates', CAST(count_if(day > TIMESTAMP '2001-01-01') AS BIGINT) FROM d
UNION ALL SELECT 'duplicated_keys', count(*) FROM (SELECT o_custkey FROM d GROUP BY 1 HAVING count(*) > 1)""")
def w6(customer, orders):
    first = orders.agg(F.min("o_orderdate").alias("first_day"))
    df = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(F.broadcast(first))
    df = df.withColumn("day", F.nullif("o_orderdate", F.col("first_day")))
    today = F.lit("2001-01-01").cast("timestamp_ntz")
    return W.quality_sweep(df, "o_custkey", "day", "c_acctbal", today)


@query("w7_yoy_decomposition", "orders", sql="""
WITH o AS (SELECT o_orderpriority, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS r, o_orderdate AS d FROM orders)
SELECT o_orderpriority, o_orderstatus,
  CAST(sum(r) FILTER (d BETWEEN TIMESTAMP '2000-04-01' AND TIMESTAMP '2000-06-30') AS DOUBLE) AS this_period,
  CAST(sum(r) FILTER (d BETWEEN TIMESTAMP '1999-04-01' AND TIMESTAMP '1999-06-30') AS DOUBLE) AS last_period,
  round(CAST(sum(r) FILTER (d BETWEEN TIMESTAMP '2000-04-01' AND TIMESTAMP '2000-06-30')
    - sum(r) FILTER (d BETWEEN TIMESTAMP '1999-04-01' AND TIMESTAMP '1999-06-30') AS DOUBLE)
    / CAST(sum(r) FILTER (d BETWEEN TIMESTAMP '1999-04-01' AND TIMESTAMP '1999-06-30') AS DOUBLE) * 100, 1) AS yoy_pct
FROM o WHERE d BETWEEN TIMESTAMP '2000-04-01' AND TIMESTAMP '2000-06-30' OR d BETWEEN TIMESTAMP '1999-04-01' AND TIMESTAMP '1999-06-30'
GROUP BY 1, 2""")
def w7(orders):
    d = F.col("o_orderdate")

    def window(a, b):
        return d.between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz"))

    df = W.yoy_decomposition(
        money(orders, "o_totalprice"), ["o_orderpriority", "o_orderstatus"], "o_totalprice",
        window("2000-04-01", "2000-06-30"), window("1999-04-01", "1999-06-30"),
    )
    return as_double(df, "this_period", "last_period")


# ---- chart data ----------------------------------------------------------------------------------


@query("v1_prepare", "orders", sql="""
SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, o_orderpriority,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'P') AS DOUBLE) AS pending
FROM orders GROUP BY 1, 2 HAVING sum(o_totalprice) FILTER (o_orderstatus = 'P') IS NOT NULL""")
def v1(orders):
    pending = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))
    df = money(orders, "o_totalprice").groupBy(F.date_trunc("month", "o_orderdate").alias("month"), "o_orderpriority").agg(
        F.sum(pending).alias("pending"), F.count("*").alias("n")
    )
    return as_double(day(V.prepare(df, V.ChartSpec("line", "month", "pending", "o_orderpriority")), "month"), "pending")


@query("v3_fold_categories", "part", "lineitem", sql="""
WITH t AS (SELECT p_brand, sum(CAST(l_quantity AS BIGINT)) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY qty DESC, p_brand) AS rn FROM t)
SELECT CASE WHEN rn < 20 THEN p_brand ELSE 'other' END AS p_brand, CAST(sum(qty) AS BIGINT) AS qty FROM r GROUP BY 1""")
def v3(part, lineitem):
    totals = (
        lineitem.join(part.select("p_partkey", "p_brand"), lineitem["l_partkey"] == part["p_partkey"])
        .groupBy("p_brand").agg(F.sum(F.col("l_quantity").cast("long")).alias("qty"))
    )
    return V.prepare(totals, V.ChartSpec("bar", "p_brand", "qty"))


@query("v4_fold_series", "part", sql="""
WITH t AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rn FROM part GROUP BY 1)
SELECT p_size, p_retailprice, CASE WHEN rn < 8 THEN p_brand ELSE 'other' END AS p_brand FROM part JOIN t USING (p_brand)""")
def v4(part):
    return V.prepare(part, V.ChartSpec("line", "p_size", "p_retailprice", "p_brand"))


@query("v5_default_spec", "orders", sql="""
WITH facts AS (SELECT count(DISTINCT date_trunc('month', o_orderdate)) AS months, count(DISTINCT o_orderstatus) AS classes FROM orders)
SELECT 'monthly' AS title, 'line' AS form, 'month' AS x, 'total_measure' AS y, NULL::VARCHAR AS series FROM facts WHERE months > 1
UNION ALL SELECT 'status', CASE WHEN classes <= 8 THEN 'column' ELSE 'bar' END, 'o_orderstatus', 'total_measure', NULL FROM facts
UNION ALL SELECT 'pairs', 'bar', 'o_orderpriority', 'avg_measure', 'o_orderstatus' FROM facts""")
def v5(orders):
    monthly = R.over_time(orders, "o_orderdate", "o_totalprice").df
    by_status = R.total_by_category(orders, "o_orderstatus", "o_totalprice").df
    pairs = R.two_categories(orders, "o_orderpriority", "o_orderstatus", "o_totalprice").df.drop("n")
    specs = [V.default_spec(df, q) for q, df in (("monthly", monthly), ("status", by_status), ("pairs", pairs))]
    rows = [(s.title, s.form, s.x, s.y, s.series) for s in specs]
    return orders.sparkSession.createDataFrame(rows, "title string, form string, x string, y string, series string")


# ---- planted traps -------------------------------------------------------------------------------


@query("x1_simpson", "lineitem", sql="""
WITH c AS (SELECT l_linenumber AS stratum, sum(l_quantity) FILTER (l_linestatus = 'F') AS s0, count(*) FILTER (l_linestatus = 'F') AS n0,
  sum(l_quantity) FILTER (l_linestatus = 'O') AS s1, count(*) FILTER (l_linestatus = 'O') AS n1 FROM lineitem GROUP BY 1),
o AS (SELECT sum(s0) / sum(n0) - sum(s1) / sum(n1) AS overall_gap FROM c)
SELECT stratum, round(s0 / n0 - s1 / n1, 6) AS gap, round(overall_gap, 6) AS overall_gap,
       sign(s0 / n0 - s1 / n1) * sign(overall_gap) < 0 AS reversed FROM c, o""")
def x1(lineitem):
    df = X.simpson(lineitem, "l_linenumber", "l_linestatus", "F", "O", "l_quantity")
    return df.withColumns({c: F.round(c, 6) for c in ("gap", "overall_gap")})


@query("x2_missing_by_group", "lineitem", sql="""
SELECT l_returnflag, count(*) AS n, round(avg(CASE WHEN l_discount = 0 THEN 1.0 ELSE 0 END), 6) AS missing_rate FROM lineitem GROUP BY 1""")
def x2(lineitem):
    df = X.missing_by_group(lineitem.withColumn("d", F.nullif("l_discount", F.lit(0.0))), "l_returnflag", "d")
    return df.withColumn("missing_rate", F.round("missing_rate", 6))


@query("x4_small_groups", "orders", sql="""
SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) < 5""")
def x4(orders):
    return X.small_groups(orders, "o_custkey")


@query("x6_corr_text", "lineitem", sql="""
SELECT CAST(count_if(l_linenumber <> 3) AS BIGINT) AS n,
       round(corr(l_quantity, l_extendedprice) FILTER (l_linenumber <> 3), 8) AS r FROM lineitem""")
def x6(lineitem):
    df = lineitem.select(
        F.col("l_quantity").cast("string").alias("a"),
        F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("l_extendedprice").cast("string")).alias("b"),
    )
    return X.corr_text(df, "a", "b").withColumn("r", F.round("r", 8))
