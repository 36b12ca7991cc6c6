"""G1-G44: general table operators."""

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from queries.base import query
from queries.recipe_queries import as_double, day, money
from tablewise.functions.numeric import clip, lenient_double
from tablewise.functions.text import replace_first, strip
from tablewise.operators import analysis as A
from tablewise.operators.ordered import running
from tablewise.operators import ordered
from tablewise.operators import table_ops as G


@query("g01_select", "customer", sql="""
SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment AS segment FROM customer""")
def g01(customer):
    keys = G.select_matching(customer, "^c_").drop("c_name")
    return keys.withColumnsRenamed({"c_mktsegment": "segment"}).select(
        *G.select_types(keys, T.NumericType).columns, "segment"
    )


@query("g02_filter", "lineitem", sql="""
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 10 AND 20 AND NOT l_linestatus = 'O'
  AND l_shipdate IS NOT NULL AND regexp_matches(l_returnflag, '^[A-M]') AND isfinite(l_extendedprice)""")
def g02(lineitem):
    price = F.col("l_extendedprice")
    return lineitem.where(
        F.col("l_returnflag").isin("A", "R")
        & F.col("l_quantity").between(10, 20)
        & ~(F.col("l_linestatus") == "O")
        & F.col("l_shipdate").isNotNull()
        & F.col("l_returnflag").rlike("^[A-M]")
        & ~F.isnan(price)
        & (F.abs(price) != float("inf"))
    ).select("l_orderkey", "l_linenumber", "l_quantity")


@query("g03_slice", "orders", sql="""
(SELECT 'head' AS part, o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5)
UNION ALL (SELECT 'tail', o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 5)
UNION ALL (SELECT 'slice', o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 100)""")
def g03(orders):
    keys = orders.select("o_orderkey")

    def part(name, df):
        return df.select(F.lit(name).alias("part"), "o_orderkey")

    order = ["o_orderkey"]
    return (
        part("head", G.head(keys, order, 5))
        .unionByName(part("tail", G.tail(keys, order, 5)))
        .unionByName(part("slice", G.slice_rows(keys, order, 100, 5)))
    )


_DRAWN = "('0x' || substr(md5('3:' || o_orderkey), 1, 8))::BIGINT"


@query("g04_sample", "orders", sql=f"""
(SELECT 'n' AS kind, o_orderkey FROM orders ORDER BY {_DRAWN}, o_orderkey LIMIT 500)
UNION ALL SELECT 'share', o_orderkey FROM orders WHERE {_DRAWN} < floor(0.05 * 4294967296)""")
def g04(orders):
    exact = G.sample_rows(orders, "o_orderkey", 500, seed=3).select(F.lit("n").alias("kind"), "o_orderkey")
    share = G.sample_share(orders, "o_orderkey", 0.05, seed=3).select(F.lit("share").alias("kind"), "o_orderkey")
    return exact.unionByName(share)


@query("g05_sort", "customer", sql="""
SELECT c_mktsegment, c_acctbal, c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) AS place FROM customer""")
def g05(customer):
    rows = customer.withColumn("_down", -F.col("c_acctbal"))
    placed = running(rows, [], ["c_mktsegment", "_down", "c_custkey"], sums={"place": F.lit(1).cast("long")})
    return placed.select("c_mktsegment", "c_acctbal", "c_custkey", "place")


@query("g06_top_k", "orders", sql="""
(SELECT 'top' AS part, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7)
UNION ALL (SELECT 'bottom', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 7)""")
def g06(orders):
    df = orders.select("o_orderkey", "o_totalprice")
    top = df.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(7)
    bottom = df.orderBy("o_totalprice", "o_orderkey").limit(7)
    return top.select(F.lit("top").alias("part"), "*").unionByName(bottom.select(F.lit("bottom").alias("part"), "*"))


@query("g07_math", "part", sql="""
SELECT p_partkey, p_size + 1 AS plus, p_size % 7 AS rem, round(pow(p_size, 2), 4) AS squared,
       round(sqrt(p_size), 6) AS root, round(ln(p_size), 6) AS logged, abs(p_size - 25) AS gap,
       least(greatest(p_size, 10), 40) AS clipped, round(p_retailprice * 1.5, 2) AS raised FROM part""")
def g07(part):
    size = F.col("p_size")
    return part.select(
        "p_partkey",
        (size + 1).alias("plus"),
        (size % 7).alias("rem"),
        F.round(F.pow(size, F.lit(2)), 4).alias("squared"),
        F.round(F.sqrt(size), 6).alias("root"),
        F.round(F.log(size), 6).alias("logged"),
        F.abs(size - 25).alias("gap"),
        clip(size, 10, 40).alias("clipped"),
        F.round(F.col("p_retailprice") * 1.5, 2).alias("raised"),
    )


@query("g08_case", "customer", sql="""
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'owes' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS tier
FROM customer""")
def g08(customer):
    balance = F.col("c_acctbal")
    tier = F.when(balance < 0, "owes").when(balance < 5000, "some").otherwise("rich")
    return customer.select("c_custkey", tier.alias("tier"))


@query("g09_many_columns", "lineitem", sql="""
SELECT l_orderkey, l_linenumber, round(l_quantity * 100, 2) AS pct_l_quantity,
       round(l_discount * 100, 2) AS pct_l_discount, round(l_tax * 100, 2) AS pct_l_tax FROM lineitem""")
def g09(lineitem):
    cols = ["l_quantity", "l_discount", "l_tax"]
    df = G.map_columns(lineitem, cols, lambda c: F.round(c * 100, 2), prefix="pct_")
    return df.select("l_orderkey", "l_linenumber", *[f"pct_{c}" for c in cols])


@query("g10_aggregates", "orders", sql="""
SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
       round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std,
       round(var_samp(o_totalprice), 0) AS variance, min(o_totalprice) AS low, max(o_totalprice) AS high,
       round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.9), 4) AS p90,
       count(DISTINCT o_custkey) AS customers, arg_min(o_totalprice, o_orderkey) AS first_price,
       arg_max(o_totalprice, o_orderkey) AS last_price,
       (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS usual
FROM orders""")
def g10(orders):
    price = F.col("o_totalprice")
    flat = orders.agg(
        F.count("*").alias("n"),
        F.sum(price.cast("decimal(18,2)")).cast("double").alias("total"),
        F.round(F.avg(price), 4).alias("mean"),
        F.round(F.stddev_samp(price), 4).alias("std"),
        F.round(F.var_samp(price), 0).alias("variance"),
        F.min(price).alias("low"),
        F.max(price).alias("high"),
        F.min_by(price, "o_orderkey").alias("first_price"),
        F.max_by(price, "o_orderkey").alias("last_price"),
    )
    distinct = orders.agg(F.count_distinct("o_custkey").alias("customers"))
    middle = ordered.group_quantiles(orders.select("o_totalprice"), [], "o_totalprice", {"median": 0.5, "p90": 0.9})
    usual = (
        orders.groupBy("o_orderpriority").count()
        .agg(F.min_by("o_orderpriority", F.struct(-F.col("count"), "o_orderpriority")).alias("usual"))
    )
    for one_row in (distinct, middle.select(*[F.round(c, 4).alias(c) for c in ("median", "p90")]), usual):
        flat = flat.join(F.broadcast(one_row))
    return flat


@query("g11_derive", "lineitem", sql="""
WITH d AS (SELECT l_orderkey, l_linenumber, CAST(l_tax AS DECIMAL(18,2)) AS tax,
  round(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))), 2) AS net FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(net AS DOUBLE) AS net, CAST(round(net * (1 + tax), 2) AS DOUBLE) AS gross FROM d""")
def g11(lineitem):
    df = money(lineitem, "l_extendedprice", "l_discount", "l_tax")
    df = df.withColumn("net", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2))
    df = df.withColumn("gross", F.round(F.col("net") * (1 + F.col("l_tax")), 2))
    return as_double(df, "net", "gross").select("l_orderkey", "l_linenumber", "net", "gross")


@query("g12_casts", "orders", sql="""
SELECT o_orderkey, CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE) AS strict,
       TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE CAST(o_orderkey AS VARCHAR) END AS DOUBLE) AS lenient,
       strftime(o_orderdate, '%Y%m%d')::BIGINT AS daykey FROM orders""")
def g12(orders):
    key = F.col("o_orderkey")
    return orders.select(
        "o_orderkey",
        F.col("o_totalprice").cast("string").cast("double").alias("strict"),
        lenient_double(F.when(key % 3 == 0, "x").otherwise(key.cast("string"))).alias("lenient"),
        F.date_format("o_orderdate", "yyyyMMdd").cast("long").alias("daykey"),
    )


@query("g13_unique", "orders", sql="""
SELECT o_custkey, o_orderkey, o_orderstatus FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders
  WHERE o_orderstatus <> 'P') WHERE rn = 1""")
def g13(orders):
    df = orders.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P"))).dropna(subset=["o_orderstatus"])
    return G.unique_first(df.select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"])


@query("g13_distinct", "lineitem", sql="SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def g13_distinct(lineitem):
    return lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("g14_struct", "nation", sql="""
SELECT n_nationkey, n_name AS name, n_regionkey AS region, n_name || '!' AS loud FROM nation""")
def g14(nation):
    packed = nation.select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("s"))
    return packed.select("n_nationkey", "s.*", F.concat(F.col("s").getField("name"), F.lit("!")).alias("loud"))


@query("g15_lists", "lineitem", sql="""
WITH p AS (SELECT *, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) // 100000 AS part
           FROM lineitem),
g AS (SELECT l_orderkey, part, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS v
      FROM p GROUP BY 1, 2)
SELECT l_orderkey, part, len(v) AS n, v[1] AS head, v[3] AS third, list_contains(v, 7) AS has_seven, list_max(v) AS high,
       list_sum(v)::BIGINT AS total, len(list_distinct(v)) AS kinds, array_to_string(v, '-') AS joined,
       array_to_string(list_sort(v), '-') AS in_order FROM g""")
def g15(lineitem):
    df = lineitem.withColumn("q", F.col("l_quantity").cast("long"))
    v = F.col("values")
    text = v.cast("array<string>")
    return G.list_per_group(df, ["l_orderkey"], "q", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select(
        "l_orderkey",
        "part",
        F.size(v).cast("long").alias("n"),
        F.get(v, F.lit(0)).alias("head"),
        F.get(v, F.lit(2)).alias("third"),
        F.array_contains(v, 7).alias("has_seven"),
        F.array_max(v).alias("high"),
        F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
        F.size(F.array_distinct(v)).cast("long").alias("kinds"),
        F.array_join(text, "-").alias("joined"),
        F.array_join(F.sort_array(v).cast("array<string>"), "-").alias("in_order"),
    )


@query("g15_explode", "documents", sql="""
SELECT word, count(*) AS n FROM (SELECT unnest(string_split(source, 'r')) AS word FROM documents) GROUP BY 1""")
def g15_explode(documents):
    words = documents.select(F.explode(F.split("source", "r")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


@query("g16_strings", "part", sql="""
SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, trim('  ' || p_name || ' ') AS stripped,
       length(p_name) AS chars, contains(p_name, 'ring') AS has_ring, starts_with(p_brand, 'Brand#1') AS starts,
       ends_with(p_name, 'et') AS ends, replace(p_name, 'e', '3') AS swapped_all,
       regexp_replace(p_name, 'e', '3') AS swapped_one, split_part(p_name, ' ', 2) AS second,
       substring(p_type, 1, 3) AS cut, lpad(CAST(p_size AS VARCHAR), 4, '0') AS filled,
       regexp_extract(p_brand, '(\\d+)', 1) AS digits, p_brand || '/' || p_type AS joined FROM part""")
def g16(part):
    name = F.col("p_name")
    return part.select(
        "p_partkey",
        F.upper(name).alias("up"),
        F.lower("p_brand").alias("low"),
        strip(F.concat(F.lit("  "), name, F.lit("\t "))).alias("stripped"),
        F.char_length(name).cast("long").alias("chars"),
        name.contains("ring").alias("has_ring"),
        F.col("p_brand").startswith("Brand#1").alias("starts"),
        name.endswith("et").alias("ends"),
        F.replace(name, F.lit("e"), F.lit("3")).alias("swapped_all"),
        replace_first(name, "e", "3").alias("swapped_one"),
        F.get(F.split(name, " "), F.lit(1)).alias("second"),
        F.substring("p_type", 1, 3).alias("cut"),
        F.lpad(F.col("p_size").cast("string"), 4, "0").alias("filled"),
        F.regexp_extract("p_brand", r"(\d+)", 1).alias("digits"),
        F.concat_ws("/", "p_brand", "p_type").alias("joined"),
    )


@query("g17_dates", "orders", sql="""
SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d,
       isodow(o_orderdate) AS dow, weekofyear(o_orderdate) AS week, quarter(o_orderdate) AS q,
       strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week_start,
       strftime(o_orderdate, '%d/%m/%Y') AS shown, datediff('day', TIMESTAMP '1995-01-01', o_orderdate) AS age,
       strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS due FROM orders""")
def g17(orders):
    d = F.col("o_orderdate")

    def whole(c):
        return c.cast("long")

    return orders.select(
        "o_orderkey",
        whole(F.year(d)).alias("y"),
        whole(F.month(d)).alias("m"),
        whole(F.dayofmonth(d)).alias("d"),
        whole(F.weekday(d) + 1).alias("dow"),
        whole(F.weekofyear(d)).alias("week"),
        whole(F.quarter(d)).alias("q"),
        F.date_format(F.date_trunc("week", d), "yyyy-MM-dd").alias("week_start"),
        F.date_format(d, "dd/MM/yyyy").alias("shown"),
        whole(F.datediff(d, F.lit("1995-01-01"))).alias("age"),
        F.date_format(d + F.expr("INTERVAL 10 DAYS"), "yyyy-MM-dd").alias("due"),
    )


@query("g17_date_range", "orders", sql="""
SELECT strftime(d, '%Y-%m-%d') AS d FROM (
  SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate), INTERVAL 1 MONTH)) AS d FROM orders)""")
def g17_range(orders):
    ends = orders.agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    first = F.trunc("a", "month")
    months = ends.select(F.explode(F.sequence(first, F.to_date("b"), F.expr("INTERVAL 1 MONTH"))).alias("d"))
    return day(months, "d")


@query("g18_group_by", "lineitem", sql="""
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty,
       round(avg(l_discount), 6) AS avg_discount, strftime(min(l_shipdate), '%Y-%m-%d') AS first_day,
       array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS numbers
FROM lineitem GROUP BY 1, 2""")
def g18(lineitem):
    df = money(lineitem, "l_quantity").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"),
        F.sum("l_quantity").cast("double").alias("qty"),
        F.round(F.avg("l_discount"), 6).alias("avg_discount"),
        F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("first_day"),
        F.array_join(F.sort_array(F.collect_set("l_linenumber")).cast("array<string>"), ",").alias("numbers"),
    )
    return df


@query("g19_time_bucket", "events", sql="""
SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M') AS bucket, event_type, count(*) AS n,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2""")
def g19(events):
    df = G.bucketed(
        money(events, "value"), "ts", "15m", ["event_type"], n=F.count("*"), total=F.sum("value").cast("double")
    )
    return df.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm"))


@query("g19_time_bucket_calendar", "orders", sql="""
SELECT strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS bucket, 'week' AS every, count(*) AS n FROM orders GROUP BY 1
UNION ALL SELECT strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d'), 'quarter', count(*) FROM orders GROUP BY 1
UNION ALL SELECT strftime(date_trunc('year', o_orderdate), '%Y-%m-%d'), 'year', count(*) FROM orders GROUP BY 1""")
def g19_calendar(orders):
    parts = [
        day(G.bucketed(orders, "o_orderdate", size, n=F.count("*")), "bucket").select("bucket", F.lit(name).alias("every"), "n")
        for size, name in (("1w", "week"), ("3mo", "quarter"), ("1y", "year"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("g20_resample", "events", sql="""
WITH c AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1),
s AS (SELECT unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM c)
SELECT strftime(h, '%Y-%m-%d %H') AS bucket, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (h)""")
def g20(events):
    errors = events.where("event_type = 'error'")
    df = G.resampled(errors, "ts", "INTERVAL 1 HOUR", "1h", n=F.count("*"))
    return df.select(F.date_format("bucket", "yyyy-MM-dd HH").alias("bucket"), F.coalesce("n", F.lit(0)).alias("n"))


@query("g21_rolling_time", "events", sql="""
SELECT event_id, round(CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE), 2) AS rolling_sum, count(*) OVER w AS rolling_n
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts
  RANGE BETWEEN INTERVAL 86399999999 MICROSECONDS PRECEDING AND CURRENT ROW)""")
def g21(events):
    df = G.rolling_time(events, "ts", "event_id", 86_400, "value", ["user_id"])
    return df.select("event_id", F.round("rolling_sum", 2).alias("rolling_sum"), "rolling_n")


def rolling_columns(w):
    frame = w.rowsBetween(-4, 0)
    full = F.count("*").over(frame) == 5
    return {
        "roll_sum": F.when(full, F.sum("value").over(frame)).cast("double"),
        "roll_mean": F.when(full, F.round(F.avg(F.col("value").cast("double")).over(frame), 3)),
        "roll_std": F.when(full, F.round(F.stddev_samp(F.col("value").cast("double")).over(frame), 6)),
    }


@query("g22_rolling_rows", "events", sql="""
SELECT event_id, CASE WHEN count(*) OVER w = 5 THEN CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) END AS roll_sum,
       CASE WHEN count(*) OVER w = 5 THEN round(avg(value) OVER w, 3) END AS roll_mean,
       CASE WHEN count(*) OVER w = 5 THEN round(stddev_samp(value) OVER w, 6) END AS roll_std
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def g22(events):
    df = ordered.look_back(money(events, "value"), ["user_id"], ["ts", "event_id"], rolling_columns, 4)
    return df.select("event_id", "roll_sum", "roll_mean", "roll_std")


@query("g23_cumulative", "events", sql="""
SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS total_by_user,
       CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (ORDER BY ts, event_id) AS DOUBLE) AS total FROM events""")
def g23(events):
    df = money(events, "value")
    df = ordered.running(df, ["user_id"], ["ts", "event_id"], sums={"total_by_user": F.col("value")})
    df = ordered.running(df, [], ["ts", "event_id"], sums={"total": F.col("value")})
    return as_double(df, "total_by_user", "total").select("event_id", "total_by_user", "total")


@query("g24_pivot", "lineitem", sql="""
SELECT l_linenumber, count(*) FILTER (l_returnflag = 'A') AS A, count(*) FILTER (l_returnflag = 'N') AS N,
       count(*) FILTER (l_returnflag = 'R') AS R FROM lineitem GROUP BY 1""")
def g24(lineitem):
    return G.pivot(lineitem, ["l_linenumber"], "l_returnflag", ["A", "N", "R"], F.count(F.lit(1))).fillna(0)


@query("g24_unpivot", "lineitem", sql="""
SELECT l_orderkey, l_linenumber, unnest(['l_quantity', 'l_discount', 'l_tax']) AS measure,
       unnest([l_quantity, l_discount, l_tax]) AS value FROM lineitem""")
def g24_unpivot(lineitem):
    return G.unpivot(lineitem, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "measure", "value")


@query("g25_window_share", "orders", sql="""
SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_orderpriority, o_orderstatus) AS DOUBLE) AS group_total,
       round(o_totalprice / CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_orderpriority, o_orderstatus) AS DOUBLE), 10) AS share
FROM orders""")
def g25(orders):
    df = A.share_in_group(money(orders, "o_totalprice"), ["o_orderpriority", "o_orderstatus"], "o_totalprice")
    return as_double(df, "group_total").select("o_orderkey", "group_total", F.round("share", 10).alias("share"))


@query("g26_rank", "orders", sql="""
SELECT o_orderkey, rank() OVER w AS rank_min,
       rank() OVER w + (count(*) OVER (PARTITION BY o_custkey, o_orderpriority) - 1) / 2.0 AS rank_avg,
       dense_rank() OVER w AS rank_dense, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def g26(orders):
    df = A.ranked(orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate"), ["o_custkey"], "o_orderpriority", descending=False)
    df = ordered.running(df, ["o_custkey"], ["o_orderdate", "o_orderkey"], sums={"seq": F.lit(1).cast("long")})
    return df.select("o_orderkey", "rank_min", "rank_avg", "rank_dense", "seq")


@query("g26_first_last", "orders", sql="""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 AS is_first,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_last FROM orders""")
def g26_first(orders):
    at = F.struct("o_orderdate", "o_orderkey")
    df = ordered.group_totals(orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], lo=F.min(at), hi=F.max(at))
    return df.select("o_orderkey", (at == F.col("lo")).alias("is_first"), (at == F.col("hi")).alias("is_last"))


@query("g27_lag_diff", "events", sql="""
SELECT event_id, CAST(CAST(value AS DECIMAL(18,2)) - lag(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS change
FROM events""")
def g27(events):
    df = ordered.look_back(
        money(events, "value"), ["user_id"], ["ts", "event_id"], lambda w: {"before": F.lag("value").over(w)}, 1
    )
    return df.select("event_id", (F.col("value") - F.col("before")).cast("double").alias("change"))


@query("g28_group_outlier", "events", sql="""
SELECT event_id, coalesce(value > avg(value) OVER w + 3 * stddev_samp(value) OVER w, false) AS is_outlier
FROM events WINDOW w AS (PARTITION BY event_type)""")
def g28(events):
    return A.group_outliers(events, ["event_type"], "value").select("event_id", "is_outlier")


@query("g29_join_inner", "lineitem", "orders", sql="""
SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def g29_inner(lineitem, orders):
    return lineitem.join(orders, lineitem["l_orderkey"] == orders["o_orderkey"]).select(
        "l_orderkey", "l_linenumber", "o_orderstatus"
    )


@query("g29_join_left", "customer", "orders", sql="""
SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'""")
def g29_left(customer, orders):
    pending = orders.where("o_orderstatus = 'P'")
    return customer.join(pending, customer["c_custkey"] == pending["o_custkey"], "left").select("c_custkey", "o_orderkey")


@query("g29_join_full", "customer", "supplier", sql="""
WITH a AS (SELECT nullif(c_nationkey, 3) AS k, count(*) AS customers FROM customer WHERE c_nationkey < 15 GROUP BY 1),
b AS (SELECT nullif(s_nationkey, 20) AS k, count(*) AS suppliers FROM supplier WHERE s_nationkey > 5 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, customers, suppliers FROM a FULL JOIN b ON a.k = b.k""")
def g29_full(customer, supplier):
    a = customer.where("c_nationkey < 15").groupBy(F.nullif("c_nationkey", F.lit(3)).alias("k")).agg(F.count("*").alias("customers"))
    b = supplier.where("s_nationkey > 5").groupBy(F.nullif("s_nationkey", F.lit(20)).alias("k")).agg(F.count("*").alias("suppliers"))
    return G.join_full(a, b, ["k"])


@query("g29_join_semi", "customer", "orders", sql="""
SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def g29_semi(customer, orders):
    big = orders.where("o_totalprice > 400000")
    return customer.join(big, customer["c_custkey"] == big["o_custkey"], "left_semi").select("c_custkey")


@query("g29_join_anti", "customer", "orders", sql="""
SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def g29_anti(customer, orders):
    big = orders.where("o_totalprice > 400000")
    return customer.join(big, customer["c_custkey"] == big["o_custkey"], "left_anti").select("c_custkey")


@query("g29_join_cross", "orders", "customer", sql="""
SELECT month, c_mktsegment FROM (SELECT DISTINCT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month FROM orders),
  (SELECT DISTINCT c_mktsegment FROM customer)""")
def g29_cross(orders, customer):
    months = orders.select(F.date_format(F.trunc("o_orderdate", "month"), "yyyy-MM-dd").alias("month")).distinct()
    return G.cross_join(months, customer.select("c_mktsegment").distinct())


@query("g29_join_multi_key", "lineitem", sql="""
SELECT a.l_orderkey, a.l_partkey, a.l_suppkey, n FROM lineitem a JOIN (
  SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) b USING (l_partkey, l_suppkey) WHERE n > 1""")
def g29_multi(lineitem):
    pairs = lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).where("n > 1")
    return lineitem.select("l_orderkey", "l_partkey", "l_suppkey").join(pairs, ["l_partkey", "l_suppkey"])


@query("g30_asof", "events", sql="""
WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id, ts, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY 1, 2)
SELECT l.event_id, r.click_id, strftime(r.ts, '%Y-%m-%d %H:%M:%S') AS clicked
FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def g30(events):
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = (
        events.where("event_type = 'click'")
        .groupBy("user_id", F.col("ts").alias("click_ts"))
        .agg(F.max("event_id").alias("click_id"))
    )
    df = G.asof_join(left, right, "ts", "click_ts", ["user_id"])
    return df.select("event_id", "click_id", F.date_format("click_ts", "yyyy-MM-dd HH:mm:ss").alias("clicked"))


@query("g30_asof_no_key", "events", sql="""
WITH l AS (SELECT event_id, ts FROM events WHERE event_type = 'purchase'),
r AS (SELECT ts, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT l.event_id, r.click_id FROM l ASOF LEFT JOIN r ON l.ts >= r.ts""")
def g30_no_key(events):
    left = events.where("event_type = 'purchase'").select("event_id", "ts")
    right = events.where("event_type = 'click'").groupBy(F.col("ts").alias("click_ts")).agg(F.max("event_id").alias("click_id"))
    return G.asof_join(left, right, "ts", "click_ts").select("event_id", "click_id")


@query("g31_concat", "customer", "supplier", sql="""
SELECT c_custkey AS key, CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal, NULL FROM supplier""")
def g31(customer, supplier):
    a = customer.select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = supplier.select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").cast("long").alias("nation"), F.col("s_acctbal").alias("balance"))
    return G.concat(a, b)


@query("g32_hconcat", "documents", "labels", sql="""
SELECT doc_id, lang, quality FROM documents FULL JOIN labels USING (doc_id)""")
def g32(documents, labels):
    return G.hconcat(documents.select("doc_id", "lang"), labels.select("doc_id", "quality"), "doc_id")


@query("g33_fill", "events", sql="""
WITH e AS (SELECT event_id, user_id, ts, event_type, nullif(floor(value / 5), 3) AS v FROM events)
SELECT event_id, coalesce(v, 0) AS zero, round(coalesce(v, avg(v) OVER ()), 6) AS mean,
       round(coalesce(v, avg(v) OVER (PARTITION BY event_type)), 6) AS group_mean,
       last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS forward FROM e""")
def g33(events):
    v = F.nullif(F.floor(F.col("value") / 5).cast("double"), F.lit(3.0))
    df = events.select("event_id", "user_id", "ts", "event_type", v.alias("v"))
    df = df.withColumns({"zero": F.coalesce("v", F.lit(0.0)), "mean": F.col("v"), "group_mean": F.col("v"), "forward": F.col("v")})
    df = G.fill_mean(df, "mean")
    df = G.fill_mean(df, "group_mean", ["event_type"])
    df = G.fill_forward(df, "forward", ["ts", "event_id"], ["user_id"])
    return df.select("event_id", "zero", F.round("mean", 6).alias("mean"), F.round("group_mean", 6).alias("group_mean"), "forward")


@query("g34_interpolate", "events", sql="""
WITH e AS (SELECT event_id, user_id, ts, nullif(floor(value / 5), 3) AS v,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
f AS (SELECT *, last_value(v IGNORE NULLS) OVER a AS va, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS pa,
             first_value(v IGNORE NULLS) OVER b AS vb, first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pb
      FROM e WINDOW a AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    b AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(coalesce(v, va + (vb - va) * (pos - pa) / nullif(pb - pa, 0)), 6) AS v FROM f""")
def g34(events):
    v = F.nullif(F.floor(F.col("value") / 5).cast("double"), F.lit(3.0))
    df = events.select("event_id", "user_id", "ts", v.alias("v"))
    out = G.interpolate(df, "v", ["ts", "event_id"], ["user_id"])
    return out.select("event_id", F.round("v", 6).alias("v"))


_MEASURES = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split()
_DESCRIBE = """SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  round(var_samp({c}), 2) AS variance, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
  round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS median,
  round(quantile_cont({c}, 0.75), 4) AS p75, round(kurtosis_pop({c}), 3) AS kurtosis,
  round(skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0)), 3) + 0.0 AS skew FROM lineitem"""


@query("g35_describe", "lineitem", sql=" UNION ALL ".join(_DESCRIBE.replace("{c}", c) for c in _MEASURES))
def g35(lineitem):
    df = A.describe(lineitem)
    df = df.withColumns({c: F.round(c, 4) for c in ("mean", "std", "p25", "median", "p75")})
    return df.withColumns({"variance": F.round("variance", 2), "kurtosis": F.round("kurtosis", 3), "skew": F.round("skew", 3) + 0.0})


@query("g36_corr_matrix", "lineitem", sql=" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM lineitem"
    for a in _MEASURES for b in _MEASURES))
def g36(lineitem):
    df = A.correlation_matrix(lineitem)
    return df.withColumn("r", F.round("r", 6) + 0.0)


@query("g37_zscore", "events", sql="""
SELECT event_id, round(z, 6) AS z FROM (
  SELECT event_id, (value - avg(value) OVER ()) / stddev_samp(value) OVER () AS z FROM events) WHERE abs(z) > 3""")
def g37(events):
    df = A.zscores(events, "value").where(F.abs("z") > 3)
    return df.select("event_id", F.round("z", 6).alias("z"))


@query("g38_trend", "orders", sql="""
WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
           FROM orders GROUP BY 1)
SELECT strftime(month, '%Y-%m-%d') AS month, total, round((total - lag(total) OVER w) / lag(total) OVER w, 6) AS mom_growth,
       round(total / lag(total, 12) OVER w - 1, 6) AS yoy_growth,
       CASE WHEN count(*) OVER r = 3 THEN round(avg(total) OVER r, 3) END AS avg_3mo
FROM m WINDOW w AS (ORDER BY month), r AS (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def g38(orders):
    df = A.trend(money(orders, "o_totalprice"), "o_orderdate", "o_totalprice")
    df = as_double(day(df, "month"), "total", "avg_3mo")
    return df.withColumns({"mom_growth": F.round("mom_growth", 6), "yoy_growth": F.round("yoy_growth", 6), "avg_3mo": F.round("avg_3mo", 3)})


@query("g39_welch", "lineitem", sql="""
WITH g AS (SELECT l_linestatus AS k, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1),
w AS (SELECT (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t,
  pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)) AS df
  FROM g a, g b WHERE a.k = 'F' AND b.k = 'O'),
-- Twice the density between 0 and |t|, by Simpson's rule.
s AS (SELECT t, df, (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * abs(t) / 6000 *
        exp(lgamma((df + 1) / 2) - lgamma(df / 2) - ln(df * pi()) / 2 - (df + 1) / 2 * ln(1 + pow(abs(t) * i / 2000, 2) / df)) AS part
      FROM w, range(2001) r(i))
SELECT round(t, 6) AS t, round(df, 3) AS df, round(1 - 2 * sum(part), 6) AS p FROM s GROUP BY ALL""")
def g39(lineitem):
    df = A.welch(lineitem, "l_linestatus", "F", "O", "l_extendedprice")
    return df.select(F.round("t", 6).alias("t"), F.round("df", 3).alias("df"), F.round("p", 6).alias("p"))


@query("g40_regression", "lineitem", sql="""
SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept
FROM lineitem""")
def g40(lineitem):
    df = A.regression(lineitem, "l_quantity", "l_extendedprice")
    return df.select(F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query("g41_chi_square", "lineitem", sql="""
WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY 1, 2),
r AS (SELECT a, sum(o) AS ra FROM c GROUP BY 1), k AS (SELECT b, sum(o) AS rb FROM c GROUP BY 1), t AS (SELECT sum(o) AS n FROM c),
x AS (SELECT sum(pow(coalesce(o, 0) - ra * rb / n, 2) / (ra * rb / n)) AS chi2, (count(DISTINCT r.a) - 1) * (count(DISTINCT k.b) - 1) AS dof
      FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c ON c.a = r.a AND c.b = k.b)
-- One less the lower incomplete gamma function, by its power series.
SELECT round(chi2, 6) AS chi2, dof, round(1 - sum(exp((dof / 2 + i) * ln(chi2 / 2) - chi2 / 2 - lgamma(dof / 2 + i + 1))), 6) AS p
FROM x, range(1000) s(i) GROUP BY ALL""")
def g41(lineitem):
    df = A.chi_square(lineitem, "l_returnflag", "l_linestatus")
    return df.select(F.round("chi2", 6).alias("chi2"), "dof", F.round("p", 6).alias("p"))


@query("g42_cohort", "orders", sql="""
WITH m AS (SELECT DISTINCT o_custkey, date_trunc('month', o_orderdate) AS month FROM orders),
f AS (SELECT o_custkey, min(month) AS cohort FROM m GROUP BY 1),
a AS (SELECT cohort, datediff('month', cohort, month) AS months_since, count(DISTINCT o_custkey) AS active
      FROM m JOIN f USING (o_custkey) GROUP BY 1, 2)
SELECT strftime(a.cohort, '%Y-%m-%d') AS cohort, a.months_since, a.active, round(a.active / z.active, 6) AS retention
FROM a JOIN a z ON a.cohort = z.cohort AND z.months_since = 0""")
def g42(orders):
    df = day(A.cohorts(orders, "o_custkey", "o_orderdate"), "cohort")
    return df.withColumns({"retention": F.round("retention", 6), "months_since": F.col("months_since").cast("long")})


@query("g42_retention_table", "orders", sql="""
WITH m AS (SELECT DISTINCT o_custkey, date_trunc('month', o_orderdate) AS month FROM orders),
f AS (SELECT o_custkey, min(month) AS cohort FROM m GROUP BY 1),
a AS (SELECT cohort, datediff('month', cohort, month) AS k, count(*) AS n FROM m JOIN f USING (o_custkey) GROUP BY 1, 2),
r AS (SELECT strftime(a.cohort, '%Y-%m-%d') AS cohort, a.k, round(a.n / z.n, 6) AS v FROM a JOIN a z ON a.cohort = z.cohort AND z.k = 0)
SELECT cohort, k::VARCHAR AS months_since, v AS retention FROM (SELECT DISTINCT cohort FROM r) CROSS JOIN (SELECT DISTINCT k FROM r) LEFT JOIN r USING (cohort, k)""")
def g42_table(orders):
    """The cells of the table, empty ones included, as rows: its columns depend on the data."""
    df = A.retention_table(A.cohorts(orders, "o_custkey", "o_orderdate"))
    months = [c for c in df.columns if c != "cohort"]
    return day(df, "cohort").unpivot("cohort", months, "months_since", "retention").withColumn("retention", F.round("retention", 6))


@query("g43_quantile_flag", "orders", sql="""
SELECT o_orderkey, o_totalprice > (SELECT quantile_cont(o_totalprice, 0.9) FROM orders) AS is_high FROM orders""")
def g43(orders):
    return A.above_quantile(orders, "o_totalprice", 0.9).select("o_orderkey", "is_high")


@query("g44_target_encode", "orders", sql="""
SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_orderpriority), 4) AS o_orderpriority_encoded,
       round(avg(o_totalprice) OVER (PARTITION BY o_orderstatus), 4) AS o_orderstatus_encoded FROM orders""")
def g44(orders):
    df = G.target_encode(orders, ["o_orderpriority", "o_orderstatus"], "o_totalprice")
    return df.select("o_orderkey", *[F.round(f"{c}_encoded", 4).alias(f"{c}_encoded") for c in ("o_orderpriority", "o_orderstatus")])
