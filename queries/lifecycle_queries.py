"""L and E: from question to finding, and streaming."""

from pyspark.sql import functions as F

from queries.base import ORACLES, QUERIES, query, table
from queries.recipe_queries import as_double
from tablewise.plans import findings as L
from tablewise.sources import sinks
from tablewise.streaming import events as E


@query("l1_look_at", "part", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS name, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS n_unique, count(*) AS rows FROM part"
    for c in "p_partkey p_name p_brand p_type p_size p_retailprice".split()))
def l1(part):
    """A folder of delimited files, known by nothing but its path."""
    spark = part.sparkSession
    path = sinks.scratch(spark, "look")
    sinks.write_delimited(part, path, sep=";")
    source = L.look_at(spark, f"{path}/part-*")
    return source.profile.to_df(spark).select("name", "null_count", "n_unique", F.lit(source.profile.n_rows).cast("long").alias("rows"))


#: A number as previews show it.
def _shown(x):
    return f"regexp_replace(format('{{:,.3f}}', {x}), '\\.?0+$', '')"


@query("l2_ask", "orders", sql=f"""
WITH m AS (SELECT o_orderpriority, avg(o_totalprice) AS mean, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderpriority, {_shown("mean")} AS mean_measure, format('{{:,}}', n) AS n, 0::BIGINT AS rows_not_shown, 'mean_by_category' AS recipe,
       'sound' AS verdict, 1.0::DOUBLE AS confidence FROM m""")
def l2(orders):
    source = L.look(orders, "orders")
    asked = L.Question("what is the average price for each priority", {"category": "o_orderpriority", "measure": "o_totalprice"})
    found = L.ask(source, asked, L.route_all(source, [asked])[0])
    return L.masked_preview(found.answer.df, total=found.critique.rows).select(
        "*", F.lit(found.recipe).alias("recipe"), F.lit(found.critique.verdict).alias("verdict"),
        F.lit(found.critique.confidence).alias("confidence"),
    )


QUESTIONS = [
    L.Question("total revenue by priority", {"category": "o_orderpriority", "measure": "o_totalprice"}),
    L.Question("monthly revenue trend", {"when": "o_orderdate", "measure": "o_totalprice"}),
    L.Question("top 10 orders by price", {"measure": "o_totalprice", "key": "o_orderkey"}),
    L.Question("how are prices spread out", {"measure": "o_totalprice"}, "distribution"),
    L.Question("unique customers by status", {"category": "o_orderstatus", "item": "o_custkey"}),
    L.Question("average shoe size by region", {"category": "region", "measure": "shoe_size"}),
]


@query("l3_findings", "orders", sql="""
WITH r(place, question, recipe, rows) AS (
  SELECT 1, 'total revenue by priority', 'total_by_category', count(DISTINCT o_orderpriority) FROM orders UNION ALL
  SELECT 2, 'monthly revenue trend', 'over_time', count(DISTINCT date_trunc('month', o_orderdate)) FROM orders UNION ALL
  SELECT 3, 'top 10 orders by price', 'top_rows', 10 UNION ALL
  SELECT 4, 'how are prices spread out', 'distribution', 1 UNION ALL
  SELECT 5, 'unique customers by status', 'distinct_per_category', count(DISTINCT o_orderstatus) FROM orders UNION ALL
  SELECT 6, 'average shoe size by region', 'mean_by_category', NULL)
SELECT run, place::INTEGER AS place, question, recipe, CASE WHEN rows IS NULL THEN 'unanswered' ELSE 'answered' END AS status, rows::BIGINT AS rows
FROM r CROSS JOIN (VALUES ('first'), ('second')) runs(run)""")
def l3(orders):
    """Two runs, the first of which is written once more: what the table holds already is not added again."""
    spark = orders.sparkSession
    table_path = sinks.scratch(spark, "findings")
    source = L.look(orders, "orders")
    first = L.answer_all(source, QUESTIONS, "first")
    second = first.withColumn("run", F.lit("second"))
    for run in (first, first, second, first):
        sinks.append_findings(run, table_path)
    shown = F.when(F.col("status") == "answered", F.size("preview") + F.col("dropped"))
    return spark.read.parquet(table_path).select("run", "place", "question", "recipe", "status", shown.alias("rows"))


def event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def run_all(spark, name, stream, *keys):
    path = sinks.scratch(spark, name)
    return E.drain_all(stream, f"{path}/out", f"{path}/checkpoint", keys)


def run(spark, name, stream):
    path = sinks.scratch(spark, name)
    E.drain(stream, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def e1(spark, sf_dir):
    stream = event_stream(spark, sf_dir).withColumn("value", F.col("value").cast("decimal(18,2)"))
    out = run_all(spark, "buckets", E.buckets(
        stream, "ts", "1 day", ["event_type"], "1 hour", n=F.count("*"), total=F.sum("value")), "bucket", "event_type")
    return as_double(out, "total").withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


def e2(spark, sf_dir):
    today = F.lit("2024-01-20").cast("timestamp")
    stream = event_stream(spark, sf_dir).withColumn("change", F.col("value") - 5)
    out = run_all(spark, "sweep", E.quality_sweep(stream, "ts", "change", today, "1 day"), "bucket")
    return out.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


def e3(spark, sf_dir):
    schema = table(spark, sf_dir, "customer").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "customer.parquet").parquet(sf_dir)
    return run(spark, "masked", E.mask(stream))


QUERIES |= {"e1_stream_buckets": e1, "e2_stream_sweep": e2, "e3_stream_mask": e3}
ORACLES |= {
    "e1_stream_buckets": """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS bucket, event_type, count(*) AS n,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2""",
    "e2_stream_sweep": """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS bucket, count(*) AS rows, 0::BIGINT AS missing_dates,
       CAST(count_if(value - 5 < 0) AS BIGINT) AS negative_measures, CAST(count_if(ts > TIMESTAMP '2024-01-20') AS BIGINT) AS future_dates
FROM events GROUP BY 1""",
    "e3_stream_mask": """
SELECT c_custkey, '<redacted>' AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""",
}
