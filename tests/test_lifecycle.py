"""Card, findings and streaming."""

import pytest
from pyspark.sql import functions as F

from tablewise.operators import retrieval
from tablewise.plans import card as K
from tablewise.plans import findings as L
from tablewise.plans.profile import profile
from tablewise.sources import sinks
from tablewise.sources.loaders import UnsupportedFormat
from tablewise.streaming import events as E


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i, f"Person {i}", f"p{i}@mail.org", ["N", "S", "E"][i % 3], float(i), float(2 * i)) for i in range(60)]
    return spark.createDataFrame(rows, "id long, full_name string, contact string, region string, x double, y double")


def test_card_hides_personal_values(spark, people):
    card = K.build_card(profile(people, name="people"), people, key="id")
    body = card.to_json()
    assert "Person" not in body and "mail.org" not in body
    assert card.redacted_columns == ["full_name"] and "<email>" in card.masked
    assert card.correlations[0] == {"a": "x", "b": "y", "r": 1.0}
    assert len(card.examples) == 3 and {e["region"] for e in card.examples} == {"N", "S", "E"}


def test_card_hash_ignores_the_layout(spark, people):
    cards = [K.build_card(profile(df, name="p"), df, key="id") for df in (people.coalesce(1), people.repartition(8))]
    assert cards[0].hash == cards[1].hash and len(cards[0].hash) == 16


def test_wide_card_fits_and_keeps_columns(spark):
    df = spark.range(500).select("id", *[(F.col("id") % (i + 2)).cast("double").alias(f"measure_{i}") for i in range(60)])
    card = K.build_card(profile(df, name="wide"), df, key="id")
    assert card.size_bytes <= K.MAX_CARD_BYTES
    assert len(card.columns) == 61 and "columns" not in card.left_out
    small = K.fitted(card, 400)
    assert small.left_out["columns"] == 61 - len(small.columns) > 0 and small.size_bytes <= 400


@pytest.mark.parametrize("bound", [None, 5])
def test_spaced_examples_span_the_table(spark, bound):
    got = K.evenly_spaced(spark.range(103), "id", 103, 5, bound=bound).orderBy("id").collect()
    assert [r["id"] for r in got] == [0, 20, 40, 60, 80]


def test_masked_preview(spark, people):
    got = K.masked_preview(people.select("id", "full_name", "contact", (F.col("x") * 1000.12345).alias("v")), ["id"])
    rows = got.collect()
    assert len(rows) == 25 and rows[0]["rows_not_shown"] == 35
    assert rows[2].asDict() == {"id": "2", "full_name": "<redacted>", "contact": "<email>", "v": "2,000.247", "rows_not_shown": 35}


def test_preview_keeps_the_order_of_the_answer(spark):
    df = spark.createDataFrame([(f"c{i:03}", i) for i in range(60)], "c string, v long")
    source = L.look(df, "sixty")
    row = L.answer_all(source, [L.Question("total v by c", {"category": "c", "measure": "v"}, "total_by_category")]).first()
    assert row["preview"][:2] == ["c059 | 59", "c058 | 58"] and row["dropped"] == 35 and len(row["preview"]) == 25


def test_proposals(spark):
    rows = [(1, "a?", ["x", "y"]), (2, "b?", ["x", "nope"]), (3, "c?", []), (4, " ", ["x"]), (5, "d?", ["y"]), (6, "e?", ["x"])]
    df = spark.createDataFrame(rows, "at int, question string, columns array<string>")
    got = [(r["question"], r["rank"]) for r in K.validate_proposals(df, ["x", "y"], "at", 2).orderBy("rank").collect()]
    assert got == [("a?", 1), ("d?", 2)]
    assert [r["column"] for r in K.unknown_columns(df, ["x", "y"]).collect()] == ["nope"]


def test_findings_record_failures(spark, people):
    source = L.look(people, "people", key="id")
    asked = [
        L.Question("total x by region", {"category": "region", "measure": "x"}),
        L.Question("average z by region", {"category": "region", "measure": "z"}),
        L.Question("what is it", {}),
    ]
    rows = {r["question"]: r for r in L.answer_all(source, asked).collect()}
    good, bad, lost = (rows[q.text] for q in asked)
    assert good["status"] == "answered" and good["recipe"] == "total_by_category" and len(good["preview"]) == 3
    assert bad["status"] == lost["status"] == "unanswered" and "z" in bad["preview"][0]
    assert {r["card_hash"] for r in rows.values()} == {source.card.hash}


def test_every_shape_names_a_recipe(spark):
    assert len(L.RECIPES) == 23 == retrieval.shapes_df(spark).count()


def test_streamed_buckets_equal_batch_for_closed_windows(spark, sf):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    root = sinks.scratch(spark, "stream")
    E.drain(E.buckets(stream, "ts", "1 day", ["event_type"], n=F.count("*")), f"{root}/o", f"{root}/c")
    got = {(str(r["bucket"]), r["event_type"]): r["n"] for r in spark.read.parquet(f"{root}/o").collect()}
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    want = {(str(r["b"]), r["event_type"]): r["count"] for r in batch.groupBy(day.alias("b"), "event_type").count().collect()}
    assert got and all(want[k] == n for k, n in got.items())
    last = max(k[0] for k in want)
    assert {k for k in want if k not in got} == {k for k in want if k[0] == last}


def test_look_at_a_folder(spark, people):
    root = sinks.scratch(spark, "look-at")
    sinks.write_delimited(people, f"{root}/people", sep="|")
    source = L.look_at(spark, f"{root}/people/part-*", "people", key="id")
    assert source.profile.n_rows == 60 and source.card.redacted_columns == ["full_name"] and source.df.columns == people.columns
    sinks.write_ndjson(people, f"{root}/lines")
    with pytest.raises(UnsupportedFormat, match="not one table: .* csv .* jsonl"):
        L.look_at(spark, f"{root}/*/part-*")


def test_reasons_are_the_same_in_every_run(spark, people):
    source = L.look(people, "people")
    asked = L.Question("average z by region", {"category": "region", "measure": "z"}, "mean_by_category")
    first, second = (L.ask(source, asked, asked.recipe).reason for _ in range(2))
    assert first == second and "`z`" in first and "#" not in first
