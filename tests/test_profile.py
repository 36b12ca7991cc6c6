"""Profiling and quality checks on tiny frames with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablewise.operators import quality, stats
from tablewise.plans.profile import profile


def _dates(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "d string")
    rows = stats.detect_dates(df, ["d"]).collect()
    return (rows[0]["format"], rows[0]["ambiguous"]) if rows else None


@pytest.mark.parametrize(
    ("values", "want"),
    [
        (["2024-01-31"] * 4, ("%Y-%m-%d", False)),
        (["04/01/10 00:00:00", "07/01/10 00:00:00", "11/01/11 00:00:00"], ("%m/%d/%y %H:%M:%S", True)),
        (["25/01/2024", "13/02/2024", "28/03/2024"], ("%d/%m/%Y", False)),
        (["31.01.2024", "01.02.2024", "15.03.2024"], ("%d.%m.%Y", False)),
        (["hello", "world", "again"], None),
        (["2024-01-31", None, "2024-02-01"], None),
        (["999999-01-01"] * 5, None),
    ],
)
def test_dates_in_text(spark, values, want):
    assert _dates(spark, values) == want


def test_two_digit_years_stay_in_the_past(spark):
    df = spark.createDataFrame([("01/20/75",), ("02/20/99",), ("03/20/04",)], "d string")
    row = stats.temporal_stats(df, {"d": "%m/%d/%y"}).first()
    assert row["earliest"].startswith("1975-01-20") and row["latest"].startswith("2004-03-20")


@pytest.fixture(scope="module")
def messy(spark):
    rows = [
        ("ada", "x", 10.0, "ok"), ("ada", "x", 10.0, "ok"), (" ADA ", "x", 10.0, "ok"),
        ("bob", "x", 11.0, None), ("cy", "x", 12.0, None), ("di", "x", 9.0, None),
        ("ed", "x", 10.0, None), ("fay", "x", 9999.0, None),
    ]
    return spark.createDataFrame(rows, "who string, team string, score double, note string")


def test_messy_table(messy):
    p = profile(messy, name="messy")
    kinds = {(i.kind, i.column) for i in p.issues}
    assert ("duplicate_rows", None) in kinds
    assert ("near_duplicate_rows", None) in kinds
    assert ("constant", "team") in kinds
    assert ("high_null_rate", "note") in kinds
    assert p.column("score").modified_z_outliers == 1
    assert p.column("note").null_count == 5
    assert p.n_rows == 8 and not p.estimated


def test_profile_above_the_bound_is_the_same(messy):
    small, big = profile(messy), profile(messy, bound=2)
    assert small.column("score").numeric == big.column("score").numeric
    assert small.column("score").iqr_outliers == big.column("score").iqr_outliers


def test_semantics(spark):
    day = dt.date(2024, 1, 1)
    rows = [
        (1, "N", 1.5, True, day, "a"), (2, "S", 2.5, False, day, "a"),
        (3, "N", 1.5, True, day, "b"), (4, "S", 9.0, True, day, None),
    ]
    df = spark.createDataFrame(
        rows, "customer_id long, region string, revenue double, active boolean, signed date, empty string"
    ).withColumn("empty", F.lit(None).cast("string"))
    got = {c.name: c.semantic for c in profile(df).columns}
    assert got == {
        "customer_id": "identifier", "region": "categorical", "revenue": "numeric",
        "active": "boolean", "signed": "temporal", "empty": "empty",
    }


def test_keys_exclude_floats(spark):
    df = spark.createDataFrame([(1, 0.1, "a"), (2, 0.2, "a"), (3, 0.3, "b")], "id int, m double, g string")
    assert profile(df).candidate_keys == ["id"]
    assert [r["column"] for r in quality.candidate_keys(df).collect()] == ["id"]


@pytest.mark.parametrize(
    ("values", "iqr", "mad"),
    [([*range(1, 21), 9999], 1, 1), ([10] * 20 + [9999], 0, 1), ([1, 2, 3], 0, 0), ([5] * 9, 0, 0)],
)
@pytest.mark.parametrize("bound", [None, 2])
def test_outliers(spark, values, iqr, mad, bound):
    df = spark.createDataFrame([(v,) for v in values], "x int")
    row = quality.outlier_counts(df, ["x"], bound=bound).first()
    assert (row["iqr_outliers"], row["modified_z_outliers"]) == (iqr, mad)


def test_imbalance_and_duplicates(spark):
    df = spark.createDataFrame([("a",)] * 20 + [("b",)], "c string")
    assert stats.categorical_stats(df, ["c"]).first()["imbalance_ratio"] == 20
    near = spark.createDataFrame([("ada",), ("ada",), ("\tADA ",), ("bob",)], "c string")
    row = quality.duplicates(near).first()
    assert (row["duplicate_rows"], row["near_duplicate_rows"]) == (1, 2)


def test_numeric_text(spark):
    df = spark.createDataFrame(
        [("1", "1,000", "1d", None), (" 2.5e3 ", "2", "2", None)], "a string, b string, c string, d string"
    )
    got = {r["column"]: r["numeric_text"] for r in stats.numeric_text(df).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False}


def test_empty_and_no_columns(spark):
    none = spark.createDataFrame([], "a int")
    assert [i.kind for i in profile(none).issues] == ["no_rows"]
    assert [i.kind for i in profile(none.drop("a")).issues] == ["no_columns"]


def test_sampling_is_flagged(spark):
    df = spark.range(5000).withColumn("v", F.col("id") % 7)
    p = profile(df, sample_key="id", stride=10)
    assert p.estimated and p.n_rows == 5000 and 300 < p.sampled_rows < 700
    assert all(c.estimated for c in p.columns)


def test_single_class_has_no_ratio_and_skew_needs_three(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "x int, c string")
    assert stats.categorical_stats(df, ["c"]).first()["imbalance_ratio"] is None
    row = stats.numeric_stats(df, ["x"]).first()
    assert row["skew"] is None and row["std"] is not None


def test_native_types(spark):
    """Floats keep Spark's own values, zeros of both signs are one value, maps compare by content, long numbers count."""
    df = spark.createDataFrame([(0.1, 0.0), (0.2, -0.0)], "f float, z double").withColumns({
        "m": F.when(F.col("f") < 0.15, F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))).otherwise(
            F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(1))),
        "digits": F.lit("7" * 300),
    })
    p = profile(df)
    assert p.column("z").n_unique == 1 and p.column("m").n_unique == 1
    assert p.column("f").numeric["mean"] == df.agg(F.avg("f")).first()[0]
    assert p.column("digits").numeric_text
    assert quality.duplicates(df.select("m", "z")).first()["duplicate_rows"] == 1
    assert {(r["value"], r["n"]) for r in stats.value_counts(df, ["z"]).collect()} == {("0.0", 2)}


@pytest.mark.parametrize("bound", [None, 50])
def test_bracketed_quantiles_are_exact(spark, bound):
    """Many rows, ties that fill brackets, nulls, and a column with few values, against sorting."""
    df = spark.range(40_000).select(
        F.when(F.col("id") % 7 > 0, F.pow(F.col("id") % 9973, F.lit(2)).cast("double")).alias("a"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("b"),
        (F.col("id") % 2).alias("c"), F.when(F.col("id") < 0, 1).alias("none"),
    )
    places = {"low": 0.01, "q1": 0.25, "middle": 0.5, "high": 0.999}
    got = stats.column_quantiles(df, {c: F.col(c) for c in df.columns}, places, bound=bound).collect()
    for r in got:
        want = df.agg(F.percentile(r["column"], list(places.values()))).first()[0]
        assert [r[p] for p in places] == (want or [None] * 4), r


def test_correlations_of_many_columns_with_gaps(spark):
    df = spark.range(300).select(*[
        F.when(F.col("id") % (i + 2) > 0, (F.col("id") * (i + 1)) % 17 + 1e6 * i).alias(f"x{i}") for i in range(60)
    ])
    pairs = [("x0", "x1"), ("x3", "x59"), ("x10", "x42")]
    got = {(r["a"], r["b"]): r["r"] for r in stats.correlations(df).collect()}
    assert len(got) == 57 * 56 // 2  # x16, x33 and x50 are constant: multiples of 17
    for a, b in pairs:
        both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        assert got[a, b] == pytest.approx(both.agg(F.corr(a, b)).first()[0], abs=1e-9)
    odd = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, float("nan"), 3.0), (3.0, 1.0, 3.0)], "a double, b double, c double")
    got = {(r["a"], r["b"], str(r["r"])) for r in stats.correlations(odd).collect()}
    assert got == {("a", "b", "nan"), ("b", "c", "nan")}  # (a, c) has a constant side and nothing odd
