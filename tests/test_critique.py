"""Every check has a case that fires and one that must stay silent."""

import math

import pytest
from pyspark.sql import functions as F

from tablewise.operators import critique as C
from tablewise.operators.recipes import Answer, correlation, mean_by_category
from tablewise.plans.profile import ColumnProfile, Profile


def column(name, **kw):
    numeric = {"skew": kw.pop("skew", 0.0)}
    return ColumnProfile(name, "double", "numeric", False, 0, kw.pop("null_rate", 0.0), 50, False, numeric=numeric, **kw)


def source(rows=60, estimated=False, **columns):
    cols = [column(n, **kw) for n, kw in columns.items()]
    return Profile("t", rows, len(cols), estimated, rows, cols)


def codes(question, answer, profile):
    return [c.code for c in C.review(question, answer, profile).caveats]


def result(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def about(spark, profile, columns=(), aggregates=(), handles_nulls=False):
    """Caveats of a harmless result that was computed from ``columns``."""
    df = result(spark, [(float(i),) for i in range(40)], "v double")
    found = C.review("q", Answer(df, "x", columns, aggregates, handles_nulls), profile).caveats
    return {c.code: c for c in found}


def test_source_checks(spark):
    assert about(spark, source(estimated=True, g={}))["sampled-source"].severity == "serious"
    assert not about(spark, source(g={}))
    assert "small-source" in about(spark, source(rows=29, g={})) and not about(spark, source(rows=30, g={}))
    assert not about(spark, source(rows=0, g={}))


def test_column_checks(spark):
    p = source(rows=100, a={"iqr_outliers": 1}, b={}, c={"skew": -2.0}, d={"null_rate": 0.05})
    assert "(a)" in about(spark, p, ("a", "b"), ("pearson",))["correlation-outliers"].message
    assert not about(spark, p, ("a",), ("pearson", "spearman"))
    assert not about(spark, p, ("b",), ("pearson",))
    assert set(about(spark, p, ("c",), ("mean",))) == {"mean-on-skewed"}
    assert not about(spark, p, ("c",), ("median",))
    assert not about(spark, p, ("a",), ("mean",))
    assert "d (5%)" in about(spark, p, ("d",), ("sum",))["unacknowledged-nulls"].message
    assert not about(spark, p, ("d",), ("sum",), True)
    assert not about(spark, p, ("a",), ("sum",))


@pytest.mark.parametrize(
    ("rows", "schema", "code", "fires"),
    [
        ([("a", 40), ("b", 3)], "g string, n int", "tiny-groups", True),
        ([("a", 40), ("b", 5)], "g string, n int", "tiny-groups", False),
        ([("a", 4), ("b", 5)], "g string, size int", "tiny-groups", False),
        ([("a", 2.5)], "g string, row_count double", "tiny-groups", True),
        ([(i, i / 20) for i in range(10)], "g int, p_value double", "multiple-comparisons", True),
        ([(i, i / 20) for i in range(9)], "g int, p_value double", "multiple-comparisons", False),
        ([(i, i / 20) for i in range(12)], "g int, price double", "multiple-comparisons", False),
        ([(1, math.inf)], "g int, x double", "non-finite", True),
        ([(1, math.nan)], "g int, x double", "non-finite", True),
        ([(1, None), (2, 1.0)], "g int, x double", "non-finite", False),
        ([(1, None), (2, 1.0)], "g int, std_x double", "singleton-groups", True),
        ([(1, 0.0), (2, 1.0)], "g int, x_sd double", "singleton-groups", True),
        ([(1, 2.0), (2, 1.0)], "g int, std_x double", "singleton-groups", False),
        ([(1, 0.0)], "g int, std_x double", "singleton-groups", False),
        ([(1, None), (2, None)], "g int, x double", "empty-result", True),
        ([(1, None), (2, 3.0)], "g int, x double", "empty-result", False),
        ([], "g int, x double", "empty-result", False),
    ],
)
def test_result_checks(spark, rows, schema, code, fires):
    found = codes("q", Answer(result(spark, rows, schema), "x", (), ()), source(g={}))
    assert (code in found) is fires


@pytest.mark.parametrize(
    ("question", "rows", "code", "fires"),
    [
        ("revenue trend", 2, "short-trend", True),
        ("revenue trend", 3, "short-trend", False),
        ("revenue", 1, "short-trend", False),
        ("violations per year", 1, "ungrouped-result", True),
        ("violations per the market size", 1, "ungrouped-result", True),
        ("violations per year", 2, "ungrouped-result", False),
        ("revenue per customer", 1, "ungrouped-result", False),
    ],
)
def test_question_checks(spark, question, rows, code, fires):
    df = result(spark, [(float(i),) for i in range(rows)], "x double")
    p = source(Year={}, **{"market_size": {}})
    assert (code in codes(question, Answer(df, "x", (), ()), p)) is fires


def test_wrong_question_is_unsound(spark):
    df = result(spark, [(1.0,)], "x double")
    got = C.review("violations per year", Answer(df, "x", (), ()), source(year={}))
    assert got.verdict == "unsound" and got.answered is False and got.confidence == round(0.7 * 0.2, 2)


def judged(spark, severities, answered=None, code="x"):
    rows = [(code, s, False, answered) for s in severities] or [(None, None, None, answered)]
    df = result(spark, rows, "code string, severity string, fatal boolean, answered boolean")
    return C.verdicts(df, []).first()


def test_confidence_is_monotone(spark):
    cases = ([], ["note"], ["warning"], ["serious"], ["serious", "warning"], ["serious", "serious"])
    scores = [judged(spark, c)["confidence"] for c in cases]
    assert scores == sorted(scores, reverse=True) and scores[0] == 1.0
    assert judged(spark, [])["verdict"] == "sound" and judged(spark, ["warning"], True)["verdict"] == "qualified"
    assert judged(spark, [], False)["verdict"] == "unsound"


def test_batch_verdicts(spark):
    rows = [("a", None, None, None), ("b", "x", "warning", False), ("b", "y", "serious", False),
            ("c", "empty-result", "serious", True)]
    df = result(spark, rows, "f string, code string, severity string, fatal boolean").withColumn(
        "answered", F.lit(None).cast("boolean"))
    got = {r["f"]: (r["verdict"], r["confidence"]) for r in C.verdicts(df, ["f"]).collect()}
    assert got == {"a": ("sound", 1.0), "b": ("qualified", 0.59), "c": ("unsound", 0.14)}


def test_recipes_declare_what_they_use(spark):
    df = result(spark, [(i % 3, float(i), float(i * i)) for i in range(40)], "g int, x double, y double")
    assert mean_by_category(df, "g", "x").aggregates == ("mean", "count")
    assert "spearman" in correlation(df, "x", "y").aggregates
