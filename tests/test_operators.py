"""Table operators on small frames: nulls, ties, empty buckets, and the split paths."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.numeric import band_label, clip, float_div, lenient_double
from tablewise.operators import analysis as A
from tablewise.operators import chartdata as V
from tablewise.operators import checks as X
from tablewise.operators import recipes as R
from tablewise.operators import table_ops as G
from tablewise.operators import workflows as W
from tablewise.operators.ordered import carried_ranks

DAY = dt.datetime(2024, 1, 1)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# ---- functions -----------------------------------------------------------------------------------


def test_division_keeps_infinities(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 4.0), (None, 0.0)], "a double, b double")
    got = [r["q"] for r in df.select(float_div(F.col("a"), F.col("b")).alias("q")).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] == 0.25 and got[4] is None


def test_lenient_numbers(spark):
    cases = [("1", 1.0), (" 2.5 ", 2.5), ("1d", None), ("0x1p3", None), ("1,000", None), ("", None), ("-3e2", -300.0), (None, None)]
    df = spark.createDataFrame([(c[0],) for c in cases], "t string")
    assert [r["x"] for r in df.select(lenient_double(F.col("t")).alias("x")).collect()] == [c[1] for c in cases]


@pytest.mark.parametrize(("right", "want"), [(True, ["<25", "<25", "25-39", None]), (False, ["<25", "25-39", "25-39", None])])
def test_bands(spark, right, want):
    df = spark.createDataFrame([(24,), (25,), (40 if right else 39,), (None,)], "x int")
    labels = ["<25", "25-39", "40-59", "60+"]
    assert [r["b"] for r in df.select(band_label(F.col("x"), [25, 40, 60], labels, right).alias("b")).collect()] == want


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(1,), (50,), (None,)], "x int")
    assert [r["c"] for r in df.select(clip(F.col("x"), 10, 40).alias("c")).collect()] == [10, 40, None]


# ---- joins ---------------------------------------------------------------------------------------


def test_null_keys_never_match(spark):
    a = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, x string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (4, "r")], "k int, y string")
    assert rows(G.join_full(a, b, ["k"]), "k", "x", "y") == sorted(
        [(1, "a", "p"), (None, "b", None), (None, None, "q"), (3, "c", None), (4, None, "r")], key=repr)


def test_cross_join_of_any_size(spark):
    big, small = spark.range(50).toDF("a"), spark.range(3).toDF("b")
    assert G.cross_join(big, small).count() == 150
    assert G.cross_join(small, big).columns == ["b", "a"]
    assert G.cross_join(big, big.toDF("c")).count() == 2500


@pytest.mark.parametrize("bound", [None, 3])
@pytest.mark.parametrize("by", [[], ["k"]])
def test_asof_matches_pandas(spark, by, bound):
    import random

    rng = random.Random(1)
    left = [(i, rng.choice("ab"), rng.randint(0, 60)) for i in range(80)]
    right = [(k, t, n) for n, (k, t) in enumerate({(rng.choice("ab"), t) for t in range(5, 60, 3)})]
    if not by:
        right = list({t: (k, t, n) for k, t, n in right}.values())
    a = spark.createDataFrame(left, "id int, k string, t int")
    b = spark.createDataFrame(right, "k string, rt int, v int")
    got = G.asof_join(a, b if by else b.drop("k"), "t", "rt", by, bound=bound, slices=6)
    got = {r["id"]: r["v"] for r in got.collect()}
    pa_, pb = (pd.DataFrame(left, columns=["id", "k", "t"]).sort_values("t"),
               pd.DataFrame(right, columns=["k", "rt", "v"]).sort_values("rt"))
    want = pd.merge_asof(pa_, pb if by else pb.drop(columns="k"), left_on="t", right_on="rt", by=by or None)
    for i, v in zip(want["id"], want["v"]):
        assert got[i] == (None if math.isnan(v) else v)


def test_concat_aligns_columns_and_types(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([(2.5, 9)], "n double, m long")
    df = G.concat(a, b)
    assert df.columns == ["n", "s", "m"] and df.schema["n"].dataType == T.DoubleType()
    assert rows(df, "n", "s", "m") == [(1.0, "x", None), (2.5, None, 9)]
    with pytest.raises(ValueError):
        G.hconcat(a, b, None)


# ---- order, lists, time --------------------------------------------------------------------------


def test_lists_of_big_groups_come_in_parts(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 1)], "g string, x int")
    whole = G.list_per_group(df, ["g"], "x", ["x"])
    assert rows(whole, "g", "part", "values") == [("a", 0, list(range(10))), ("b", 0, [1])]
    parts = G.list_per_group(df, ["g"], "x", ["x"], size=4)
    assert rows(parts, "g", "part", "values") == [
        ("a", 0, [0, 1, 2, 3]), ("a", 1, [4, 5, 6, 7]), ("a", 2, [8, 9]), ("b", 0, [1])]


def test_unique_first_and_samples(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 2, None), (None, 5, "n")], "k int, t int, s string")
    assert rows(G.unique_first(df, ["k"], ["t"]), "k", "t", "s") == sorted([(1, 1, "a"), (2, 2, None), (None, 5, "n")], key=repr)
    many = spark.range(2000)
    a, b = G.sample_rows(many, "id", 100, 1), G.sample_rows(many.repartition(7), "id", 100, 1)
    assert a.count() == 100 and rows(a, "id") == rows(b, "id") != rows(G.sample_rows(many, "id", 100, 2), "id")
    assert 120 < G.sample_share(many, "id", 0.1).count() < 280


@pytest.mark.parametrize("bound", [None, 2])
def test_fill_and_interpolate(spark, bound):
    data = [(1, None), (2, 1.0), (3, None), (4, None), (5, 4.0), (6, None)]
    df = spark.createDataFrame(data, "t int, v double")
    fwd = [r["v"] for r in G.fill_forward(df, "v", ["t"], bound=bound, slices=4).orderBy("t").collect()]
    assert fwd == [None, 1.0, 1.0, 1.0, 4.0, 4.0]
    line = [r["v"] for r in G.interpolate(df, "v", ["t"], bound=bound, slices=4).orderBy("t").collect()]
    assert line == [None, 1.0, 2.0, 3.0, 4.0, None]
    mean = [r["v"] for r in G.fill_mean(df, "v").orderBy("t").collect()]
    assert mean == [2.5, 1.0, 2.5, 2.5, 4.0, 2.5]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(math.nan,), (1.0,)], "x double")
    assert [r["x"] for r in G.nan_to_null(df).collect()] == [None, 1.0]


@pytest.mark.parametrize("bound", [None, 2])
def test_rolling_time_is_left_open(spark, bound):
    times = [0, 0, 5, 10, 14, 24]
    df = spark.createDataFrame([(i, DAY + dt.timedelta(seconds=s), 1) for i, s in enumerate(times)], "id int, t timestamp_ntz, v int")
    got = G.rolling_time(df, "t", "id", 10, "v", bound=bound, slices=3)
    want = [sum(a - 10 < b <= a for b in times) for a in times]
    assert [r["rolling_n"] for r in got.orderBy("id").collect()] == want


@pytest.mark.parametrize(
    ("every", "want"),
    [("15m", "2024-05-15 13:30:00"), ("1h", "2024-05-15 13:00:00"), ("1d", "2024-05-15 00:00:00"),
     ("1w", "2024-05-13 00:00:00"), ("1mo", "2024-05-01 00:00:00"), ("1q", "2024-04-01 00:00:00"),
     ("3mo", "2024-04-01 00:00:00"), ("1y", "2024-01-01 00:00:00")],
)
def test_time_buckets(spark, every, want):
    df = spark.sql("select timestamp_ntz'2024-05-15 13:44:59' as t")
    assert str(df.select(G.time_bucket(F.col("t"), every).alias("b")).first()["b"]) == want


def test_resample_fills_empty_days(spark):
    df = spark.createDataFrame([(DAY,), (DAY + dt.timedelta(days=3),)], "t timestamp_ntz")
    got = G.resampled(df, "t", "INTERVAL 1 DAY", n=F.count("*"))
    assert [r["n"] for r in got.orderBy("bucket").collect()] == [1, None, None, 1]


def test_average_rank_and_share(spark):
    df = spark.createDataFrame([("a", 5), ("a", 5), ("a", 1), ("b", 2), ("b", None)], "g string, x int")
    got = {(r["g"], r["x"]): (r["rank_min"], r["rank_avg"], r["rank_dense"]) for r in A.ranked(df, ["g"], "x").collect()}
    assert got[("a", 5)] == (1, 1.5, 1) and got[("a", 1)] == (3, 3.0, 2) and got[("b", None)] == (None, None, None)


# ---- recipes and workflows -----------------------------------------------------------------------


def test_ratio_is_of_sums_and_skips_zero_denominators(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 9.0, 2.0), ("z", 1.0, 0.0)], "g string, n double, d double")
    assert rows(R.ratio_by_category(df, "g", "n", "d").df, "g", "ratio", "n") == [("a", 2.5, 2)]


def test_period_change_starts_with_null_and_reports_a_zero_base(spark):
    df = spark.createDataFrame([(DAY, 0.0), (DAY.replace(month=2), 5.0), (DAY.replace(month=4), 10.0)], "t timestamp_ntz, v double")
    got = [r["pct_change"] for r in R.period_change(df, "t", "v").df.collect()]
    assert got == [None, math.inf, 100.0]


def test_constant_sides_have_no_correlation(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(5)], "x double, y double")
    row = R.correlation(df, "x", "y").df.first()
    assert row["pearson"] is None and row["spearman"] is None


@pytest.mark.parametrize("slices", [None, 1, 3])
def test_spearman_matches_pandas(spark, slices):
    pdf = pd.DataFrame({"x": [1, 2, 2, 3, 5, 8, 8, 8], "y": [4, 1, 1, 7, 7, 9, 2, 9]}).astype(float)
    got = R.spearman(spark.createDataFrame(pdf), "x", "y", slices=slices).first()["spearman"]
    assert got == pytest.approx(pdf["x"].rank().corr(pdf["y"].rank()))


@pytest.mark.parametrize("hot", [0.0, 0.4, 1.0])
def test_carried_ranks_of_values_cut_by_slices(spark, hot):
    """A value that fills many slices has one rank, whatever stands before and after it."""
    rng = np.random.default_rng(int(hot * 10))
    x = np.where(rng.random(400) < hot, 5.0, rng.integers(0, 60, 400).astype(float))
    pdf = pd.DataFrame({"x": x, "row": np.arange(400), "w": rng.integers(1, 4, 400)})
    got = carried_ranks(spark.createDataFrame(pdf), "x", "row", "w", "rank", slices=7).toPandas().sort_values("row")
    want = pdf.loc[pdf.index.repeat(pdf["w"])].assign(rank=lambda d: d["x"].rank()).groupby("row")["rank"].first()
    assert got["rank"].tolist() == want.tolist()


def test_spearman_of_nothing(spark):
    assert R.spearman(spark.createDataFrame([], "x double, y double"), "x", "y").first()["spearman"] is None


def test_mode_breaks_ties_downwards(spark):
    df = spark.createDataFrame([("a", "z"), ("a", "b"), ("b", None), ("b", None), ("b", "q")], "g string, v string")
    assert rows(R.mode_per_category(df, "g", "v").df, "g", "v", "n") == [("a", "b", 1), ("b", None, 2)]


def test_crosstab_fill(spark):
    df = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "r string, c string, v int")
    assert rows(R.crosstab(df, "r", "c", "v", ["x", "y"]).df, "r", "x", "y") == [("a", 1, None), ("b", None, 2)]
    assert rows(R.crosstab(df, "r", "c", "v", ["x", "y"], fill=0).df, "r", "x", "y") == [("a", 1, 0), ("b", 0, 2)]


def test_driver_effect_dispatches_on_type(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 2, 4.0)], "g string, x int, y double")
    assert R.driver_effect(df, "g", "y").aggregates == ("mean", "count")
    assert R.driver_effect(df, "x", "y").df.first()["pearson"] == 1.0


def test_simpson_reversal(spark):
    cells = [("s1", "A", 81, 87), ("s1", "B", 234, 270), ("s2", "A", 192, 263), ("s2", "B", 55, 80)]
    data = [(s, g, int(i < yes)) for s, g, yes, n in cells for i in range(n)]
    got = X.simpson(spark.createDataFrame(data, "s string, g string, y int"), "s", "g", "A", "B", "y").collect()
    assert all(r["gap"] > 0 and r["overall_gap"] < 0 and r["reversed"] for r in got)


def test_quality_sweep(spark):
    df = spark.createDataFrame([(1, DAY, 5.0), (1, None, -1.0), (2, DAY.replace(year=2030), 2.0)], "k int, t timestamp_ntz, v double")
    got = dict(tuple(r) for r in W.quality_sweep(df, "k", "t", "v", F.lit(DAY)).collect())
    assert got == {"missing_dates": 1, "negative_measures": 1, "future_dates": 1, "duplicated_keys": 1}


def test_chi_square_counts_empty_cells(spark):
    df = spark.createDataFrame([("a", "x")] * 10 + [("b", "y")] * 10, "a string, b string")
    assert tuple(A.chi_square(df, "a", "b").select("chi2", "dof").first()) == (20.0, 1)


# ---- chart data ----------------------------------------------------------------------------------


def test_long_tail_folds(spark):
    df = spark.createDataFrame([(f"c{i:02d}", float(i)) for i in range(60)], "c string, v double")
    got = V.prepare(df, V.ChartSpec("bar", "c", "v")).collect()
    assert len(got) == 20 and got[0]["c"] == "c59" and got[-1]["c"] == "other" and got[-1]["v"] == sum(range(41))
    numbers = spark.createDataFrame([(i, i) for i in range(30)], "c int, v int")
    assert V.prepare(numbers, V.ChartSpec("bar", "c", "v")).dtypes[0] == ("c", "string")


@pytest.mark.parametrize(("form", "kinds", "want"), [("line", 12, 8), ("line", 8, 8), ("scatter", 5, 3), ("scatter", 3, 3)])
def test_series_fold(spark, form, kinds, want):
    df = spark.createDataFrame([(i, float(i), f"s{i % kinds}") for i in range(60)], "x int, y double, s string")
    got = V.prepare(df, V.ChartSpec(form, "x", "y", "s"))
    assert got.count() == 60 and got.select("s").distinct().count() == want


def test_chart_choice(spark):
    time = spark.createDataFrame([(DAY, 1.0)], "t timestamp_ntz, v double")
    assert V.default_spec(time).form == "line"
    few = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "c string, v double")
    assert V.default_spec(few).form == "column"
    assert V.default_spec(few.unionByName(spark.createDataFrame([("a long label", 1.0)], "c string, v double"))).form == "bar"
    pair = spark.createDataFrame([(1, 1.0), (1, 2.0)], "x int, v double")
    assert V.default_spec(pair).form == "scatter" and V.default_spec(pair.dropDuplicates(["x"])).form == "line"
    falling = spark.createDataFrame([(1, 3, 1.0), (2, 2, 2.0)], "o int, x int, v double").select("x", "o", "v")
    assert V.default_spec(falling, order="o").form == "scatter"
    assert V.default_spec(few.drop("v")) is None and V.default_spec(few.select("v")) is None
    assert V.undrawable(few.limit(0)) and V.undrawable(few.drop("v")) and V.undrawable(few) is None


def test_chart_proposals(spark):
    df = spark.createDataFrame([("a", 1.0, "s")], "c string, v double, s string")
    ok = V.validate_spec({"form": " BAR ", "x": "c", "y": "v", "series": "nope"}, df)
    assert ok == V.ChartSpec("bar", "c", "v")
    for bad in ({"form": "pie", "x": "c", "y": "v"}, {"form": "bar", "x": "c", "y": "c"},
                {"form": "bar", "x": "v", "y": "c"}, {"form": "bar", "x": "c", "y": "w"}):
        assert V.validate_spec(bad, df) is None
    with pytest.raises(ValueError):
        V.prepare(df, V.ChartSpec("bar", "c", "w"))
    assert V.drawn_form(V.ChartSpec("area", "c", "v", "s"), 2).form == "line"
    assert V.drawn_form(V.ChartSpec("area", "c", "v"), 1).form == "area"


@pytest.mark.parametrize(("start", "n"), [(0, 5), (13, 40), (390, 50), (399, 1), (400, 3), (7, 0)])
def test_deep_slices(spark, start, n):
    """Ties and nulls at the borders, against sorting the whole."""
    data = [(i, None if i % 9 == 0 else i * 7 % 23, f"r{i}") for i in range(400)]
    df = spark.createDataFrame(data, "id int, v int, s string").repartition(6)
    order = sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert [tuple(r) for r in G.slice_rows(df, ["v", "id"], start, n).collect()] == order[start : start + n]
    tied = [r["v"] for r in G.slice_rows(df, ["v"], start, n).collect()]
    assert tied == [r[1] for r in order[start : start + n]]


def test_asof_with_one_time_only(spark):
    left = spark.range(300).select("id", F.lit(5).alias("t"))
    right = spark.createDataFrame([(5, "at"), (3, "before"), (6, "after")], "u int, w string")
    for slices in (None, 7):
        got = G.asof_join(left, right, "t", "u", slices=slices, bound=10)
        assert got.count() == 300 and {r["w"] for r in got.collect()} == {"at"}
