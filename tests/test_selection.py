"""Selection of quantiles and tallies of values, for many columns at once, against sorting and counting."""

import math
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewise.operators import quality, selection, stats, tallies


def test_keys_are_in_the_order_of_the_doubles():
    x = np.array([-np.inf, -1e300, -2.5, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1e300, np.inf, np.nan])
    k = selection.keys(x)
    assert k[4] == k[5] and (np.diff(np.delete(k, 4)) > 0).all()
    assert [selection.value(v) for v in k[:-1]] == [0.0 if v == 0 else v for v in x[:-1]] and math.isnan(selection.value(k[-1]))


@pytest.mark.parametrize("shape", ["uniform", "ties", "tail", "sorted"])
def test_brackets_hold_the_order_statistics(monkeypatch, shape):
    """However batches are merged, the stated error is never exceeded."""
    monkeypatch.setattr(selection, "POINTS", 64)
    monkeypatch.setattr(selection, "FAN_IN", 4)
    r = np.random.default_rng(3)
    n = 20_000
    x = {"uniform": r.random(n), "ties": r.integers(0, 5, n).astype(float), "tail": np.exp(8 * r.standard_normal(n)), "sorted": np.arange(n, dtype=float)}[shape]
    tasks = []
    for part in np.array_split(x, 7):
        gathered = selection.Gathered()
        for at in range(0, len(part), 300):
            gathered.add(selection.Summary.of(selection.keys(part[at : at + 300])))
        tasks.append(gathered.all())
    whole = selection.Summary.merged(tasks)
    order = np.sort(selection.keys(x))
    assert whole.n == n and len(whole.points) <= 64 and whole.error > 0
    for p in (0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0):
        low, high = whole.bracket(p)
        at = p * (n - 1)
        assert low <= order[math.floor(at)] and order[math.ceil(at)] <= high


def test_quantiles_of_odd_values(spark):
    rows = [(float(v), i % 2 * 1.0 if i % 5 else None, None) for i, v in enumerate([*range(9000), *[7.0] * 4000, float("inf"), float("-inf"), float("nan")])]
    df = spark.createDataFrame(rows, "x double, y double, z double").repartition(6)
    got = {r["column"]: r for r in selection.quantiles(df, {c: F.col(c) for c in df.columns}, {"least": 0.0, "middle": 0.5, "high": 0.77, "most": 1.0}).collect()}
    x = np.sort(np.array([r[0] for r in rows]))
    at = 0.77 * (len(x) - 1)
    assert got["x"]["least"] == -math.inf and math.isnan(got["x"]["most"]) and got["x"]["middle"] == x[len(x) // 2]
    assert got["x"]["high"] == x[math.floor(at)] + (at - math.floor(at)) * (x[math.ceil(at)] - x[math.floor(at)])
    assert got["y"]["least"] == 0 and got["y"]["most"] == 1 and got["z"]["middle"] is None


def test_a_thousand_columns(spark):
    df = spark.range(3000).select(*[((F.col("id") * (i + 1)) % 2003 + (F.col("id") == 5).cast("int") * 10**6).alias(f"c{i}") for i in range(1000)]).repartition(4)
    start = time.time()
    quartiles = {r["column"]: r for r in stats.numeric_stats(df).collect()}
    outliers = {r["column"]: r for r in quality.outlier_counts(df, centre=spark.createDataFrame(list(quartiles.values()))).collect()}
    assert time.time() - start < 120
    assert len(quartiles) == len(outliers) == 1000
    for c in ("c0", "c1", "c999"):
        want = df.agg(F.percentile(c, [0.25, 0.5, 0.75]), F.avg(c)).first()
        assert [quartiles[c][q] for q in ("q1", "median", "q3")] == want[0] and quartiles[c]["mean"] == pytest.approx(want[1])
        assert outliers[c]["iqr_outliers"] == outliers[c]["modified_z_outliers"] == 1


def test_tallies_merge_to_the_same_sketch():
    r = np.random.default_rng(1)
    few = r.choice(r.integers(-(2**63), 2**63 - 1, 900), 30_000)
    many = r.integers(-(2**63), 2**63 - 1, 30_000)
    for values, exact in ((few, True), (np.concatenate([many, many[:9000]]), False)):
        out = []
        for parts in (1, 13):
            total = tallies.Tally()
            for p in np.array_split(values, parts):
                total.add(len(p), 0, False, *np.unique(p, return_counts=True))
            out.append(total)
        a, b = out
        assert (a.hashes == b.hashes).all() and (a.counts == b.counts).all() and a.more == b.more == (not exact) and a.rows == len(values)
        distinct, counts = np.unique(values, return_counts=True)
        assert a.about() == len(distinct) if exact else abs(a.about() / len(distinct) - 1) < 0.08
        assert (a.counts == counts[: len(a.counts)]).all()


def test_only_likely_keys_are_counted_by_value(spark):
    df = spark.range(20_000).select(
        "id", (F.col("id") % 9000).alias("many"), F.when(F.col("id") > 0, F.col("id")).alias("holes"), F.rand(3).alias("real"), (F.col("id") % 7).alias("few"),
        F.concat(F.lit("x" * 300), F.col("id").cast("string")).alias("text"), F.date_add(F.lit("1900-01-01"), F.pmod("id", F.lit(5000)).cast("int")).alias("day"),
    ).repartition(5)
    whole = {r["column"]: r for r in stats.column_shapes(df).collect()}
    assert {c: r["distinct"] for c, r in whole.items()} == {"id": 20_000, "many": 9000, "holes": 19_999, "real": 20_000, "few": 7, "text": 20_000, "day": 5000}
    assert not any(r["estimated"] for r in whole.values()) and whole["many"]["max_n"] == 3 and whole["many"]["min_n"] == 2
    quick = {r["column"]: r for r in stats.column_shapes(df, exact=False).collect()}
    assert {c for c, r in quick.items() if r["estimated"]} == {"many", "holes", "real", "day"}
    assert all(abs(quick[c]["distinct"] / whole[c]["distinct"] - 1) < 0.08 for c in quick)
    assert quick["id"] == whole["id"] and quick["few"] == whole["few"] and quick["text"]["distinct"] == 20_000


def test_no_rows_and_no_values(spark):
    none = spark.createDataFrame([], "a int, b string")
    assert [tuple(r) for r in stats.column_shapes(none).collect()] == [("a", 0, 0, 0, None, None, None, False), ("b", 0, 0, 0, None, None, None, False)]
    assert stats.numeric_stats(none).first()["n"] == 0
    nulls = spark.createDataFrame([(None, None)] * 3, "a int, b string")
    assert [(r["nulls"], r["distinct"]) for r in stats.column_shapes(nulls).collect()] == [(3, 0), (3, 0)]
