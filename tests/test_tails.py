"""Tail probabilities against closed forms and known critical values."""

import math

import pytest
from pyspark.sql import functions as F

from tablewise.functions.tails import beta_share, chi_square_tail, log_gamma, t_two_sided
from tablewise.operators import analysis as A


def chi_even(x, k):
    return math.exp(-x / 2) * math.fsum((x / 2) ** j / math.factorial(j) for j in range(k // 2))


def t_even_or_one(t, dof):
    if dof == 1:
        return 1 - 2 / math.pi * math.atan(t)
    if dof == 2:
        return 1 - t / math.sqrt(2 + t * t)
    return {4: 1 - t / math.sqrt(4 + t * t) * (1 + 2 / (4 + t * t))}[dof]


CHI = [(x, k, chi_even(x, k)) for x in (0.001, 0.5, 3.0, 20.0, 90.0) for k in (2, 4, 10, 40, 100)]
CHI += [(x, 1, math.erfc(math.sqrt(x / 2))) for x in (1e-6, 0.3, 3.841458820694124, 40.0, 700.0)]
CHI += [(18.307038053275146, 10, 0.05), (6.634896601021213, 1, 0.01), (0.0, 3, 1.0), (1e6, 1e6, 0.49981192968), (124.3421134287216, 100, 0.05)]
T = [(t, d, t_even_or_one(t, d)) for t in (0.0, 1e-4, 0.7, 2.0, 30.0, 1e4) for d in (1, 2, 4)]
T += [(2.2281388519649385, 10, 0.05), (-2.2281388519649385, 10, 0.05), (1.959963984540054, 1e9, 0.05), (2.7637694581126957, 10, 0.02)]


def test_known_values(spark):
    rows = [("chi", float(x), float(k), p) for x, k, p in CHI] + [("t", float(t), float(d), p) for t, d, p in T]
    df = spark.createDataFrame(rows, "kind string, x double, dof double, want double")
    got = df.withColumn("got", F.when(F.col("kind") == "chi", chi_square_tail(F.col("x"), F.col("dof"))).otherwise(t_two_sided(F.col("x"), F.col("dof"))))
    for r in got.collect():
        assert r["got"] == pytest.approx(r["want"], rel=1e-9 if r["dof"] < 1e5 else 1e-6, abs=1e-9), r


def test_parts(spark):
    rows = spark.createDataFrame([(0.5,), (1.0,), (3.7,), (50.0,), (1e6,)], "z double").withColumn("g", log_gamma(F.col("z"))).collect()
    assert all(r["g"] == pytest.approx(math.lgamma(r["z"]), rel=1e-13, abs=1e-13) for r in rows)
    one = spark.range(1).select(beta_share(F.lit(0.3), F.lit(2.0), F.lit(3.0)), beta_share(F.lit(0.0), F.lit(2.0), F.lit(3.0)), beta_share(F.lit(1.0), F.lit(2.0), F.lit(3.0))).first()
    assert one[0] == pytest.approx(0.3483, abs=1e-12) and one[1:] == (0.0, 1.0)
    nothing = spark.range(1).select(chi_square_tail(F.lit(0.0), F.lit(0)), t_two_sided(F.lit(None).cast("double"), F.lit(3.0))).first()
    assert nothing == (None, None)


def test_tests_carry_their_p(spark):
    df = spark.createDataFrame([("a", "x", 1.0)] * 10 + [("b", "y", 2.0)] * 10 + [("a", "x", 2.0), ("b", "y", 3.0)], "a string, b string, v double")
    assert A.chi_square(df, "a", "b").first()["p"] == pytest.approx(math.erfc(math.sqrt(22 / 2)), rel=1e-9)
    row = A.welch(df, "a", "a", "b", "v").first()
    assert row["t"] < -7 and 0 < row["p"] < 1e-6
    one_class = df.where("a = 'a'")
    assert A.chi_square(one_class, "a", "b").first()["p"] is None
