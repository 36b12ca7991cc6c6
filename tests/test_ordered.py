"""Plain windows and sliced windows must agree; both must agree with a brute-force loop."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewise.operators import ordered
from tablewise.operators.table_ops import rolling_time


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for i in range(600):
        key = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None, "zz"])
        value = None if rng.random() < 0.4 else rng.randint(0, 20)
        out.append((i, key, rng.randint(0, 200), value))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, t int, v int")


def _by_id(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[0])


@pytest.mark.parametrize("by", [[], ["k"]])
def test_running_matches_a_loop(frame, rows, by):
    got = ordered.running(
        frame, by, ["t", "id"],
        sums={"total": F.col("v")}, last={"prev": F.col("v")}, following={"nxt": F.col("v")},
        bound=10, slices=7,
    )
    got = {r["id"]: (r["total"], r["prev"], r["nxt"]) for r in got.collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[1] if by else 0, []).append(r)
    for members in groups.values():
        members.sort(key=lambda r: (r[2], r[0]))
        for i, r in enumerate(members):
            before = [m[3] for m in members[: i + 1] if m[3] is not None]
            after = [m[3] for m in members[i:] if m[3] is not None]
            want = (sum(before), before[-1] if before else None, after[0] if after else None)
            assert got[r[0]] == want
    assert len(got) == len(rows)


@pytest.mark.parametrize("by", [[], ["k"]])
def test_running_paths_agree(frame, by):
    args = dict(sums={"total": F.col("v")}, last={"prev": F.col("v")}, following={"nxt": F.col("v")})
    plain = ordered.running(frame, by, ["t", "id"], **args)
    sliced = ordered.running(frame, by, ["t", "id"], **args, bound=10, slices=7)
    assert _by_id(plain) == _by_id(sliced)


@pytest.mark.parametrize("by", [[], ["k"]])
@pytest.mark.parametrize("slices", [3, 40])
def test_look_back_paths_agree(frame, by, slices):
    def columns(w):
        return {
            "lagged": F.lag("v", 2).over(w),
            "total": F.sum("v").over(w.rowsBetween(-4, 0)),
            "seen": F.count("*").over(w.rowsBetween(-4, 0)),
        }

    plain = ordered.look_back(frame, by, ["t", "id"], columns, 4)
    sliced = ordered.look_back(frame, by, ["t", "id"], columns, 4, bound=10, slices=slices)
    cols = ["id", "lagged", "total", "seen"]
    assert _by_id(plain.select(cols)) == _by_id(sliced.select(cols))


@pytest.mark.parametrize("by", [[], ["k"]])
def test_quantile_paths_agree_with_pandas(frame, rows, by):
    want = {"q1": 0.25, "med": 0.5, "q9": 0.9}
    sliced = ordered.group_quantiles(frame, by, "v", want, bound=10, slices=5).toPandas()
    plain = ordered.group_quantiles(frame, by, "v", want).toPandas()
    pdf = pd.DataFrame(rows, columns=["id", "k", "t", "v"])
    for name, p in want.items():
        if by:
            expected = pdf.groupby("k", dropna=False)["v"].quantile(p)
            for got in (sliced, plain):
                series = got.set_index("k")[name]
                for k in ["a", "b", "hot", "zz"]:
                    assert series[k] == pytest.approx(expected[k])
        else:
            assert sliced[name][0] == pytest.approx(pdf["v"].quantile(p))
            assert plain[name][0] == pytest.approx(pdf["v"].quantile(p))


def test_average_ranks_match_pandas(frame, rows):
    pdf = pd.DataFrame(rows, columns=["id", "k", "t", "v"]).dropna(subset=["v"])
    got = ordered.tie_ranks(frame, [], "v", bound=3, slices=4).toPandas().set_index("v")
    for v, want in pdf.assign(r=pdf["v"].rank()).groupby("v")["r"].first().items():
        assert got.loc[int(v), "rank_avg"] == want


def test_group_totals_keeps_null_keys(frame, rows):
    got = ordered.group_totals(frame, ["k"], n=F.count("*")).where("k is null").first()
    assert got["n"] == sum(r[1] is None for r in rows)


@pytest.mark.parametrize("bound", [None, 3])
def test_rolling_windows_keep_to_themselves(spark, bound):
    """Not-a-number and huge values show in the windows that hold them, and in no other."""
    values = [1e17, 1.0, math.nan, 2.0, None, 4.0]
    at = [0, 10, 20, 30, 35, 36]
    df = spark.createDataFrame([("k", t, v) for t, v in zip(at, values)] + [("k", None, 9.0)], "k string, t long, v double")
    df = df.withColumn("ts", F.timestamp_seconds("t"))
    got = {r["t"]: (r["rolling_sum"], r["rolling_n"]) for r in rolling_time(df, "ts", "k", 10, "v", ["k"], bound=bound).collect()}
    assert math.isnan(got.pop(20)[0])
    assert got == {0: (1e17, 1), 10: (1.0, 1), 30: (2.0, 1), 35: (2.0, 1), 36: (6.0, 2), None: (None, None)}
