"""Hard negatives against brute force in whole numbers, and the cases the docstring defines."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewise.llm import negatives
from tests.compare import canonical, connect
from tablewise.llm.negatives_queries import SQL, op12

SCHEMA = "vec_id bigint, embedding array<double>, label int, size string, class string, g string, low string, tile string, anchor string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, e, label, *["clash"] * 6) for i, e, label in vectors], SCHEMA)


def brute(vectors, every=10, positives=5, negatives=10):
    rows = {}
    for i, e, label in vectors:
        if i is None or e is None or label is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        x = [math.floor(256 * v) for v in e]
        if sum(v * v for v in x) < 2**60:
            rows[i] = min(rows.get(i, (label, e, x)), (label, e, x))
    out = []
    for a, (label, _, q) in rows.items():
        if a % every:
            continue
        scored = sorted((-sum(map(lambda u, v: u * v, q, x)), i, lb) for i, (lb, _, x) in rows.items() if i != a and len(x) == len(q))
        for ps, pid, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [(s, i) for s, i, lb in scored if lb != label and 30 * -ps <= 100 * -s <= 90 * -ps][:negatives]
            out += [(a, pid, r + 1, i, -ps, -s) for r, (s, i) in enumerate(fits)]
    return sorted(out)


def planted(n=700, width=12, seed=3, scale=1.0):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((6, width))
    out = []
    for i in range(n):
        x = centres[r.integers(6)] + 0.4 * r.standard_normal(width)
        x = x / np.linalg.norm(x) * scale * r.choice([0.2, 1.0, 1.0, 3.0])
        out.append((i, x.tolist(), int(r.choice([0, 0, 0, 1, 2]))))
    return out


ODD = [
    (None, [1.0, 2.0], 1), (9000, None, 1), (9010, [1.0, None], 1), (9020, [float("nan"), 1.0], 1), (9030, [float("inf"), 1.0], 1), (9040, [1.0, 2.0], None),
    (9050, [1.0, 2.0], 1), (9051, [1.0, 2.0], 1), (9052, [0.9, 1.4], 2), (9053, [0.9, 1.4], 2), (9053, [0.1, 0.1], 1), (9060, [0.0, 0.0], 1), (9070, [], 1), (9071, [], 2),
    (9072, [], 1), (9080, [5e8, 5e8], 1), (9081, [1e300, -1e300], 1), (9090, [3.0], 1), (9100, [-1.0, -2.0], 1), (-10, [0.5, 0.5], 2),
]


def mined(spark, vectors, **options):
    rows = negatives.mined(frame(spark, vectors), anchor=F.col("vec_id") % 10 == 0, **options).collect()
    return sorted(tuple(r) for r in rows)


@pytest.mark.parametrize("options", [{}, {"tile_values": 600, "tile_anchors": 7, "sample": 5}, {"positives": 2, "negatives": 3, "sample": 60}])
def test_equals_brute_force(spark, options):
    vectors = planted() + ODD + ODD[:8]
    cut = {k: v for k, v in options.items() if k in ("positives", "negatives")}
    want = brute(vectors, **cut)
    assert len(want) > 400 and mined(spark, vectors, **options) == want


def test_ties_go_to_the_smaller_id(spark):
    same = [(i, [1.0, 0.0], 1) for i in range(40)] + [(100 + i, [0.5, 0.3], 2) for i in range(40)]
    random.Random(1).shuffle(same)
    got = mined(spark, same)
    assert got == brute(same)
    assert [r[3] for r in got if r[:2] == (0, 1)] == list(range(100, 110))


def test_long_vectors_stay_exact(spark):
    vectors = planted(120, 5, seed=8, scale=2.0**19)  # scores beyond 2**53
    assert mined(spark, vectors) == brute(vectors)
    assert max(abs(r[4]) for r in brute(vectors)) > 2**53


def test_empty(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(10, [1.0], 1)]) == []


def test_pruning_skips_rows_and_loses_none():
    r = np.random.default_rng(5)
    x = (r.standard_normal((1000, 16)) * 60).astype(np.int64)
    x[:20] = x[0] + r.integers(-3, 3, (20, 16))
    tile = negatives.buckets(x, np.arange(1000), np.zeros(1000, np.int64))[0]
    q = x[0].astype(float)
    length = float(np.linalg.norm(q))
    scores = tile.exact @ x[0]
    for need in sorted(scores)[-30:]:
        kept = tile.candidates(q, length, int(need))
        assert set(np.flatnonzero(scores >= need)) <= set(kept.tolist())
    assert len(tile.candidates(q, length, int(sorted(scores)[-10]))) < 200
    assert not len(tile.candidates(q, length, int(2 * length * tile.longest)))


def test_query_equals_sql(spark, sf):
    cur = connect(sf).execute(SQL)
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    df = op12(spark, sf)
    assert canonical(df.columns, df.collect()) == want and want[1]
