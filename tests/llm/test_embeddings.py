"""Embedding near-duplicates as shipped: recall on planted pairs, counts of both sides, lengths and precision."""

import numpy as np
import pytest

from tablewise.llm import embeddings

LONG = "vec_id bigint, embedding array<double>, label int, size string, cell string"


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, e) for i, e in rows], f"vec_id bigint, embedding array<{kind}>")


def planted(pairs, width, cosine, seed):
    """Pairs at exactly one cosine, far from all others."""
    r = np.random.default_rng(seed)
    x = embeddings.unit(r.standard_normal((pairs, width)))
    aside = r.standard_normal(x.shape)
    aside = embeddings.unit(aside - (aside * x).sum(1, keepdims=True) * x)
    return x, cosine * x + np.sqrt(1 - cosine**2) * aside


def test_recall_of_planted_pairs_with_shipped_settings(spark):
    pairs = 4000
    x, y = planted(pairs, 64, 0.9505, 2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(pairs + i, v.tolist()) for i, v in enumerate(y)]
    got = {r.vec_id: r for r in embeddings.classes(frame(spark, rows, "double")).collect()}
    linked = [i for i in range(pairs) if got[i].n_links]
    assert len(linked) >= 0.99 * pairs
    for i in range(pairs):  # a link is counted on both sides or on none
        a, b = got[i], got[pairs + i]
        assert a.n_links == b.n_links and a.n_links in (0, 1)
        assert b.component_id == (i if a.n_links else pairs + i) and a.component_id == i and b.kept == (not a.n_links)


def test_counts_are_even_in_dense_groups(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal((40, 32))
    rows = [(i, (base[i % 40] + 0.16 * r.standard_normal(32)).tolist()) for i in range(1500)]
    x = embeddings.unit(np.array([np.array(e, np.float32) for _, e in rows], np.float64))
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    got = {q.vec_id: q.n_links for q in embeddings.classes(frame(spark, rows), centroids=6, tile=100, recall=0.97).collect()}
    total = sum(got.values())
    assert total % 2 == 0 and 0.9 * near.sum() <= total <= near.sum()
    assert all(got[i] <= near[i].sum() for i in got)


def test_every_length_links_within_itself(spark):
    rows = [(0, [2.0]), (1, [3.0]), (2, [-1.0]), (3, [1.0, 0.0]), (4, [1.0, 0.01]), (5, [1.0, 0.0, 0.0]), (6, []), (7, [0.0])]
    r = np.random.default_rng(1)
    rows += [(10 + i, r.standard_normal(8).tolist()) for i in range(200)] + [(300, None), (301, None)]
    rows += [(400 + i, rows[8 + i][1]) for i in range(5)]
    got = {q.vec_id: (q.n_links, q.component_id, q.kept) for q in embeddings.classes(frame(spark, rows, "double")).collect()}
    assert got[0] == (1, 0, True) and got[1] == (1, 0, False) and got[2] == (0, 2, True)
    assert got[3] == (1, 3, True) and got[4] == (1, 3, False) and got[5] == got[5][:1] + (5, True) == (0, 5, True)
    assert got[6] == (0, 6, True) and got[7] == (0, 7, True) and got[300] == (0, 300, True)
    for i in range(5):
        assert got[400 + i][1] == 10 + i and got[400 + i][0] >= 1


def test_doubles_keep_their_range(spark):
    rows = [(1, [1e300, 1e290]), (2, [1e300, 1e299]), (3, [1e-300, 0.0]), (4, [0.0, 1e300])]
    got = {q.vec_id: (q.n_links, q.component_id) for q in embeddings.classes(frame(spark, rows, "double")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


@pytest.mark.parametrize("limit", [0.0, 0.4, 1.3, 9.0])
def test_visits_are_all_cells_within_the_limit(limit):
    r = np.random.default_rng(4)
    low1, low2 = r.random((50, 7)), r.random((50, 5))
    row, cell = embeddings.visits(low1, low2, limit)
    want = {(i, a * 5 + b) for i in range(50) for a in range(7) for b in range(5) if low1[i, a] + low2[i, b] <= limit}
    assert len(row) == len(want) and set(zip(row.tolist(), cell.tolist())) == want
