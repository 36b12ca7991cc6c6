"""Ranked search for many items against brute force, and the cases the docstring defines."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tablewise.llm import ranking

DOCS = "doc_id bigint, text string, item_id string, rank string, score string, term string"
ITEMS = "item_id bigint, text string, doc_id string, rank string, n string"
TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def terms(text):
    return TERM.findall((text or "").encode().lower().decode()) if text else []


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(bool(c) for _, c in held)
    length = sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    least = {}
    for i, t in items:
        if i is not None and t is not None:
            least[i] = min(least.get(i, t), t)
    for item, text in least.items():
        scores = []
        for doc, c in held:
            if not c or doc is None:
                continue
            m = 100 - 75 + (75 * c.total() * n) // length
            score = 0
            for t in terms(text):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc))
        out += [(item, r + 1, doc, -s) for r, (s, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def tables(spark, docs, items):
    return (spark.createDataFrame([(i, t, *["clash"] * 4) for i, t in docs], DOCS).repartition(5), spark.createDataFrame([(i, t, *["clash"] * 3) for i, t in items], ITEMS))


def corpus(seed=2, n=400):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdé1", k=r.randint(1, 4))) for _ in range(150)]
    write = lambda m: " ".join(r.choice(vocabulary[: r.choice([10, 150])]).swapcase() + r.choice(["", ",", "\n", "-\x00", "'"]) for _ in range(m))
    docs = [(i, write(r.choice([3, 30, 120]))) for i in range(n)]
    docs += [(n, docs[7][1]), (n + 1, docs[7][1]), docs[7], (None, docs[9][1]), (n + 2, None), (n + 3, ""), (n + 4, " .,;"), (n + 5, write(9000)), (n + 6, "Ünïque ünïque")]
    parts = [write(6) for _ in range(12)]
    items = [(i, " ".join(r.sample(parts, 3)) + " " + write(r.choice([0, 4, 40]))) for i in range(60)]
    items += [(100, None), (101, ""), (102, "absent"), (103, docs[7][1]), (104, "ünïque"), (None, "a b"), (105, "bb aa"), (105, "aa"), items[0], (106, write(3000)), (107, "a a a b")]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"block": 25}, {"most": 400, "k": 3}])
def test_equals_brute_force(spark, options):
    docs, items = corpus()
    want = brute(docs, items, options.get("k", 10))
    got = sorted(tuple(r) for r in ranking.ranked(*tables(spark, docs, items), **options).collect())
    assert len(want) > 150 and got == want


def test_long_texts_are_counted_in_pieces(monkeypatch):
    docs, _ = corpus()
    for size in (1, 7, 100):
        monkeypatch.setattr(ranking, "PIECE", size)
        for _, text in docs[:60]:
            assert ranking.counted((text or "").encode()) == Counter(t.encode() for t in terms(text))


def test_shared_sums_are_exact_and_fewer():
    r = random.Random(4)
    shared = [r.sample(range(80), 8) for _ in range(10)]
    items = []
    for _ in range(50):
        item = Counter(t for s in r.sample(shared, 3) for t in s)
        item.update(r.choices(range(200), k=5))
        items.append(dict(item))
    leaves = np.random.default_rng(1).integers(0, 10**12, (200, 9))
    want = np.array([sum(leaves[t] * n for t, n in item.items()) for item in items])
    plain = sum(map(len, items))
    graph = ranking.Graph(items, 200)
    assert (graph.sums(leaves) == want).all() and graph.pairs and graph.additions() < 0.7 * plain
    for mined in (0, 3):
        few = ranking.Graph(items, 200, mined)
        assert (few.sums(leaves) == want).all() and graph.additions() < few.additions() <= plain
    for item, nodes in zip(items, graph.items):  # what two items share is one node in both
        assert len(nodes) <= len(item)


def test_best_keeps_ties_by_id():
    best = ranking.Best(2, 3)
    r = np.random.default_rng(3)
    ids = r.permutation(3000)
    scores = r.integers(0, 4, (2, 3000))
    for at in range(0, 3000, 100):
        best.add(scores[:, at : at + 100], ids[at : at + 100])
    item, score, doc = best.rows()
    for i in range(2):
        want = sorted((-s, d) for s, d in zip(scores[i].tolist(), ids.tolist()) if s > 0)[:3]
        assert [(-s, d) for s, d in zip(score[item == i].tolist(), doc[item == i].tolist())] == want


def test_empty(spark):
    docs, items = corpus()
    assert ranking.ranked(*tables(spark, [], items)).collect() == []
    assert ranking.ranked(*tables(spark, docs, [])).collect() == []
    assert ranking.ranked(*tables(spark, [(1, None), (2, "..")], items)).collect() == []
