"""Exact duplicates against brute force, and the cases the docstring defines."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tablewise.llm import exact

SCHEMA = "doc_id bigint, text string, lang string, kept string, row string, digest string, also string, size string"
SAME_START = "a shared beginning that is longer than the prefix of sixty-four characters, then "
TEXTS = [
    "One", "one", "ONE", "two", None, "", " ", "É", "é", "ÉA", "Éa", "x" * 50_000, "X" * 50_000, "x" * 49_999 + "y",
    SAME_START + "a", SAME_START + "b", SAME_START.upper() + "A", "same length 1", "same length 2", *["copied"] * 30, "tail\n", "tail\r",
]


def frame(spark, extra=True):
    rows = [(i * 3 % 101, t, "en", *["clash"] * 5) for i, t in enumerate(TEXTS)]
    if extra:
        rows += [rows[3], (None, "two", None, *[None] * 5), (None, "only without id", None, *[None] * 5)]
    return spark.createDataFrame(rows, SCHEMA)


def lower(t):
    return (t or "").encode().lower()  # bytes.lower changes A-Z only


def expected(rows):
    by = defaultdict(list)
    for r in rows:
        by[lower(r.text)].append(r.doc_id)
    out = []
    for r in rows:
        ids = by[lower(r.text)]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((r.doc_id, keep, len(ids), r.doc_id == keep, hashlib.sha256(lower(r.text)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"slots": 64}, {"slots": 1}, {"prefix": 1}])
def test_groups(spark, options):
    docs = frame(spark)
    sha = F.sha2(exact.normal(F.col("text")), 256).alias("sha")
    got = [tuple(r) for r in exact.groups(docs, also=[sha], **options).collect()]
    assert sorted(got, key=str) == expected(docs.collect())


def test_deduplicated_keeps_one_row_of_each_text_with_all_columns(spark):
    docs = frame(spark)
    got = exact.deduplicated(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert len(rows) == len({lower(r.text) for r in docs.collect()}) == len({lower(r.text) for r in rows})
    assert all(r.doc_id == want[1] for r in rows for want in expected(docs.collect()) if want[4] == hashlib.sha256(lower(r.text)).hexdigest())


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact.groups(docs).collect() == [] and exact.deduplicated(docs).collect() == []
    assert exact.groups(docs).columns == ["doc_id", "keep_id", "group_size", "kept"]


def test_only_survivors_are_read_whole(spark):
    """With enough bits, texts whose length or beginning is their own have no digest."""
    docs = frame(spark, extra=False)
    found = {r.doc_id: r.digest for r in exact._found(docs, 64, 1 << 22, []).collect()}
    ids = {t: i * 3 % 101 for i, t in enumerate(TEXTS)}
    assert found[ids["x" * 49_999 + "y"]] is not None  # same length and beginning as its neighbours
    assert found[ids[SAME_START + "b"]] is not None
    assert found[ids["tail\n"]] is None and found[ids["same length 1"]] is None
