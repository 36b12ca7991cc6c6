"""Substring deduplication: relative Lempel-Ziv factors against indexed reference blocks.

Documents are parsed into blocks at places that the words themselves choose: every window of 50 words
has an anchor, the smallest hash among its 10-word grams, and a block is a stretch of windows that share
their anchor. Equal stretches of words are parsed alike wherever they stand, so the index of all blocks,
keyed by anchor, is a reference into which each document is factored from left to right:

* a block whose whole word sequence stands in a smaller document is a factor (consecutive ones run together);
* where a factor ends, the blocks at its border share their anchor with a reference block but not all
  their words. There, and only there, windows are compared one by one, so that factors of 50 words
  or more are found to the exact word, and shorter ones count for nothing.

The words of all factors are removed. Blocks and windows are compared by 128 bits (anchor and content).

Work per document is linear, and a passage that a third of all documents hold is one row for each of
them, combined before each shuffle. What is broadcast is Spark's own choice.

Defined cases: a null or empty text has no words. Rows without ``doc_id`` keep all their words and take
none from others. Rows that share a ``doc_id`` do not take words from each other. Repeats within one
document stay. An empty table gives an empty result. The order of equal rows does not matter.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import Rolling, as_bytes, by_value, discard, hash_words, mix, pieces, store

by_value(__name__)

WINDOW = 50
GRAM = 10
#: Windows of a block at most, so that a bit mask holds them.
BLOCK = 64
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every ``k`` neighbours."""
    width = 1
    while 2 * width <= k:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = k - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def parse(texts: list[bytes], window: int = WINDOW):
    """``document, start, windows, anchor, content`` of the blocks of ``texts``."""
    hashes, offsets = hash_words([t.split() for t in texts])
    if len(hashes) < window:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    rolling = Rolling(hashes)
    low = sliding_min(rolling.grams(GRAM), window - GRAM + 1)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    whole = doc[: len(low)] == doc[window - 1 :]
    new = whole.copy()
    new[1:] &= ~(whole[:-1] & (low[1:] == low[:-1]))
    first = np.flatnonzero(new)
    ends = np.flatnonzero(whole & ~np.append(whole[1:] & ~new[1:], False)) + 1
    parts = -(-(ends - first) // BLOCK)  # only windows that repeat their anchor form longer blocks
    step = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    ends = np.minimum(np.repeat(ends, parts), np.repeat(first, parts) + BLOCK * (step + 1))
    first = np.repeat(first, parts) + BLOCK * step
    count = ends - first
    content = mix(rolling.span(first, ends + window - 1) + count.astype(np.uint64))
    return doc[first], first - offsets[doc[first]], count, low[first].view(np.int64), content.view(np.int64)


def _blocks(batches):
    """Blocks of each row of ``doc_id, _text_key, text``; ``at`` holds start and number of windows."""
    for batch in batches:
        for piece in pieces(batch, 2):
            doc, start, count, anchor, content = parse(as_bytes(piece.column(2)))
            pick = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(pick), piece.column(1).take(pick), pa.array(start << 8 | count), pa.array(anchor), pa.array(content)],
                ["doc_id", "_text_key", "at", "anchor", "content"],
            )


def _windows(batches):
    """One row for each window of the asked blocks: ``_text_key, text, asked[(anchor, content, at)], doc_id``."""
    for batch in batches:
        for piece in pieces(batch, 1):
            hashes, offsets = hash_words([t.split() for t in as_bytes(piece.column(1))])
            asked = piece.column(2)
            doc = np.repeat(np.arange(len(asked)), np.diff(asked.offsets.to_numpy()))
            flat = asked.flatten()
            anchor, content, at = (flat.field(i).to_numpy() for i in range(3))
            count = at & 255
            row = np.repeat(np.arange(len(at)), count)
            bit = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = (offsets[doc] + (at >> 8))[row] + bit
            window = Rolling(hashes).span(start, start + WINDOW).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[row]), pa.array(content[row]), pa.array(bit), pa.array(window), piece.column(0).take(pa.array(doc[row]))],
                ["anchor", "content", "bit", "window", "doc_id"],
            )


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("_text_key"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")


def factors(docs: DataFrame) -> DataFrame:
    """``doc_id, _text_key, at, mask``: blocks with the windows (bits of the mask) that also start in a smaller document."""
    blocks = store(keyed(docs).mapInArrow(_blocks, "doc_id bigint, _text_key bigint, at bigint, anchor bigint, content bigint"), "blocks")
    reference = store(
        blocks.groupBy("anchor")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("content").alias("low"), F.max("content").alias("high"))
        .filter("first < last").select("anchor", "first", (F.col("low") == F.col("high")).alias("alike")),
        "reference",
    )
    every = F.lit(-1).cast("bigint")
    hits = store(blocks.join(reference, "anchor"), "hits")
    discard(blocks)
    discard(reference)
    plain = hits.filter("alike AND doc_id > first").select("doc_id", "_text_key", "at", every.alias("mask"))
    mixed = hits.filter("NOT alike")
    kinds = store(
        mixed.groupBy("anchor", "content").agg(F.min_by(F.struct("doc_id", "_text_key", "at"), F.struct("doc_id", "_text_key", "at")).alias("k")).select("anchor", "content", "k.*"),
        "kinds",
    )
    asked = kinds.groupBy("doc_id", "_text_key").agg(F.collect_list(F.struct("anchor", "content", "at")).alias("asked"))
    windows = store(
        keyed(docs).join(asked, ["doc_id", "_text_key"]).select("doc_id", "text", "asked")
        .mapInArrow(_windows, "anchor bigint, content bigint, bit bigint, window bigint, doc_id bigint"),
        "windows",
    )
    lowest = store(
        windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last"),
        "lowest",
    )
    later = windows.join(lowest, ["anchor", "window"]).filter("doc_id > first")
    bits = later.groupBy("anchor", "content").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("bits"))
    shown = store(kinds.join(bits, ["anchor", "content"], "left").select("anchor", "content", F.col("doc_id").alias("_least"), F.coalesce("bits", F.lit(0)).alias("bits")), "shown")
    for done in (windows, lowest, kinds):
        discard(done)
    edges = mixed.join(shown, ["anchor", "content"]).select("doc_id", "_text_key", "at", F.when(F.col("doc_id") > F.col("_least"), every).otherwise(F.col("bits")).alias("mask"))
    return plain.union(edges.filter("mask <> 0"))


def covered(n: int, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in a window of the factors."""
    count = at & 255
    row = np.repeat(np.arange(len(at)), count)
    bit = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = (at >> 8)[row] + bit
    start = start[(mask[row] >> bit) & 1 == 1]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def with_factors(docs: DataFrame) -> DataFrame:
    """``_row`` (struct of the input's columns) and ``_at``, ``_mask`` (arrays; null where nothing repeats)."""
    found = factors(docs).groupBy("doc_id", "_text_key").agg(F.collect_list(F.struct("at", "mask")).alias("f"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("_text_key").alias("_key"), F.col("f.at").alias("_at"), F.col("f.mask").alias("_mask"))
    rows = docs.select(F.struct("*").alias("_row"))
    same = (F.col("_row.doc_id") == F.col("_id")) & (F.xxhash64("_row.text") == F.col("_key"))
    return rows.join(found, same, "left").select("_row", "_at", "_mask")


def _texts(piece: pa.RecordBatch):
    """The UTF-8 text and the flags of removed words (None where nothing is) of each row."""
    texts = as_bytes(piece.column(0).field("text"))
    ats, masks = piece.column(1), piece.column(2)
    for i, text in enumerate(texts):
        if ats[i].is_valid:
            yield text, covered(len(text.split()), np.array(ats[i].as_py(), np.int64), np.array(masks[i].as_py(), np.int64))
        else:
            yield text, None


def _sized(batches):
    """Slices of batches of ``with_factors`` by the bytes of their texts."""
    for batch in batches:
        probe = pa.RecordBatch.from_arrays([batch.column(0).field("text")], ["text"])
        at = 0
        for piece in pieces(probe):
            yield batch.slice(at, piece.num_rows)
            at += piece.num_rows


def _digests(batches):
    for piece in _sized(batches):
        out = []
        for text, gone in _texts(piece):
            words = text.split()
            kept = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
            out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        n, removed, sha = map(list, zip(*out))
        yield pa.RecordBatch.from_arrays(
            [piece.column(0).field("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"]
        )


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row."""
    return with_factors(docs.select("doc_id", "text")).mapInArrow(_digests, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def stretches(text: bytes, gone: np.ndarray) -> bytes:
    """``text`` without the removed words: what lies between is left as it was, stretches are joined by one space."""
    spans = [m.span() for m in WORD.finditer(text)]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
    return b" ".join(text[spans[a][0] : spans[b - 1][1]] for a, b in edge.reshape(-1, 2).tolist())


def _cut(batches):
    for piece in _sized(batches):
        row = piece.column(0)
        texts = [(text if gone is None or not gone.any() else stretches(text, gone)).decode() for text, gone in _texts(piece)]
        valid = row.field("text").is_valid().to_pylist()
        new = {"text": pa.array([t if v else None for t, v in zip(texts, valid)], pa.string())}
        if "n_chars" in (names := [f.name for f in row.type]):
            new["n_chars"] = pa.array([len(t) if v else None for t, v in zip(texts, valid)], row.type.field("n_chars").type)
        out = pa.StructArray.from_arrays([new.get(n, row.field(n)) for n in names], names)
        yield pa.RecordBatch.from_arrays([out], ["_row"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """The input with repeated stretches cut out of ``text`` (and ``n_chars`` counted anew, if there is such a column)."""
    rows = with_factors(docs)
    return rows.mapInArrow(_cut, f"_row {rows.schema['_row'].dataType.simpleString()}").select("_row.*")
