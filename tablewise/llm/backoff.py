"""Language-model scores by stupid backoff, with the counts of the whole corpus.

A word's score is its n-gram's count over that of the context, if the n-gram occurs elsewhere; else that of the shorter
n-gram, times ``alpha``. Counts leave out the document that is scored, so that a text is not known by itself. A
document's score is the mean of the natural logarithms over its words.

The relations: documents form chunks (by hash) of bounded size; a chunk's different n-grams with their counts, packed as arrays,
are partitioned by hash into buckets; a bucket adds up the counts of all chunks and gives each chunk the totals of
its n-grams; a chunk sums them per document. Most longer n-grams occur in one chunk only, which then knows their
totals itself. To find these, the first bits of all hashes (some more than tell the corpus's n-grams apart) are
compared in the same way before; only n-grams whose first bits another chunk has too are sent whole. Nothing is
left out by this: equal first bits of different n-grams cost a request more. An n-gram is one entry for each chunk, however frequent, so
there is no hot key; chunks and buckets grow in number with the corpus, not in size. N-grams are 64-bit hashes.

Defined cases: a null or empty text has no words and a null score. Rows without ``doc_id`` are scored like any other; each row counts
as a document, so exact copies know each other. A word found nowhere else scores as if seen once in one corpus
more. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import Rolling, as_bytes, by_value, hash_words, mix, pieces

by_value(__name__)

ORDER = 3
ALPHA = 0.4
#: Characters of text in a chunk, and in what a bucket answers for.
CHUNK_CHARS = 6_000_000
BUCKET_CHARS = 12_000_000
LEAST_BUCKETS = 64
#: Bits of a hash beyond those that number the words: an n-gram in 2 ** SPARE_BITS or so is sent in vain.
SPARE_BITS = 4


def small(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def whole(b: bytes) -> bytes:
    return pa.decompress(b[8:], decompressed_size=int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True) if any(b[:8]) else b""


def packed(x: np.ndarray) -> bytes:
    """Integers with their bytes side by side, compressed."""
    return small(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(b: bytes) -> np.ndarray:
    raw = np.frombuffer(whole(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, len(raw) // 8).T).view("<u8").ravel()


class Grams:
    """The n-grams of a chunk of documents: different hashes in order, and where they stand."""

    def __init__(self, texts: list[bytes], order: int, places: bool = True):
        words, offsets = hash_words([t.split() for t in texts])
        self.sizes = np.diff(offsets)
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.at = np.arange(len(words)) - offsets[self.doc]
        rolling = Rolling(words)
        levels = []
        for k in range(1, order + 1):  # by the position of the last word
            h = np.zeros(len(words), np.uint64)
            if len(words) >= k:
                h[k - 1 :] = mix(rolling.grams(k) + np.uint64(k))
            levels.append(h)
        inside = [self.at >= k for k in range(order)]
        self.inside = inside
        every = np.concatenate([h[i] for h, i in zip(levels, inside)])
        if not places:  # hashes and counts are wanted only: sorting the values costs a fraction of sorting their places
            self.hashes, self.counts = np.unique(every, return_counts=True)
            return
        self.hashes, index = np.unique(every, return_inverse=True)
        self.index, start = [], 0
        for i in inside:
            self.index.append(np.full(len(words), -1))
            self.index[-1][i] = index[start : start + int(i.sum())]
            start += int(i.sum())
        self.counts = np.bincount(index, minlength=len(self.hashes))


def bundled(batches):
    """Documents of a chunk from one batch as one compressed Arrow stream, which takes two thirds of the room of the rows in a shuffle."""
    for batch in batches:
        for piece in pieces(batch, 1):
            chunk = piece.column(2).to_numpy()
            order = chunk.argsort(kind="stable")
            edges = [0, *(np.flatnonzero(np.diff(chunk[order])) + 1).tolist(), len(order)]
            docs, streams = piece.select(["doc_id", "text"]), []
            for start, stop in zip(edges, edges[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(docs.take(pa.array(order[start:stop])))
                streams.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(chunk[order[edges[:-1]]]), pa.array(streams, pa.binary())], ["chunk", "docs"])


def unbundled(table: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in table.column("docs").to_pylist()]).combine_chunks()


def first_bits(hashes: np.ndarray, width: int, buckets: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The different first ``width`` bits of ordered hashes, which of them each hash has, and where buckets begin and end."""
    short = hashes >> np.uint64(64 - width)
    new = np.ones(len(short), bool)
    new[1:] = short[1:] != short[:-1]
    short, index = short[new], np.cumsum(new) - 1
    bits = (buckets - 1).bit_length()
    return short, index, np.searchsorted(short >> np.uint64(width - bits), np.arange((1 << bits) + 1)).tolist()


def prints(order: int, buckets: int, width: int):
    """First bits of a chunk's n-grams for each bucket."""

    def run(table: pa.Table) -> pa.Table:
        grams = Grams(as_bytes(unbundled(table).column("text").combine_chunks()), order, places=False)
        short, _, edge = first_bits(grams.hashes, width, buckets)
        rows = [(b, packed(np.diff(short[i:j], prepend=np.uint64(0)))) for b, (i, j) in enumerate(zip(edge, edge[1:])) if i < j]
        b, p = map(list, zip(*rows)) if rows else ([], [])
        chunk = table.column("chunk").slice(0, 1).to_pylist() * len(rows)
        return pa.table({"bucket": pa.array(b, pa.int32()), "chunk": pa.array(chunk, pa.int64()), "prints": pa.array(p, pa.binary())})

    return run


def shared(table: pa.Table) -> pa.Table:
    """One bit for each first bits of a chunk in one bucket: whether another chunk has them too."""
    table = table.combine_chunks()
    parts = [np.cumsum(unpacked(x), dtype=np.uint64) for x in table.column("prints").to_pylist()]
    _, index, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    both = np.split(count[index] > 1, np.cumsum([len(p) for p in parts])[:-1])
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "shared": pa.array([small(np.packbits(x).tobytes()) for x in both], pa.binary())})


def told_shared(found: pa.Table, edge: list[int]) -> np.ndarray:
    """The bits of ``shared`` for all of a chunk's first bits; ``found`` is in the order of the buckets."""
    bits = np.zeros(edge[-1], bool)
    for b, x in zip(found.column("bucket").to_pylist(), found.column("shared").to_pylist()):
        bits[edge[b] : edge[b + 1]] = np.unpackbits(np.frombuffer(whole(x), np.uint8), count=edge[b + 1] - edge[b])
    return bits


def requests(order: int, buckets: int, width: int):
    """A chunk's n-grams that another chunk may have, for each bucket."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        docs, found = unbundled(docs), found.combine_chunks().sort_by("bucket")
        grams = Grams(as_bytes(docs.column("text").combine_chunks()), order, places=False)
        _, index, edge = first_bits(grams.hashes, width, buckets)
        ask = told_shared(found, edge)[index]
        at = np.searchsorted(index, edge).tolist()
        h, c = [], []
        for b in found.column("bucket").to_pylist():
            these = slice(at[b], at[b + 1])
            h.append(packed(np.diff(grams.hashes[these][ask[these]], prepend=np.uint64(0))))
            c.append(packed(grams.counts[these][ask[these]]))
        return pa.table({"bucket": found.column("bucket"), "chunk": found.column("chunk"), "grams": pa.array(h, pa.binary()), "counts": pa.array(c, pa.binary()), "shared": found.column("shared")})

    return run


def answers(table: pa.Table) -> pa.Table:
    """Totals of one bucket's n-grams for each chunk that holds them."""
    table = table.combine_chunks()
    hashes = [np.cumsum(unpacked(x), dtype=np.uint64) for x in table.column("grams").to_pylist()]
    counts = [unpacked(x) for x in table.column("counts").to_pylist()]
    every = np.concatenate(hashes)
    order = np.argsort(every, kind="stable")
    new = np.ones(len(every), bool)
    new[1:] = every[order][1:] != every[order][:-1]
    totals = np.empty(len(every), np.uint64)
    if len(every):
        sums = np.add.reduceat(np.concatenate(counts)[order], np.flatnonzero(new))
        totals[order] = sums[np.cumsum(new) - 1]
    parts = np.split(totals, np.cumsum([len(h) for h in hashes])[:-1])
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "totals": pa.array([packed(p) for p in parts], pa.binary()), "shared": table.column("shared")})


def scores(order: int, alpha: float, words: int, buckets: int, width: int):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        docs, found = unbundled(docs), found.combine_chunks().sort_by("bucket")
        grams = Grams(as_bytes(docs.column("text").combine_chunks()), order)
        _, index, edge = first_bits(grams.hashes, width, buckets)
        totals = grams.counts.astype(np.int64)  # of n-grams that no other chunk has
        totals[told_shared(found, edge)[index]] = np.concatenate([unpacked(x) for x in found.column("totals").to_pylist()] or [np.empty(0, np.uint64)]).astype(np.int64)
        left = []
        for index in grams.index:  # counts elsewhere: totals without those of the document itself
            value = np.zeros(len(index), np.int64)
            here = index >= 0
            if here.any():
                pair = grams.doc[here] * len(grams.hashes) + index[here]
                _, back, own = np.unique(pair, return_inverse=True, return_counts=True)
                value[here] = totals[index[here]] - own[back]
            left.append(value)
        elsewhere = np.maximum(words - grams.sizes[grams.doc], 0)
        log = np.where(left[0] > 0, np.log(np.maximum(left[0], 1)) - np.log(np.maximum(elsewhere, 1)), -np.log(elsewhere + 1.0))
        depth = np.ones(len(log), np.int64)
        for k in range(1, order):
            seen = left[k] > 0
            context = np.zeros(len(log), np.int64)
            context[1:] = left[k - 1][:-1]
            log = np.where(grams.inside[k], np.where(seen, np.log(np.maximum(left[k], 1)) - np.log(np.maximum(context, 1)), log + math.log(alpha)), log)
            depth = np.where(seen, k + 1, depth)
        n = len(grams.sizes)
        total = np.bincount(grams.doc, weights=log, minlength=n)
        full = np.bincount(grams.doc, weights=depth == order, minlength=n).astype(np.int64)
        score = pa.array(total / np.maximum(grams.sizes, 1), mask=grams.sizes == 0)
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(grams.sizes), "n_full": pa.array(full), "score": score})

    return run


def scored(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, chunk_chars: int = CHUNK_CHARS, bucket_chars: int = BUCKET_CHARS, least_buckets: int = LEAST_BUCKETS, spare_bits: int = SPARE_BITS) -> DataFrame:
    """``doc_id, n_words``, ``n_full`` (words whose longest n-gram occurs elsewhere) and ``score`` of every row.

    A context's count is that of the n-gram one shorter that ends before the word, the document left out.
    """
    size = docs.agg(F.sum(F.length("text")).alias("c"), F.sum(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")).alias("w")).first()
    chars, words = size["c"] or 0, size["w"] or 0
    chunks = chars // chunk_chars + 1
    buckets = 1 << max(chars * order // bucket_chars, least_buckets - 1).bit_length()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"))
    keyed = keyed.mapInArrow(bundled, "chunk bigint, docs binary")
    width = min(max((words * order).bit_length(), buckets.bit_length()) + spare_bits, 64)
    first = keyed.groupBy("chunk").applyInArrow(prints(order, buckets, width), "bucket int, chunk bigint, prints binary")
    known = first.groupBy("bucket").applyInArrow(shared, "chunk bigint, bucket int, shared binary")
    asked = keyed.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(requests(order, buckets, width), "bucket int, chunk bigint, grams binary, counts binary, shared binary")
    told = asked.groupBy("bucket").applyInArrow(answers, "chunk bigint, bucket int, totals binary, shared binary")
    return keyed.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(scores(order, alpha, words, buckets, width), "doc_id bigint, n_words bigint, n_full bigint, score double")
