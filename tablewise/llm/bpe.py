"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash over its last words says so, at the white space before a word.
Equal passages are thus cut alike in every document, and a chunk that several documents share is encoded
once in each worker; what a new chunk needs is looked up word by word if the tokenizer drops white space
(then no token can reach across it), else encoded as a whole. Each join of two chunks is checked by
encoding the words beside it together. Where the result is not that of the two sides, the chunks are
merged and encoded anew, until every join agrees; a text without agreeing joins ends as one chunk. The ids
are then those of the whole text. Decoding is the library's, over all ids of a document.

Caches hold a stated number of entries in each worker and drop the oldest; they change the time taken,
never the result. Nothing is shuffled: sending the corpus to meet its copies would cost more than
encoding what one worker has not seen.

Defined cases: a null or empty text has no tokens and decodes to the empty text. Rows may repeat and
may lack any other column; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import Rolling, as_bytes, by_value, hash_words, mix, text_pieces

by_value(__name__)

#: Words that the rolling hash sees, and words in a chunk on average.
ROLL = 3
MEAN_WORDS = 64
#: Stands between short texts that are encoded as one.
MARK = b"\x01"
#: Entries of the caches of a worker.
WORDS = 400_000
CHUNKS = 40_000
JOINS = 200_000


class Cache(dict):
    """A dictionary that forgets its oldest tenth when it is full."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def room(self) -> None:
        if len(self) >= self.limit:
            for key in list(self)[: max(self.limit // 10, 1)]:
                del self[key]


class Codec:
    """The tokenizer in ``path`` with the caches of one worker."""

    def __init__(self, path: str, words: int = WORDS, chunks: int = CHUNKS, joins: int = JOINS, mean: int = MEAN_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words, self.chunks, self.joins = Cache(words), Cache(chunks), Cache(joins)
        self.mean = mean
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.decimal = [str(i) for i in range(size)]
        self.tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        word, spaced, space, mark = self.encode([b"ab", b" \t\r\nab\n\x0b\x0c", b" \n", MARK])
        self.drops_white_space = word == spaced and not space
        self.mark = np.frombuffer(mark, "<i4")[0] if self.drops_white_space and len(mark) == 4 else None

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as 32-bit integers."""
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<i4").tobytes() for e in found]

    def encode_short(self, texts: list[bytes]) -> list[bytes]:
        """The same for many short texts. Where white space is dropped, they go through the library as one
        text with a mark between them; should a text hold the mark's token itself, each goes alone."""
        if self.mark is None or len(texts) < 2:
            return self.encode(texts)
        ids = np.frombuffer(self.encode([(b" " + MARK + b" ").join(texts)])[0], "<i4")
        at = np.flatnonzero(ids == self.mark)
        if len(at) != len(texts) - 1:
            return self.encode(texts)
        data, bounds = ids.tobytes(), [-4, *(4 * at).tolist(), 4 * len(ids)]
        return [data[x + 4 : y] for x, y in zip(bounds, bounds[1:])]

    def known(self, cache: Cache, keys: list[bytes]) -> list[bytes]:
        """Ids of ``keys``; what ``cache`` lacks is encoded and remembered."""
        new = [k for k in keys if k not in cache]
        found = {}
        for at in range(0, len(new), 2048):
            part = new[at : at + 2048]
            found.update(zip(part, self.encode_short(part)))
        out = [found[k] if k in found else cache[k] for k in keys]
        cache.room()
        cache.update(list(found.items())[: cache.limit // 2])
        return out

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of whole texts as 32-bit integers."""
        split = [t.split() for t in texts]
        hashes, offsets = hash_words(split)
        if not len(hashes):
            return [b""] * len(texts) if self.drops_white_space else self.encode(texts)
        first, last, doc = self.cut(hashes, offsets)
        flat = np.empty(len(hashes), dtype=object)
        flat[:] = list(chain.from_iterable(split))
        if self.drops_white_space:
            done = self.from_words(flat, hashes, first, last)
            raw = None
        else:
            raw = self.slices(texts, split, first - offsets[doc], last - offsets[doc], doc)
            done = self.known(self.chunks, raw)
        sides = [(a, b) for a, b in zip(flat[first].tolist(), flat[last - 1].tolist())]
        self.check(sides, doc)
        out, at = [], np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
        for i, text in enumerate(texts):
            a, b = at[i], at[i + 1]
            if a == b:
                out.append(self.encode([text])[0] if text and not self.drops_white_space else b"")
            else:
                out.append(self.joined(raw[a:b] if raw else None, sides[a:b], done[a:b], split[i], (first[a:b] - offsets[i]).tolist()))
        return out

    def cut(self, hashes: np.ndarray, offsets: np.ndarray):
        """First and last (excluded) word and document of each chunk."""
        ends = np.flatnonzero(Rolling(hashes).grams(ROLL) % np.uint64(self.mean) == 0) + ROLL  # a chunk ends after such words
        owner = np.searchsorted(offsets, ends - 1, side="right") - 1
        ends = ends[ends - ROLL >= offsets[owner]]
        last = np.union1d(ends, offsets[1:][np.diff(offsets) > 0])
        first = np.concatenate([[0], last[:-1]])
        return first, last, np.searchsorted(offsets, first, side="right") - 1

    def from_words(self, flat: np.ndarray, hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """Ids of each chunk: those seen before as they were, the others put together from their words."""
        one, two = Rolling(hashes).span(first, last).tolist(), Rolling(mix(hashes)).span(first, last).tolist()
        keys = list(zip(one, two, (last - first).tolist()))  # 128 bits and the length name a chunk
        new = list({k: i for i, k in enumerate(keys) if k not in self.chunks}.values())
        fresh = {}
        if new:
            size = (last - first)[new]
            row = np.repeat(first[new], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            codes, different = pd.factorize(flat[row])
            ids = self.known(self.words, different.tolist())
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            start = np.cumsum(n) - n
            count = n[codes]
            every = np.frombuffer(b"".join(ids), "<i4")
            upto = np.cumsum(count)
            tokens = every[np.repeat(start[codes] - upto + count, count) + np.arange(int(upto[-1]))].tobytes()
            bounds = [0, *(4 * upto[np.cumsum(size) - 1]).tolist()]
            fresh = {keys[i]: tokens[a:b] for i, a, b in zip(new, bounds, bounds[1:])}
        done = [fresh[k] if k in fresh else self.chunks[k] for k in keys]
        self.chunks.room()
        self.chunks.update(list(fresh.items())[: self.chunks.limit // 2])
        return done

    def slices(self, texts, split, first, last, doc) -> list[bytes]:
        """The bytes of each chunk: all but a text's first begin with the white space before their first word."""
        out, place = [], {}
        for i in dict.fromkeys(doc.tolist()):
            at, bounds = 0, []
            for w in split[i]:
                at = texts[i].index(w, at) + len(w)
                bounds.append(at)
            bounds[-1] = len(texts[i])
            place[i] = bounds
        for a, b, i in zip(first.tolist(), last.tolist(), doc.tolist()):
            out.append(texts[i][place[i][a - 1] if a else 0 : place[i][b - 1]])
        return out

    def check(self, sides, doc: np.ndarray) -> None:
        """Encode together the words beside each join."""
        if self.drops_white_space:
            same = (doc[1:] == doc[:-1]).tolist()
            pairs = {(a[1], b[0]) for a, b, s in zip(sides, sides[1:], same) if s}
            new = [p for p in pairs if p not in self.joins]
            both = []
            for at in range(0, len(new), 2048):
                both += self.encode_short([a + b" " + b for a, b in new[at : at + 2048]])
            left, right = (self.known(self.words, [p[k] for p in new]) for k in (0, 1))
            self.joins.room()
            self.joins.update((p, x == a + b) for p, x, a, b in zip(new, both, left, right))

    def joined(self, raw, sides, done, words, first) -> bytes:
        """Ids of the chunks in a row; chunks whose join does not agree are merged and encoded anew."""
        if raw is None and all(self.joins.get((a[1], b[0])) for a, b in zip(sides, sides[1:])):
            return b"".join(done)
        pieces = raw or [b" " + b" ".join(words[a:b]) for a, b in zip(first, [*first[1:], len(words)])]
        out: list[tuple[bytes, bytes]] = []
        for piece, ids in zip(pieces, done):
            while out and not self.agree(out[-1], (piece, ids)):
                piece = out.pop()[0] + piece
                ids = self.encode([piece])[0]
            out.append((piece, ids))
        return b"".join(ids for _, ids in out)

    def agree(self, left, right) -> bool:
        """Whether the words beside a join, encoded together, give what ends the left side and begins the right one."""
        word = left[0].split()[-1]
        tail = left[0][left[0].rindex(word) :]
        word = right[0].split()[0]
        head = right[0][: right[0].index(word) + len(word)]
        both, a, b = self.encode([tail + head, tail, head])
        return both == a + b

    def decode(self, ids: list[int]) -> str:
        """As the library decodes; without a decoder that is its tokens, joined by a space."""
        if self.tokenizer.decoder is None:
            return " ".join(map(self.tokens.__getitem__, ids))
        return self.tokenizer.decode(ids, skip_special_tokens=False)


_codecs: dict[tuple, Codec] = {}


def codec(path: str, **sizes) -> Codec:
    """The codec of this worker, loaded once."""
    key = (path, *sorted(sizes.items()))
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(path, **sizes)
    return _codecs[key]


def _encoder(path: str, sizes: dict):
    def run(texts: pa.Array) -> pa.Array:
        flat, counts = [], [0]
        for piece in text_pieces(texts):
            for ids in codec(path, **sizes).ids(as_bytes(piece)):
                flat.append(ids)
                counts.append(counts[-1] + len(ids) // 4)
        return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(np.frombuffer(b"".join(flat), "<i4")))

    return run


def encoded(docs: DataFrame, path: str, column: str = "ids", **sizes) -> DataFrame:
    """The input with the token ids of ``text`` in ``column`` (which replaces one of that name)."""
    ids = F.arrow_udf(_encoder(path, sizes), "array<int>").asNondeterministic()("text")
    return docs.withColumn(column, ids)


def decoded(encoded: DataFrame, path: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """The input with the text that the token ids in ``ids`` decode to (null ids: empty) in ``column``."""

    def run(lists: pa.Array) -> pa.Array:
        return pa.array([codec(path).decode(x or []) for x in lists.to_pylist()], pa.string())

    return encoded.withColumn(column, F.arrow_udf(run, "string")(ids))


def _measured(docs: DataFrame, path: str, sizes: dict, keep_ids: bool) -> DataFrame:
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids]
    kinds = ["bigint", "string", "string", *["array<int>"] * keep_ids]

    def run(texts: pa.Array) -> pa.Array:
        own = codec(path, **sizes)
        every, counts, ids_sha, text_sha = [], [], [], []
        for piece in text_pieces(texts):
            for packed in own.ids(as_bytes(piece)):
                ids = np.frombuffer(packed, "<i4").tolist()
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(own.decimal.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
                if keep_ids:
                    every.append(packed)
        out = [pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
        if keep_ids:
            bounds = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            out.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.frombuffer(b"".join(every), "<i4"))))
        return pa.StructArray.from_arrays(out, names)

    measure = F.arrow_udf(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds))).asNondeterministic()
    old = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*old, measure("text").alias("_measured")).select(*old, "_measured.*")


def digests(docs: DataFrame, path: str, **sizes) -> DataFrame:
    """The input with ``n_tokens, ids_sha256, decoded_sha256``; ids and decoded texts stay in the workers."""
    return _measured(docs, path, sizes, False)


def with_ids(docs: DataFrame, path: str, **sizes) -> DataFrame:
    """The same with the token ids in ``ids`` as well."""
    return _measured(docs, path, sizes, True)
