"""Ranked lexical search for many items at once, with shared subexpressions.

A score is a sum over an item's terms, so a set of terms that several items hold needs to be summed for a document only once.
The terms of a block of items are mined for such sets: the pair of nodes that most items share becomes a node of its own, again
and again, until no pair is shared. What results is a graph: leaves are terms, a shared node is the sum of two nodes, an item is
the sum of its nodes. A task reads documents, fills the leaves' accumulators (one number for each document of a batch), adds up every
shared node once, then every item, and keeps the first ``k`` documents of each item; these few rows are ranked once more.

* One scan counts: documents and terms of the corpus, and documents by term, added up map-side. One scan for each block of
  ``BLOCK`` items ranks. A block (its terms, weights and graph) is what travels to tasks, so it is bounded by parameters, also
  where items are many; an item of more than ``TERMS`` terms is a block by itself.
* Mining looks at the ``MINED`` terms of an item that most other items share; the rest of a long item is added term by term. That
  bounds the time it takes and changes no score.
* Documents never leave their task. A batch has a bounded number of bytes and of documents, a longer text is counted in pieces.
  Every document with a score above 0 is a candidate; none is cut before its whole score is known.

All but the weight is 64-bit integer arithmetic, so scores are exact and ties are real: equal scores go by ``doc_id``.

Defined cases: a null text has no term and counts nowhere. Documents without an id count in the statistics and are not ranked;
rows that repeat an id are documents of their own. Items without an id or term have no row; an item id that repeats counts
once, with its least text. Empty tables give an empty result; other columns may have any name.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewise.llm.common import as_bytes, by_value, pieces, store

by_value(__name__)

TOP = 10
#: Items, and terms of items, of one block.
BLOCK = 256
TERMS = 1 << 14
#: Terms of an item that are mined for sets shared with others.
MINED = 64
#: Documents of one batch of accumulators, and numbers that these hold.
BATCH = 256
CELLS = 1 << 22
#: Bytes of a text that are split at once.
PIECE = 1 << 22
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and all beyond ASCII, with A-Z in lower case."""
    return text.translate(LETTERS).split()


def counted(text: bytes) -> Counter:
    """``terms`` with their occurrences, a piece at a time."""
    if len(text) <= PIECE:
        return Counter(terms(text))
    out, low, start = Counter(), text.translate(LETTERS), 0
    while start < len(low):
        stop = low.find(b" ", start + PIECE)
        stop = len(low) if stop < 0 else stop
        out.update(low[start:stop].split())
        start = stop
    return out


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Graph:
    """Sums shared among items.

    ``pairs`` holds for each node after the ``leaves`` the two nodes that it adds; ``items`` the (node, times) that each item adds.
    """

    def __init__(self, items: list[dict[int, int]], leaves: int, mined: int = MINED):
        self.leaves, self.pairs = leaves, []
        sets = [{(t, n) for t, n in item.items()} for item in items]  # a term that an item repeats is shared with items that repeat it as often
        holders = Counter(x for s in sets for x in s)
        self.items: list[list[tuple[int, int]]] = [[] for _ in items]
        open_: list[set[int]] = []
        alias: dict[tuple[int, int], int] = {}
        for own, s in zip(self.items, sets):
            shared = sorted((x for x in s if holders[x] > 1), key=lambda x: (-holders[x], x))[:mined]
            own += sorted(s.difference(shared))
            open_.append({alias.setdefault(x, len(alias)) for x in shared})
        self._mine(open_, [x for x, _ in sorted(alias.items(), key=lambda kv: kv[1])])

    def _mine(self, sets: list[set[int]], start: list[tuple[int, int]]) -> None:
        """Replace the pair of elements that most sets share by a new element until no two sets share a pair."""
        pairs = Counter(p for s in sets for p in combinations(sorted(s), 2))
        where: dict[tuple[int, int], set[int]] = {p: set() for p, n in pairs.items() if n > 1}  # others are never shared later
        del pairs
        for i, s in enumerate(sets):
            for pair in combinations(sorted(s), 2):
                if pair in where:
                    where[pair].add(i)
        queue = [(-len(w), p) for p, w in where.items()]
        heapq.heapify(queue)
        made: list[tuple[int, int]] = []
        while queue:
            size, pair = heapq.heappop(queue)
            now = where[pair]
            if len(now) < 2:
                continue
            if len(now) != -size:  # sets have lost one of the two meanwhile
                heapq.heappush(queue, (-len(now), pair))
                continue
            new = len(start) + len(made)
            made.append(pair)
            fresh = defaultdict(set)
            for i in sorted(now):
                s = sets[i]
                for gone in pair:
                    s.discard(gone)
                for other in s:
                    for gone in pair:
                        where.get((min(gone, other), max(gone, other)), set()).discard(i)
                    fresh[other].add(i)
                s.add(new)
            where[pair] = set()
            for other, w in fresh.items():
                if len(w) > 1:
                    where[other, new] = w
                    heapq.heappush(queue, (-len(w), (other, new)))
        times = lambda x: start[x] if x < len(start) else (self.leaves + x - len(start), 1)
        self.pairs = [(times(a), times(b)) for a, b in made]
        for own, s in zip(self.items, sets):
            own += sorted(times(x) for x in s)

    def additions(self) -> int:
        return len(self.pairs) + sum(map(len, self.items))

    def sums(self, leaves: np.ndarray) -> np.ndarray:
        """Rows of all items from the rows of the leaves."""
        rows = np.empty((self.leaves + len(self.pairs), leaves.shape[1]), np.int64)
        rows[: self.leaves] = leaves
        for at, ((a, m), (b, n)) in enumerate(self.pairs, self.leaves):
            rows[at] = rows[a] * m + rows[b] * n
        out = np.zeros((len(self.items), leaves.shape[1]), np.int64)
        for total, nodes in zip(out, self.items):
            for node, n in nodes:
                total += rows[node] if n == 1 else rows[node] * n
        return out


class Best:
    """The first ``k`` documents of each item among those seen."""

    def __init__(self, items: int, k: int):
        self.k, self.parts, self.size = k, [], 0
        self.least = np.ones(items, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.least[:, None])
        self.parts.append((item, scores[item, doc], ids[doc]))
        self.size += len(item)
        if self.size > 4 * self.k * len(self.least):
            self.rows()

    def rows(self):
        item, score, ids = (np.concatenate(c) for c in zip(*self.parts)) if self.parts else (np.empty(0, np.int64),) * 3
        order = np.lexsort((ids, -score, item))
        item, score, ids = item[order], score[order], ids[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = place == self.k - 1
        self.least[item[last]] = score[last]
        first = place < self.k
        self.parts, self.size = [(item[first], score[first], ids[first])], int(first.sum())
        return self.parts[0]


def _statistics(known: list[bytes]):
    """Rows (term, n): documents by known term; at -1 and -2 all documents with a term, and all terms."""
    place = {t: i for i, t in enumerate(known)}

    def run(batches):
        df, docs, length = np.zeros(len(place), np.int64), 0, 0
        for batch in batches:
            for piece in pieces(batch):
                for text in as_bytes(piece.column(0)):
                    has = counted(text)
                    docs += bool(has)
                    length += has.total()
                    hits = [place[t] for t in has.keys() & place.keys()]
                    df[hits] += 1
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *found.tolist()], pa.int64()), pa.array([docs, length, *df[found].tolist()], pa.int64())], ["term", "n"])

    return run


def _ranked(block: list[tuple[int, dict[bytes, int]]], weights: dict[bytes, int], docs: int, length: int, k: int):
    """Rows (item_id, doc_id, score): the first documents of each item of the block in one task."""
    known = sorted({t for _, item in block for t in item if weights.get(t)})  # a term without weight adds nothing
    place = {t: i for i, t in enumerate(known)}
    w = np.array([weights[t] for t in known], np.int64)
    graph = Graph([{place[t]: n for t, n in item.items() if t in place} for _, item in block], len(known))
    item_ids = np.array([i for i, _ in block], np.int64)
    batch_size = max(1, min(BATCH, CELLS // (len(known) + len(graph.pairs) + 1)))

    def run(batches):
        best = Best(len(block), k)
        ids, cells = [], []

        def flush():
            if cells:
                at, term, tf, n = np.concatenate([np.array(c, np.int64).reshape(4, -1) for c in cells], axis=1)
                m = 100 - 75 + (75 * n * docs) // length
                leaves = np.zeros((len(known), len(ids)), np.int64)
                leaves[term, at] = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
                best.add(graph.sums(leaves), np.array(ids, np.int64))
            ids.clear()
            cells.clear()

        for batch in batches:
            for piece in pieces(batch, 1):
                for doc, text in zip(piece.column(0).to_pylist(), as_bytes(piece.column(1))):
                    has = counted(text)
                    hits = list(has.keys() & place.keys())
                    if not hits:
                        continue
                    cells.append([[len(ids)] * len(hits), [place[t] for t in hits], [has[t] for t in hits], [has.total()] * len(hits)])
                    ids.append(doc)
                    if len(ids) == batch_size:
                        flush()
        flush()
        item, score, doc = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(item_ids[item]), pa.array(doc), pa.array(score)], ["item_id", "doc_id", "score"])

    return run


def blocks(items: DataFrame, block: int, most: int):
    """Items as (item_id, term counts) in blocks of at most ``block`` items and about ``most`` terms, in the order of their ids.

    The driver holds one block and the partition that it reads from.
    """
    now, size = [], 0
    for row in items.orderBy("item_id").toLocalIterator():
        has = counted((row["text"] or "").encode())
        if not has:
            continue
        if now and (len(now) == block or size + len(has) > most):
            yield now
            now, size = [], 0
        now.append((row["item_id"], dict(has)))
        size += len(has)
    if now:
        yield now


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, block: int = BLOCK, most: int = TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the first ``k`` documents of each item."""
    spark = docs.sparkSession
    asked = items.where("item_id IS NOT NULL").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text"))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = []
    totals: dict[int, int] = {}
    for part in blocks(asked, block, most):
        known = sorted({t for _, item in part for t in item})
        counts = docs.select("text").mapInArrow(_statistics(known), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
        rows = {r["term"]: r["n"] for r in counts.collect()}  # one row for each term of the block
        n, length = totals.setdefault(-1, rows.get(-1, 0)), totals.setdefault(-2, rows.get(-2, 0))
        if not n:
            break
        weights = {t: weight(n, rows.get(i, 0)) for i, t in enumerate(known)}
        some = named.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(_ranked(part, weights, n, length, k), "item_id bigint, doc_id bigint, score bigint")
        place = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
        top = some.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        found.append(top)
    if not found:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    if len(found) == 1:
        return found[0]
    out = None
    for top in found:  # every block is written before the next is planned, so plans stay of one size
        top = store(top, "ranked")
        out = top if out is None else out.union(top)
    return out
