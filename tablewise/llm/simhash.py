"""SimHash near-duplicates: segment popcounts, a grid range-join, exact verification.

A 64-bit fingerprint is embedded as the bit counts of its 16 segments of four bits. Each bit in which
two fingerprints differ moves one count by at most one, so the Manhattan distance of the embeddings
never exceeds the Hamming distance. Fingerprints within three bits are therefore within Manhattan
distance three, and within distance one in at least one half of the segments: the grid has a cell for
each vector of counts of a half, a fingerprint lies in its own cell and looks into those at distance one.
Candidates are checked on the full embedding and then on the fingerprint itself, so no link is missed
and none is wrong.

Equal fingerprints are one node whatever their number, so groups of copies never turn into pairs. The
number of nodes within three bits of one another is what the join's output grows with; the two halves
(``parts=2``) suit up to some ten million different fingerprints, the whole vector as one grid of
radius three (``parts=1``) looks into more cells but meets fewer strangers beyond that.

Defined cases: a null or empty text has fingerprint zero and links like any other. A row without
``doc_id`` gets its fingerprint and component, but gives no component its name (null if it has no
other name). Repeated rows are copies. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tablewise.llm.common import as_bytes, by_value, store, text_pieces
from tablewise.llm.components import components
from tablewise.llm.xxh import xxh64

by_value(__name__)

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Grid: bits of a segment, and the number of grids among which the segments are shared out.
SEGMENT_BITS = 4
PARTS = 2

ONES = np.uint64(0x0101010101010101)


def fingerprints(texts: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """SimHash of each text as signed 64-bit integers."""
    words = [t.lower().split() for t in as_bytes(texts)]
    counts = np.array([max(len(w) - size + 1, 1) if w else 0 for w in words], np.int64)
    out = np.zeros(len(words), np.uint64)
    flat = [x for w in words for x in w]
    if flat:
        n = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        first = np.repeat(np.cumsum(n) - n, counts) + ramp(counts)
        last = first + np.minimum(np.repeat(n, counts), size) - 1
        h = xxh64(b" ".join(flat), starts[first], ends[last] - 1, SEED)
        full = counts > 0
        out[full] = majority(h, counts[full])
    return out.view(np.int64)


def ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count in turn."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits set in over half of each run of ``counts`` hashes (all positive).

    Bytes of a word count eight bits side by side, for at most 255 hashes at a time.
    """
    blocks = -(-counts // 255)
    at = np.repeat(np.cumsum(counts) - counts, blocks) + 255 * ramp(blocks)
    first = np.cumsum(blocks) - blocks
    out = np.zeros(len(counts), np.uint64)
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & ONES, at)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
        over = (2 * sums > counts[:, None]).astype(np.uint64)
        out |= (over << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(bit))).sum(axis=1, dtype=np.uint64)
    return out


def fingerprint_udf():
    def run(texts: pa.Array) -> pa.Array:
        done = [fingerprints(piece) for piece in text_pieces(texts)]
        return pa.array(np.concatenate(done) if done else np.empty(0, np.int64), pa.int64())

    return F.arrow_udf(run, "bigint").asNondeterministic()  # computed once, wherever it is used


def fingerprinted(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` of every row."""
    return docs.select(F.col("doc_id"), fingerprint_udf()("text").alias("fp"))


def moves(dimensions: int, radius: int) -> list[int]:
    """Steps between cells within a Manhattan distance, one of each pair of opposite steps, as differences of cell numbers."""
    side = SEGMENT_BITS + 1
    found = {(0,) * dimensions}
    for _ in range(radius):
        found |= {(*v[:i], v[i] + d, *v[i + 1 :]) for v in found for i in range(dimensions) for d in (-1, 1)}
    return sorted(sum(x * side**i for i, x in enumerate(v)) for v in found if v >= (0,) * dimensions)


def cells(part: int, parts: int):
    """Number of the grid cell: the segments' bit counts as digits."""
    segments = 64 // SEGMENT_BITS // parts
    digit = lambda i: F.bit_count(F.shiftrightunsigned("fp", SEGMENT_BITS * (part * segments + i)).bitwiseAND(2**SEGMENT_BITS - 1))
    return sum((digit(i) * F.lit((SEGMENT_BITS + 1) ** i).cast("bigint") for i in range(1, segments)), digit(0)).cast("bigint")


def links(nodes: DataFrame, distance: int = DISTANCE, parts: int = PARTS) -> DataFrame:
    """Pairs ``u, v`` of different fingerprints (column ``fp``, each once) within ``distance`` bits."""
    steps = F.array(*[F.lit(m).cast("bigint") for m in moves(64 // SEGMENT_BITS // parts, distance // parts)])
    placed = nodes.select("fp", F.posexplode(F.array(*[cells(p, parts) for p in range(parts)])).alias("part", "cell"))
    looks = placed.select(F.col("fp").alias("u"), "part", F.explode(steps).alias("step"), "cell").withColumn("cell", F.col("cell") + F.col("step"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("fp"))) <= distance
    once = F.when(F.col("step") == 0, F.col("u") < F.col("fp")).otherwise(F.col("u") != F.col("fp"))
    return looks.join(placed, ["part", "cell"]).filter(near & once).select("u", F.col("fp").alias("v"))


def classes(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fp, component_id`` of every row; the id is the smallest ``doc_id`` that links reach."""
    prints = store(fingerprinted(docs), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(nodes.select("fp"), distance))
    rooted = store(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "roots")
    names = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = store(rooted.join(names, "root").select("fp", "component_id"), "components")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest ``doc_id``, with the columns it came with.

    Of rows with one ``doc_id`` one stays. Rows without ``doc_id`` cannot be named by a component; of those
    with equal texts one stays.
    """
    away = classes(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("_away")).distinct()
    rows = docs.select("doc_id", "text", F.struct("*").alias("_row"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("_text"))
    left = rows.join(away, F.col("doc_id") == F.col("_away"), "left_anti")
    first = F.row_number().over(Window.partitionBy("doc_id", "_text").orderBy(F.xxhash64("text")))
    return left.withColumn("_place", first).filter("_place = 1").select("_row.*")
