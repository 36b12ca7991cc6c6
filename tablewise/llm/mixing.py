"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in an order drawn by a hash, form blocks of equal size. With target weight k/K a
source's j-th block is released at slot floor(j K / k) and due by slot ceil((j + 1) K / k); on every slot the
released block with the earliest deadline goes next. The weights sum to one, so every deadline is met,
and at any slot each source has had within one block of its share. The schedule repeats after K slots: the
driver works out one period (K rows, a parameter), and each block finds its slot by arithmetic, whatever
the number of documents.

A source that runs out leaves its later slots empty; they are closed up, so that the rest go on in
the proportions of their weights. Every document appears exactly once.

Hot sources: the place of a document within its source comes from counts of small hash buckets, so that
no task orders a whole source.

Defined cases: a null source is a source of its own. Sources without a weight, or with none above zero, have the smallest
weight that there is, one slot in K; weights of absent sources count for nothing. Repeated rows are separate
documents with places next to each other. Texts are not looked at. An empty table gives an empty result.
Input columns called like a result column are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.llm.common import by_value, store

by_value(__name__)

#: Parameters: documents in a block, slots in a period, hash buckets within a source.
BLOCK = 8
PERIOD = 1000
BUCKETS = 512
NEW = ["mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_position"]


def shares(counts: Mapping[str | None, int], weights: Mapping[str | None, float] | None, period: int = PERIOD) -> dict[str | None, int]:
    """Whole slots of each source in a period, by largest remainder; the period grows if there are more sources.

    Without ``weights`` a source weighs the square root of its number of documents.
    """
    names = sorted(counts, key=lambda s: (s is not None, s or ""))
    raw = {s: max(float(weights.get(s, 0) if weights is not None else counts[s] ** 0.5), 0.0) for s in names}
    period = max(period, len(names))
    whole = sum(raw.values())
    free = period - len(names)  # each source has one slot at least
    exact = {s: max(raw[s] / whole * period - 1, 0.0) if whole else free / len(names) for s in names}
    scale = free / sum(exact.values()) if sum(exact.values()) else 0.0
    slots = {s: int(exact[s] * scale) for s in names}
    rest = sorted(names, key=lambda s: slots[s] - exact[s] * scale)
    for s in rest[: free - sum(slots.values())] if scale else names[:free]:
        slots[s] += 1
    return {s: slots[s] + 1 for s in names}


def schedule(slots: Mapping[str | None, int]) -> list[tuple[str | None, int, int]]:
    """One period: ``source, block of the source within the period, slot``, earliest deadline first."""
    period = sum(slots.values())
    names = list(slots)
    coming = sorted((j * period // k, -(-(j + 1) * period // k), i, j) for i, k in enumerate(slots.values()) for j in range(k))
    ready: list[tuple[int, int, int]] = []
    out, at = [], 0
    for slot in range(period):
        while at < len(coming) and coming[at][0] <= slot:
            heapq.heappush(ready, coming[at][1:])
            at += 1
        due, i, j = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a deadline was missed")
        out.append((names[i], j, slot))
    return out


def mixed(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block: int = BLOCK, period: int = PERIOD, buckets: int = BUCKETS) -> DataFrame:
    """The input's columns, each document's block of its source, that block's slot, release and deadline, and the
    document's position (from 0, without gaps) in the mixture."""
    spark = docs.sparkSession
    key = F.xxhash64("_row.doc_id", F.lit(7))
    rows = docs.select(F.struct("*").alias("_row")).select("_row", F.col("_row.source").alias("_source"), key.alias("_key"))
    rows = rows.withColumn("_bucket", F.shiftrightunsigned("_key", 64 - (buckets - 1).bit_length()))
    sizes = store(rows.groupBy("_source", "_bucket").agg(F.count("*").alias("n")), "mix-sizes")
    counts = {r[0]: r[1] for r in sizes.groupBy("_source").agg(F.sum("n")).collect()}  # one row for each source of the mixture
    if not counts:
        counts = {None: 0}
    slots = shares(counts, weights, period)
    total = sum(slots.values())
    plan = spark.createDataFrame(schedule(slots), "_s string, _j long, _u long")
    per = spark.createDataFrame([(s, k, counts[s]) for s, k in slots.items()], "_s string, _k long, _n long")

    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n").toDF("_s", "_b", "_start")
    inside = F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy("_key", "_row.doc_id"))
    placed = (
        rows.withColumn("_place", inside)
        .join(starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).drop("_s", "_b")
        .withColumn("_seq", F.col("_start") + F.col("_place") - 1)
        .join(F.broadcast(per), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
        .withColumn("mix_block", F.expr(f"_seq div {block}"))
        .withColumn("_p", F.expr("mix_block div _k"))
        .withColumn("_i", F.expr("mix_block % _k"))
        .join(F.broadcast(plan), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_i") == F.col("_j"))).drop("_s")
        .withColumns({
            "mix_slot": F.expr(f"_p * {total} + _u"),
            "mix_release": F.expr(f"mix_block * {total} div _k"),
            "mix_deadline": F.expr(f"((mix_block + 1) * {total} + _k - 1) div _k"),
        })
    )
    return _positions(placed, slots, counts, block).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in NEW], *NEW)


def _positions(placed: DataFrame, slots: Mapping, counts: Mapping, block: int) -> DataFrame:
    """``mix_position``: documents of earlier periods (by arithmetic over the sources) and of earlier slots of this one."""
    pairs = F.array(*[F.struct(F.lit(k * block).cast("long").alias("k"), F.lit(counts[s]).cast("long").alias("n")) for s, k in slots.items()])
    earlier: Column = F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + F.least(x["n"], x["k"] * F.col("_p")))
    within = F.row_number().over(Window.partitionBy("_p").orderBy("_u", "_seq")) - 1  # at most a period of blocks
    first = F.when(F.row_number().over(Window.partitionBy("_p").orderBy("_u", "_seq")) == 1, earlier)
    base = F.max(first).over(Window.partitionBy("_p"))
    return placed.repartitionByRange("_p").withColumn("mix_position", base + within)


def interleaved(docs: DataFrame, **options) -> DataFrame:
    """The documents, with the columns they came with, in the order of the mixture: partitions and the rows in each follow it."""
    names = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    out = mixed(docs.select("doc_id", "source", F.struct("*").alias("_row")), **options)
    return out.sortWithinPartitions("mix_position").select(*names)
