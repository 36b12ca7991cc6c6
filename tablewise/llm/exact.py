"""Exact duplicates by progressive refinement: length, then a hash of the beginning, then a hash of the whole text.

Texts are equal when identical after lower-casing A-Z only; null counts as empty. Three scans, each of which reads more of
fewer texts:

1. Lengths in bytes are counted. Lower-casing A-Z does not change them, so a length that occurs once is a unique text.
2. Where the length repeats, the first ``prefix`` characters are hashed, and (length, prefix) pairs are counted.
3. Where the pair repeats, the whole text is read and hashed with SHA-256; equal lengths and digests make a group.

What repeats in one step is told to the next scan as bits: each key owns one of ``slots`` bits, and the words that hold a
set bit are broadcast. ``slots`` is a parameter, so the broadcast has at most ``slots / 64`` rows however large the corpus; a
bit that another key set costs one hash too many and never changes a result. Only ids, lengths and hashes are stored and
shuffled, never texts, and counts are combined map-side, so a text that fills a third of the table is one row of each count.
The group of each document comes by a join on its digest, whose hot side adaptive execution splits.

Defined cases: of equal texts, the row with the largest ``doc_id`` stays. Rows that repeat both id and text are one document:
each is returned by ``groups``, with the same values; ``deduplicated`` keeps one. Rows without an id count in ``group_size`` and stay only where no row of their
group has an id. An empty table gives an empty result; other columns of the table may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import store

PREFIX = 64
SLOTS = 1 << 22


def normal(text: Column) -> Column:
    """The text with A-Z in lower case; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)


def _repeated(keys: DataFrame, slots: int) -> DataFrame:
    """``word, bits``: the bits of the slots of those rows of ``keys`` that occur more than once."""
    counts = keys.groupBy(*keys.columns).agg(F.count("*").alias("times")).where("times > 1")
    slot = F.pmod(F.xxhash64(*keys.columns), F.lit(slots))
    marks = counts.select((slot / 64).cast("long").alias("word"), F.expr("1L").alias("one"), (slot % 64).cast("int").alias("at"))
    return marks.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, at)")).alias("bits"))


def _where_set(rows: DataFrame, keys: Sequence[str], words: DataFrame, slots: int, mark: str) -> DataFrame:
    """``rows`` with a column ``mark``: whether the bit of the row's keys is set."""
    slot = F.pmod(F.xxhash64(*keys), F.lit(slots))
    rows = rows.withColumn("slot", slot).withColumn("word", (F.col("slot") / 64).cast("long"))
    found = rows.join(F.broadcast(words), "word", "left")  # at most ``slots / 64`` rows
    test = F.expr("coalesce(getbit(bits, cast(slot % 64 as int)), 0) = 1")
    return found.withColumn(mark, test).drop("word", "slot", "bits")


def _found(docs: DataFrame, prefix: int, slots: int, also: Sequence[Column]) -> DataFrame:
    """``doc_id, also, length, digest`` of every row and, where its text repeats, ``most`` and ``size`` of the group."""
    carried = F.struct(F.lit(0).alias("none"), *also).alias("also")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).alias("length"), carried)
    start = F.xxhash64(normal(F.substring("text", 1, prefix)))

    lengths = _repeated(rows.select("length"), slots)
    long_enough = lambda table: _where_set(table, ["length"], lengths, slots, "same_length")
    begun = long_enough(rows.select("text", "length")).where("same_length").select("length", start.alias("start"))
    starts = _repeated(begun, slots)

    marked = long_enough(rows).withColumn("start", F.when(F.col("same_length"), start))
    marked = _where_set(marked, ["length", "start"], starts, slots, "same_start")
    digest = F.when(F.col("same_length") & F.col("same_start"), F.unhex(F.sha2(normal(F.col("text")), 256)))
    read = store(marked.select("doc_id", "also", "length", digest.alias("digest")), "digests")
    sizes = read.where("digest IS NOT NULL").groupBy("length", "digest").agg(F.max("doc_id").alias("most"), F.count("*").alias("size"))
    sizes = store(sizes.where("size > 1"), "groups")  # a join of two plain shuffles, whose hot side can be split
    return read.join(sizes, ["length", "digest"], "left")


def groups(docs: DataFrame, *, prefix: int = PREFIX, slots: int = SLOTS, also: Sequence[Column] = ()) -> DataFrame:
    """``doc_id, keep_id, group_size, kept`` of every row, and the columns ``also``, computed in the scan from those of ``docs``."""
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("most"))
    return _found(docs, prefix, slots, also).select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "also.*",
    ).drop("none")


def deduplicated(docs: DataFrame, *, prefix: int = PREFIX, slots: int = SLOTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; here the rows travel with their texts."""
    found = _found(docs, prefix, slots, [F.struct(*[docs[c] for c in docs.columns]).alias("row")])
    alone = found.where("size IS NULL")
    best = found.where("size > 1 AND doc_id <=> most").dropDuplicates(["length", "digest"])
    return alone.union(best).select("also.row.*")
