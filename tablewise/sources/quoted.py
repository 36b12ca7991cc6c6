"""Records of delimited files whose quoted fields hold line breaks, read in splits.

Whether a split starts inside quotes depends on all text before it. But a split needs to be known only as a function of the two
states it may start in (outside or inside quotes), and such functions compose: one scan gives the function of every
split, a running composition over these few rows gives the state that each split really starts in, and a second scan cuts
each split into records on its own. What crosses a border between splits is at most one unfinished record at either end; only
these fragments are put together by a shuffle. Nothing but a single record is ever held whole.

A quote opens a field only where the field starts, as the CSV reader has it, so ``5" pipe`` opens nothing. A field that is never
closed goes on to the end of its file, less a last line break. Line breaks in quotes stay as they are written.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewise.session import by_value, materialise

by_value(__name__)

#: Splits up to which their states are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_SPLITS = 100_000
WHOLE, HEAD, TAIL = 0, 1, 2


def ends_inside(line: str, inside: bool, sep: str, quote: str) -> bool:
    """Whether the text after ``line`` is inside quotes."""
    at, opening = 0, sep + quote
    if not inside and line.startswith(quote):
        at, inside = len(quote), True
    while True:
        if inside:
            at = line.find(quote, at)
            if at < 0:
                return True
            at += len(quote)
            inside = line.startswith(quote, at)
            at += len(quote) if inside else 0
        else:
            at = line.find(opening, at)
            if at < 0:
                return False
            at, inside = at + len(opening), True


def _groups(batch: pa.RecordBatch):
    """(file, block, start, stop) of the runs of rows of one split."""
    file, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    new = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
    for start, stop in zip([0, *new], [*new, len(file)]):
        if stop > start:
            yield int(file[start]), int(block[start]), int(start), int(stop)


def _functions(batches, sep: str, quote: str):
    """(file, block, from_outside, from_inside, broken) of each split; gets the lines with quotes only."""
    states: dict[tuple[int, int], list[bool]] = {}
    for batch in batches:
        lines = batch.column(2).to_pylist()
        for file, block, start, stop in _groups(batch):
            state = states.setdefault((file, block), [False, True, False])
            for line in lines[start:stop]:
                alone = ends_inside(line, False, sep, quote)
                other = ends_inside(line, True, sep, quote) if state[0] or state[1] else alone
                state[0], state[1] = other if state[0] else alone, other if state[1] else alone
                state[2] |= alone
    rows = [(*k, *v) for k, v in states.items()]
    names = {"file": pa.int64(), "block": pa.int64(), "from_outside": pa.bool_(), "from_inside": pa.bool_(), "broken": pa.bool_()}
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(names.values())], list(names))


def _records(batches, sep: str, quote: str):
    """(file, block, at, kind, value): records, and the fragments at the borders of splits."""
    now, inside, kind, at, held = None, False, WHOLE, 0, []
    out: list[tuple] = []

    def table():
        names = {"file": pa.int64(), "block": pa.int64(), "at": pa.int64(), "kind": pa.int32(), "value": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(names.values())], list(names))

    def close():  # the split ends within a record: its first part, or all of the split
        if held:
            out.append((*now, at - len(held), HEAD if kind == HEAD else TAIL, "\n".join(held)))
            held.clear()

    for batch in batches:
        lines, starts = batch.column(2).to_pylist(), batch.column(3)
        for file, block, start, stop in _groups(batch):
            if now != (file, block):
                close()
                now, at, inside = (file, block), 0, starts[start].as_py()
                kind = HEAD if inside else WHOLE
            for line in lines[start:stop]:
                at += 1
                if quote in line:
                    inside = ends_inside(line, inside, sep, quote)
                if inside:
                    held.append(line)
                elif held or kind == HEAD:
                    held.append(line)
                    out.append((*now, at - len(held), kind, "\n".join(held)))
                    held.clear()
                    kind = WHOLE
                else:
                    out.append((*now, at - 1, WHOLE, line))
        yield table()
        out.clear()
    close()
    yield table()


def lines(spark: SparkSession, path: str | list[str], charset: str) -> DataFrame:
    """(file, block, value): lines of all files with the split that they start in, in order within each task."""
    text = spark.read.option("lineSep", "\n").text(path)
    value = F.col("value") if charset == "UTF-8" else F.decode(F.col("value").cast("binary"), charset)
    return text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), value.alias("value"))


def functions(spark: SparkSession, path: str | list[str], sep: str, quote: str, charset: str = "UTF-8") -> DataFrame:
    """What each split makes of the state that it starts in; ``broken`` where a record goes on in the next line."""
    quoted = lines(spark, path, charset).where(F.col("value").contains(quote))
    schema = "file bigint, block bigint, from_outside boolean, from_inside boolean, broken boolean"
    return materialise(quoted.mapInArrow(partial(_functions, sep=sep, quote=quote), schema))


def start_states(splits: DataFrame) -> DataFrame:
    """(file, block, inside) of the splits, from a running composition of their functions.

    A split sets the state, keeps it or swaps it. The state is thus the last one set, swapped as often as came after; a file starts outside.
    """
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sets = F.when(F.col("from_outside") == F.col("from_inside"), F.col("from_outside"))
    swaps = (F.col("from_outside") & ~F.col("from_inside")).cast("int")
    upto = splits.withColumn("set", sets).withColumn("swaps", F.sum(swaps).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(F.col("set").isNotNull(), F.struct("set", "swaps")), ignorenulls=True).over(before)
    known = upto.withColumn("last", last).withColumn("swapped", F.coalesce(F.lag("swaps").over(order), F.lit(0)))
    since = F.col("swapped") - F.coalesce("last.swaps", F.lit(0))
    return known.select("file", "block", (F.coalesce("last.set", F.lit(False)) != (since % 2 == 1)).alias("inside"))


def records(spark: SparkSession, path: str | list[str], splits: DataFrame, sep: str, quote: str, charset: str = "UTF-8") -> DataFrame:
    """(path, line, value): every record of the files; ``line`` orders the records of a file, which ``path`` names by a hash.

    ``splits`` comes from :func:`functions`. Splits without quotes are not in it and start as the next one before them ends.
    """
    found = lines(spark, path, charset)
    every = found.select("file", "block").distinct().join(splits, ["file", "block"], "left")
    every = every.withColumns({"from_outside": F.coalesce("from_outside", F.lit(False)), "from_inside": F.coalesce("from_inside", F.lit(True))})
    starts = materialise(start_states(every))
    if starts.count() <= BROADCAST_SPLITS:
        placed = found.join(F.broadcast(starts), ["file", "block"])
    else:
        numbered = found.withColumn("row", F.monotonically_increasing_id()).join(starts, ["file", "block"])
        placed = numbered.repartition("file", "block").sortWithinPartitions("file", "block", "row")
    cut = placed.select("file", "block", "value", "inside").mapInArrow(
        partial(_records, sep=sep, quote=quote), "file bigint, block bigint, at bigint, kind int, value string"
    )
    place = F.struct("block", "at").alias("line")
    alone = cut.where(F.col("kind") == WHOLE).select(F.col("file").alias("path"), place, "value")
    # At most two fragments of a split; a record starts with the last tail before it.
    order = Window.partitionBy("file").orderBy("block", "at")
    parts = cut.where(F.col("kind") != WHOLE).withColumn("record", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    whole = parts.groupBy("file", "record").agg(F.min(place).alias("line"), F.sort_array(F.collect_list(F.struct("block", "at", "value"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    return alone.union(whole.select(F.col("file").alias("path"), "line", joined.alias("value")))
