"""One scan that tells for every column how its values repeat: exactly for few values, estimated for many.

Cells travel as 64-bit hashes in one array, so the plan has one size for any width. A task keeps for each column the ``HELD``
smallest hashes with their counts. As long as there are no more than that, they are all values and the counts are exact
(two of them share a hash in less than one table in 10**11). Beyond it the kept ones are a bottom-k sketch: how far they reach
into the range of hashes tells how many there are. Both merge by keeping the smallest again, so a value that fills a third
of the table is one entry, and a task sends a bounded number of entries for each column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.session import by_value

by_value(__name__)

HELD = 4096
SHARDS = 64
TALLY = "at int, rows bigint, nulls bigint, more boolean, hashes array<bigint>, counts array<bigint>"


class Tally:
    def __init__(self, rows=0, nulls=0, more=False, hashes=(), counts=()):
        self.rows, self.nulls, self.more = rows, nulls, more
        self.hashes, self.counts = np.array(hashes, np.int64), np.array(counts, np.int64)

    def add(self, rows: int, nulls: int, more: bool, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.rows, self.nulls = self.rows + rows, self.nulls + nulls
        if self.more and len(hashes):
            inside = hashes <= self.hashes[-1]
            hashes, counts = hashes[inside], counts[inside]
        found, back = np.unique(np.concatenate([self.hashes, hashes]), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, back, np.concatenate([self.counts, counts]))
        self.more = self.more or more or len(found) > HELD
        self.hashes, self.counts = found[:HELD], total[:HELD]

    def about(self) -> int:
        """Distinct values: the exact number, or the estimate of the sketch."""
        if not self.more or not len(self.hashes):
            return len(self.hashes)
        reach = (int(self.hashes[-1]) + 2**63 + 1) / 2**64
        return max(len(self.hashes), round((len(self.hashes) - 1) / reach))


def _table(tallies: list[tuple[int, Tally]]) -> pa.Table:
    get = lambda name: [getattr(t, name) for _, t in tallies]
    return pa.table({
        "at": pa.array([at for at, _ in tallies], pa.int32()), "rows": pa.array(get("rows"), pa.int64()), "nulls": pa.array(get("nulls"), pa.int64()),
        "more": pa.array(get("more"), pa.bool_()), "hashes": pa.array(get("hashes"), pa.list_(pa.int64())), "counts": pa.array(get("counts"), pa.list_(pa.int64())),
    })


def _tally(width: int):
    def run(batches):
        tallies = [Tally() for _ in range(width)]
        for batch in batches:
            flat = batch.column(0).flatten()
            there = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, width)
            cells = flat.fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, width)
            for at, tally in enumerate(tallies):
                present = cells[there[:, at], at]
                if tally.more:
                    seen = present[present <= tally.hashes[-1]]
                    tally.add(len(cells), len(cells) - len(present), False, *np.unique(seen, return_counts=True))
                else:
                    tally.add(len(cells), len(cells) - len(present), False, *np.unique(present, return_counts=True))
        yield from _table(list(enumerate(tallies))).to_batches()

    return run


def _merged(table: pa.Table) -> Tally:
    out = Tally()
    for r in table.select(["rows", "nulls", "more", "hashes", "counts"]).to_pylist():
        out.add(r["rows"], r["nulls"], r["more"], np.array(r["hashes"], np.int64), np.array(r["counts"], np.int64))
    return out


def _merge(table: pa.Table) -> pa.Table:
    return _table([(table.column("at")[0].as_py(), _merged(table))])


def _told(table: pa.Table) -> pa.Table:
    t = _merged(table)
    few = not t.more and len(t.counts)
    kinds = {"at": pa.int32(), "rows": pa.int64(), "nulls": pa.int64(), "exact": pa.bool_(), "distinct": pa.int64(), "max_n": pa.int64(), "min_n": pa.int64()}
    row = (table.column("at")[0].as_py(), t.rows, t.nulls, not t.more, t.about(), int(t.counts.max()) if few else None, int(t.counts.min()) if few else None)
    return pa.table({name: pa.array([v], kind) for (name, kind), v in zip(kinds.items(), row)})


def tallies(df: DataFrame, cells: list[Column]) -> DataFrame:
    """``at, rows, nulls, exact, distinct, max_n, min_n`` by position in ``cells``, which hold a 64-bit hash or null.

    Where ``exact`` is false, ``distinct`` is an estimate within a few hundredths, and the frequencies are null.
    """
    by_task = df.select(F.array(*cells).alias("x")).mapInArrow(_tally(len(cells)), TALLY)
    shard = F.pmod(F.spark_partition_id(), F.lit(SHARDS)).alias("shard")
    met = by_task.groupBy("at", shard).applyInArrow(lambda t: _merge(t), TALLY).groupBy("at")
    return met.applyInArrow(lambda t: _told(t), "at int, rows bigint, nulls bigint, exact boolean, distinct bigint, max_n bigint, min_n bigint")
