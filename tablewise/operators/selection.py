"""Exact quantiles of many columns at once: bracket every quantile by mergeable summaries, then select inside the brackets.

The cells of all columns travel as one array, so the plan has the same size for ten columns and for a thousand. Each task
summarises a column by at most ``POINTS`` values with weights; summaries of batches are merged a few dozen at a time, so
a cell passes few of these steps, and each summary knows by how many ranks it may err. Tasks merge in two
rounds. From a summary without error (a column of few values) the quantile is read off. For the others a second scan counts the
cells below each bracket and those inside it by value: counters and counts that add up, however the table is cut. Only the counted
values inside the brackets, about one cell in a thousand, are put in order.

Doubles are compared as whole numbers of the same order, with -0.0 as 0.0 and NaN above everything, as Spark sorts them.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.operators.ordered import running
from tablewise.session import by_value, materialise

by_value(__name__)

#: Weighted values of one summary, and summaries that are merged at once.
POINTS = 4096
FAN_IN = 32
#: Groups in which the summaries of tasks meet before the last merge.
SHARDS = 64
#: Counted values that a task holds for one bracket before it counts them again.
HELD = 1 << 16
SUMMARY = "at int, n bigint, error double, points array<bigint>, weights array<double>"


def keys(x: np.ndarray) -> np.ndarray:
    """64-bit whole numbers in the order of the doubles."""
    x = np.where(np.isnan(x), np.nan, x + 0.0)
    bits = np.ascontiguousarray(x, np.float64).view(np.int64)
    return bits ^ ((bits >> np.int64(63)) & np.int64(0x7FFFFFFFFFFFFFFF))


def value(key: int) -> float:
    bits = np.array([key], np.int64)
    return float((bits ^ ((bits >> np.int64(63)) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)[0])


class Summary:
    """Sorted points with weights; the weight of the points up to a value is its rank, give or take ``error``."""

    def __init__(self, points: np.ndarray, weights: np.ndarray, n: int, error: float):
        self.points, self.weights, self.n, self.error = points, weights, n, error

    @classmethod
    def of(cls, values: np.ndarray) -> Summary:
        return cls(np.sort(values), np.ones(len(values)), len(values), 0.0).reduced()

    @classmethod
    def merged(cls, parts: list[Summary]) -> Summary:
        points, weights = (np.concatenate([getattr(p, a) for p in parts]) for a in ("points", "weights"))
        order = points.argsort(kind="stable")
        return cls(points[order], weights[order], sum(p.n for p in parts), sum(p.error for p in parts)).reduced()

    def reduced(self) -> Summary:
        if len(self.points) <= POINTS:
            return self
        upto = np.cumsum(self.weights)
        step = upto[-1] / POINTS
        chosen = np.searchsorted(upto, (np.arange(POINTS) + 0.5) * step)
        return Summary(self.points[np.minimum(chosen, len(upto) - 1)], np.full(POINTS, step), self.n, self.error + step)

    def bracket(self, p: float) -> tuple[int, int]:
        """Points around the order statistics that the quantile lies between; equal ones are the quantile."""
        at = p * (self.n - 1)
        first, second = math.floor(at), math.ceil(at)
        upto = np.cumsum(self.weights)
        if not self.error:
            places = np.searchsorted(upto, [first + 1, second + 1])
            return tuple(int(k) for k in self.points[np.minimum(places, len(upto) - 1)])
        room = self.error + 1
        low = np.searchsorted(upto, first - room, "right") - 1
        high = np.searchsorted(upto, second + 1 + room)
        least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max  # beyond every double
        return (int(self.points[low]) if low >= 0 else least, int(self.points[high]) if high < len(upto) else most)


class Gathered:
    """A summary of values that come in batches, merged ``FAN_IN`` at a time."""

    def __init__(self):
        self.levels: list[list[Summary]] = [[]]

    def add(self, summary: Summary, level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(summary)
        if len(self.levels[level]) == FAN_IN:
            full, self.levels[level] = self.levels[level], []
            self.add(Summary.merged(full), level + 1)

    def all(self) -> Summary | None:
        parts = [s for level in self.levels for s in level]
        return Summary.merged(parts) if parts else None


def _table(rows: list[tuple[int, Summary]]) -> pa.Table:
    return pa.table({
        "at": pa.array([at for at, _ in rows], pa.int32()),
        "n": pa.array([s.n for _, s in rows], pa.int64()),
        "error": pa.array([s.error for _, s in rows], pa.float64()),
        "points": pa.array([s.points for _, s in rows], pa.list_(pa.int64())),
        "weights": pa.array([s.weights for _, s in rows], pa.list_(pa.float64())),
    })


def _columns(batch: pa.RecordBatch, width: int):
    """The present cells of each column of a batch as keys."""
    flat = batch.column(0).flatten()
    there = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, width)
    cells = keys(flat.fill_null(0.0).to_numpy(zero_copy_only=False)).reshape(-1, width)
    for at in range(width):
        yield at, cells[there[:, at], at]


def _summaries(width: int):
    def run(batches):
        gathered = [Gathered() for _ in range(width)]
        for batch in batches:
            for at, cells in _columns(batch, width):
                if len(cells):
                    gathered[at].add(Summary.of(cells))
        found = [(at, s) for at, g in enumerate(gathered) if (s := g.all())]
        yield from _table(found).to_batches()

    return run


def _read(table: pa.Table) -> list[Summary]:
    columns = [table.column(c).to_pylist() for c in ("points", "weights", "n", "error")]
    return [Summary(np.array(p, np.int64), np.array(w, np.float64), n, e) for p, w, n, e in zip(*columns)]


def _merge(table: pa.Table) -> pa.Table:
    return _table([(table.column("at")[0].as_py(), Summary.merged(_read(table)))])


def _brackets(probabilities: Mapping[str, float]):
    def run(table: pa.Table) -> pa.Table:
        whole = Summary.merged(_read(table))
        at = table.column("at")[0].as_py()
        rows = [(at, whole.n, whole.error == 0, q, *whole.bracket(p)) for q, p in probabilities.items()]
        kinds = {"at": pa.int32(), "n": pa.int64(), "exact": pa.bool_(), "q": pa.string(), "low": pa.int64(), "high": pa.int64()}
        return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds.items())})

    return run


def _members(width: int, brackets: dict[int, list[tuple[str, int, int]]]):
    """Rows (at, q, key, n): cells inside each bracket by value, and without a key those below it."""

    def run(batches):
        below: dict[tuple[int, str], int] = {}
        inside: dict[tuple[int, str], list] = {}

        def counted(parts):
            found, n = (np.concatenate(x) for x in zip(*parts))
            found, back = np.unique(found, return_inverse=True)
            return found, np.bincount(back, n).astype(np.int64)

        for batch in batches:
            for at, cells in _columns(batch, width):
                for q, low, high in brackets.get(at, ()):
                    under = cells < low
                    below[at, q] = below.get((at, q), 0) + int(under.sum())
                    near = cells[~under & (cells <= high)]
                    if len(near):
                        parts = inside.setdefault((at, q), [])
                        parts.append(np.unique(near, return_counts=True))
                        if sum(len(p[0]) for p in parts) > HELD:
                            parts[:] = [counted(parts)]
        for (at, q), parts in inside.items():
            found, n = counted(parts)
            for start in range(0, len(found), HELD):
                some = slice(start, start + HELD)
                size = len(found[some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, at, np.int32)), pa.array([q] * size), pa.array(found[some]), pa.array(n[some])], ["at", "q", "key", "n"]
                )
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in below], pa.int32()), pa.array([k[1] for k in below], pa.string()), pa.nulls(len(below), pa.int64()), pa.array(list(below.values()), pa.int64())],
            ["at", "q", "key", "n"],
        )

    return run


def quantiles(df: DataFrame, values: Mapping[str, Column], probabilities: Mapping[str, float], *, bound: int | None = None) -> DataFrame:
    """Exact, linearly interpolated quantiles of each of ``values``: one row (column, quantiles)."""
    names, width = list(values), len(values)
    cells = df.select(F.array(*[x.cast("double") for x in values.values()]).alias("x"))
    by_task = cells.mapInArrow(_summaries(width), SUMMARY)
    sharded = by_task.groupBy("at", F.pmod(F.spark_partition_id(), F.lit(SHARDS)).alias("shard"))
    met = sharded.applyInArrow(lambda t: _merge(t), SUMMARY).groupBy("at")
    schema = "at int, n bigint, exact boolean, q string, low bigint, high bigint"
    sides = met.applyInArrow(_brackets(probabilities), schema).collect()  # one row for each column and quantile

    def part(n: int, p: float) -> float:
        return p * (n - 1) - math.floor(p * (n - 1))

    found: dict[tuple[int, str], float] = {}
    brackets: dict[int, list[tuple[str, int, int]]] = {}
    for r in sides:
        if r["exact"] or r["low"] == r["high"]:
            low, high = value(r["low"]), value(r["high"])
            found[r["at"], r["q"]] = low if low == high else low + part(r["n"], probabilities[r["q"]]) * (high - low)
        else:
            brackets.setdefault(r["at"], []).append((r["q"], r["low"], r["high"]))
    if brackets:
        members = cells.mapInArrow(_members(width, brackets), "at int, q string, key bigint, n bigint")
        counted = materialise(members.groupBy("at", "q", "key").agg(F.sum("n").alias("n")))
        below = {(r["at"], r["q"]): r["n"] for r in counted.where("key IS NULL").collect()}
        size = {r["at"]: r["n"] for r in sides}
        places = []
        for at, q in below:
            place = probabilities[q] * (size[at] - 1)
            places.append((at, q, math.floor(place) - below[at, q], math.ceil(place) - below[at, q]))
        wanted = df.sparkSession.createDataFrame(places, "at int, q string, first long, second long")
        ordered = running(counted.where("key IS NOT NULL"), ["at", "q"], ["key"], sums={"upto": F.col("n")}, bound=bound)
        matched = ordered.join(F.broadcast(wanted), ["at", "q"])  # one row for each quantile
        holds = lambda place: (F.col("upto") - F.col("n") <= F.col(place)) & (F.col(place) < F.col("upto"))
        picked = matched.groupBy("at", "q").agg(*[F.max(F.when(holds(place), F.col("key"))).alias(place) for place in ("first", "second")])
        for r in picked.collect():
            low, high = value(r["first"]), value(r["second"])
            found[r["at"], r["q"]] = low if low == high else low + part(size[r["at"]], probabilities[r["q"]]) * (high - low)
    rows = [(c, *[found.get((i, q)) for q in probabilities]) for i, c in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "column string" + "".join(f", `{q}` double" for q in probabilities))
