"""Hard-negative mining: exact inner-product search with coordinate pruning in length buckets.

Rows are integer vectors (each component ``floor(256 * x)``). Vectors of about one length form a class, and a class is dealt into
tiles of bounded size. An anchor visits a tile only if the product of the lengths can reach the score that it needs. In a
tile, rows lie in buckets by falling length, and each bucket holds the coordinates of its unit vectors as sorted lists. For
the ``FOCUS`` largest coordinates of the anchor, the score that it needs gives the range that the coordinate of a partner must lie in
(two unit vectors at an angle of at most d differ by at most d in their angle to any axis). The ranges are found by bisection
in the sorted lists, the shortest list is intersected with the other ranges, and what remains is verified by its
exact integer score. The score needed rises with what an anchor has found, from a start that a sample gives.

Two searches of that kind follow each other: positives (first 5 rows of the anchor's label) and, for each of them, negatives
(first 10 rows of other labels whose score lies in a window below the positive's). A search asks for the best rows in each of
an anchor's windows ``(low, high)``; tiles return at most that many rows for a window, which are ranked once more.

The sample has at most ``sample`` rows (a parameter; those with the smallest hashes) and goes to the driver; it sets first bounds
only, so results are exact whatever it holds. Neither anchors nor rows are broadcast or collected: both are dealt out to
tiles of bounded size, so a label or a length that a third of all rows have is many tasks.

Defined cases: rows without an id or label, without a vector, or with null or non-finite components take no part, nor do
vectors whose integer length is 2**30 or more (their scores would leave 64 bits). Vectors of different lengths have no score.
Rows that repeat an id are one row, the least by label and vector. Equal scores go by ``vec_id``. Zero and empty vectors score 0 with
everything. An empty table, or one without anchors, gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewise.llm.common import by_value, store

by_value(__name__)

POSITIVES = 5
NEGATIVES = 10
#: Share of the positive's score that a negative's must lie in, in tenths.
LEAST_TENTHS, MOST_TENTHS = 3, 9
SAMPLE = 4096
#: Components of the rows of a tile (4 MB as doubles), and anchors that meet in a tile.
TILE_VALUES = 1 << 19
TILE_ANCHORS = 512
#: Rows of a bucket of a tile, and coordinates by which an anchor prunes it.
BUCKET = 1024
FOCUS = 4
#: Ratio of the lengths in a class.
RATIO = 1.1
#: Room for rounding in bounds on cosines and coordinates; scores themselves are exact.
ROOM = 1e-9
LONGEST = float(1 << 30)
LOWEST, HIGHEST = -(1 << 62), 1 << 62
HIT = "anchor_id bigint, slot int, vec_id bigint, score bigint"


def whole(column: pa.Array) -> list[np.ndarray]:
    """The integer vectors of a list column as 64-bit rows."""
    flat = np.floor(256.0 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


class Bucket:
    """Rows of falling length with sorted lists of the coordinates of their unit vectors."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, lengths: np.ndarray):
        self.x, self.ids, self.labels = x.astype(np.float64), ids, labels
        self.exact = x
        self.longest, self.shortest = float(lengths.max()), float(lengths.min())
        if self.shortest > 0:
            self.unit = self.x / lengths[:, None]
            self.order = self.unit.argsort(axis=0, kind="stable")
            self.sorted = np.take_along_axis(self.unit, self.order, axis=0)

    def candidates(self, q: np.ndarray, length: float, need: int) -> np.ndarray:
        """Positions of the rows that may score ``need`` or more with ``q``."""
        rows = len(self.ids)
        if not length * self.longest:
            return np.arange(rows if need <= 0 else 0)
        least = need / (length * (self.longest if need >= 0 else self.shortest or math.inf)) - ROOM
        if least > 1:
            return np.arange(0)
        if least <= -1 or not self.shortest:
            return np.arange(rows)
        direction = q / length
        focus = np.argsort(-np.abs(direction))[:FOCUS]
        angle, away = np.arccos(np.clip(direction[focus], -1, 1)), math.acos(least)
        low = np.cos(np.minimum(np.pi, angle + away)) - ROOM
        high = np.cos(np.maximum(0, angle - away)) + ROOM
        spans = [(np.searchsorted(self.sorted[:, f], a, "left"), np.searchsorted(self.sorted[:, f], b, "right")) for f, a, b in zip(focus, low, high)]
        best = min(range(len(focus)), key=lambda i: spans[i][1] - spans[i][0])
        found = self.order[slice(*spans[best]), focus[best]]
        for i, f in enumerate(focus):
            if i != best and spans[i][1] - spans[i][0] < rows:
                value = self.unit[found, f]
                found = found[(value >= low[i]) & (value <= high[i])]
        return found

    def scores(self, q: np.ndarray, length: float, at: np.ndarray) -> np.ndarray:
        if length * self.longest < 2.0**52:  # every partial sum is an integer that a double holds
            dots = (self.x @ q)[at] if 2 * len(at) > len(self.ids) else self.x[at] @ q
            return dots.astype(np.int64)
        return self.exact[at] @ q.astype(np.int64)


def buckets(x: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> list[Bucket]:
    lengths = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    order = np.lexsort((ids, -lengths))
    parts = [order[at : at + BUCKET] for at in range(0, len(order), BUCKET)]
    return [Bucket(x[p], ids[p], labels[p], lengths[p]) for p in parts]


def search(tile: list[Bucket], own: int, label: int, q: np.ndarray, lows, highs, k: int, same: bool):
    """For each window of an anchor, the ids and scores of its first ``k`` rows in the tile, best first."""
    q = q.astype(np.float64)
    length = float(np.sqrt((q**2).sum()))
    lows = list(lows)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in lows]
    for bucket in tile:
        at = bucket.candidates(q, length, min(lows))
        at = at[((bucket.labels[at] == label) == same) & (bucket.ids[at] != own)]
        if not len(at):
            continue
        scores, ids = bucket.scores(q, length, at), bucket.ids[at]
        for i, high in enumerate(highs):
            fits = (scores >= lows[i]) & (scores <= high)
            if fits.any():
                s, v = np.concatenate([found[i][1], scores[fits]]), np.concatenate([found[i][0], ids[fits]])
                first = np.lexsort((v, -s))[:k]
                found[i] = v[first], s[first]
                if len(first) == k:
                    lows[i] = int(s[first[-1]])
    return found


def _columns(table: pa.Table):
    table = table.combine_chunks()
    get = lambda name: table.column(name).combine_chunks()
    return get("vec_id").to_numpy(), get("label").to_numpy(), whole(get("embedding")), get("low"), get("high")


def _in_tile(k: int, same: bool):
    """The first rows of each anchor's windows in one tile."""

    def run(table: pa.Table) -> pa.Table:
        anchor = table.column("anchor")
        ids, labels, x, _, _ = _columns(table.filter(pc.invert(anchor)))
        a_ids, a_labels, a, low, high = _columns(table.filter(anchor))
        out: list[tuple] = []
        if len(ids):
            tile = buckets(x, ids, labels)
            for own, label, q, lows, highs in zip(a_ids.tolist(), a_labels, a, low.to_pylist(), high.to_pylist()):
                for slot, (v, s) in enumerate(search(tile, own, label, q, lows, highs, k, same)):
                    out += [(own, slot, i, n) for i, n in zip(v.tolist(), s.tolist())]
        kinds = {"anchor_id": pa.int64(), "slot": pa.int32(), "vec_id": pa.int64(), "score": pa.int64()}
        return pa.table({name: pa.array([r[i] for r in out], kind) for i, (name, kind) in enumerate(kinds.items())})

    return run


def _raised(sample: dict, k: int, same: bool):
    """Anchors with the lows that the sample's rows let them start from."""
    tiles = {size: buckets(*rows) for size, rows in sample.items()}

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels, size = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("vec_id", "label", "size"))
            place = batch.schema.get_field_index("low")
            lows, highs = batch.column(place).to_pylist(), batch.column(batch.schema.get_field_index("high")).to_pylist()
            vectors = batch.column(batch.schema.get_field_index("embedding"))
            for i in range(len(ids)):
                tile = tiles.get(int(size[i]))
                if tile:
                    q = whole(vectors.slice(i, 1))[0]
                    found = search(tile, int(ids[i]), labels[i], q, lows[i], highs[i], k, same)
                    lows[i] = [int(s[-1]) if len(s) == k else low for low, (_, s) in zip(lows[i], found)]
            yield batch.set_column(place, "low", pa.array(lows, pa.list_(pa.int64())))

    return run


def usable(rows: DataFrame, label: Column) -> DataFrame:
    """``vec_id, label, embedding, size, length, class`` of the rows that take part, each id once."""
    e = F.col("embedding")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    taken = rows.where(F.col("vec_id").isNotNull() & e.isNotNull() & F.forall(e, finite))
    taken = taken.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), e.cast("array<double>").alias("embedding"))
    one = taken.where("label IS NOT NULL").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.*")
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * 256.0), 2))
    sized = one.withColumn("size", F.size("embedding")).withColumn("length", F.sqrt(square)).where(F.col("length") < LONGEST)
    return sized.withColumn("class", F.when(F.col("length") > 0, F.floor(F.log(F.col("length")) / math.log(RATIO))).otherwise(-1).cast("int"))


def best(rows: DataFrame, anchors: DataFrame, k: int, same: bool, sample: dict, tile_values: int = TILE_VALUES, tile_anchors: int = TILE_ANCHORS) -> DataFrame:
    """``anchor_id, slot, vec_id, score, rank``: the first ``k`` ``rows`` of the same (or another) label in each window of each anchor.

    ``anchors`` has the columns of ``rows`` and the windows as arrays ``low`` and ``high``.
    """
    group = F.col("label") if same else F.lit(0).cast("long")  # positives lie among the rows of the anchor's label
    raised = anchors.mapInArrow(_raised(sample, k, same), anchors.schema).withColumn("g", group)
    rows = rows.withColumn("g", group)
    classes = rows.groupBy("g", "size", "class").agg(
        F.ceil(F.count("*") * F.greatest("size", F.lit(1)) / tile_values).cast("int").alias("tiles"), F.max("length").alias("longest"))
    sides = anchors.withColumn("g", group).groupBy("g", "size").agg(F.ceil(F.count("*") / tile_anchors).cast("int").alias("sides"))
    grid = classes.join(sides, ["g", "size"])
    hashed = F.xxhash64("vec_id", F.lit(7))
    names = ["g", "size", "class", "tile", "side", "anchor", "vec_id", "label", "embedding", "low", "high"]
    none = F.lit(None).cast("array<bigint>")
    members = rows.join(grid, ["g", "size", "class"]).withColumn("tile", F.pmod(hashed, "tiles").cast("int"))
    members = members.withColumn("side", F.explode(F.sequence(F.lit(0), F.col("sides") - 1))).select(
        *names[:5], F.lit(False).alias("anchor"), "vec_id", "label", "embedding", none.alias("low"), none.alias("high"))
    # The join meets classes, of which a length has few, not rows; classes that cannot reach the score are not visited.
    reach = F.array_min("low") <= F.col("length") * F.col("longest") * (1 + ROOM)
    visits = raised.drop("class").join(grid, ["g", "size"]).where(reach).withColumn("side", F.pmod(hashed, "sides").cast("int"))
    visits = visits.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        *names[:5], F.lit(True).alias("anchor"), "vec_id", "label", "embedding", "low", "high")
    run = _in_tile(k, same)
    found = members.union(visits).groupBy(*names[:5]).applyInArrow(lambda t: run(t), HIT)
    place = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def mined(
    rows: DataFrame, *, anchor: Column | None = None, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, sample: int = SAMPLE, **tiles
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; ``anchor`` tells which rows are anchors."""
    anchor = F.col("vec_id") % 100 == 0 if anchor is None else anchor
    rows = store(usable(rows, F.col("label") if label is None else label), "vectors")
    by_size: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect():
        by_size.setdefault(r["size"], []).append(r)
    drawn = {
        n: (whole(pa.array([r["embedding"] for r in rs], pa.list_(pa.float64()))), np.array([r["vec_id"] for r in rs]), np.array([r["label"] for r in rs]))
        for n, rs in by_size.items()
    }
    asked = rows.where(anchor)
    window = lambda x: F.array(F.lit(x).cast("long"))
    first = best(rows, asked.withColumn("low", window(LOWEST)).withColumn("high", window(HIGHEST)), positives, True, drawn, **tiles)
    first = store(first.select("anchor_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    pairs = first.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("p"))  # ``positives`` at most
    # 3 p <= 10 s <= 9 p in whole numbers: a division would go through doubles.
    tenth = lambda x: F.call_function("div", x - F.pmod(x, F.lit(10)), F.lit(10))
    lows = F.transform("p", lambda r: tenth(r["positive_score"] * LEAST_TENTHS + 9))
    highs = F.transform("p", lambda r: tenth(r["positive_score"] * MOST_TENTHS))
    asked = asked.join(pairs.withColumnRenamed("anchor_id", "vec_id"), "vec_id").withColumn("low", lows).withColumn("high", highs).drop("p")
    then = best(rows, asked, negatives, False, drawn, **tiles).withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score")
    out = then.withColumn("place", F.col("slot") + 1).join(first, ["anchor_id", "place"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
