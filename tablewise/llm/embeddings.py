"""Embedding near-duplicates with an inverted multi-index.

Unit vectors are cut in two halves, each with a codebook of its own; the product of the codebooks is a grid of
cells, and every vector lies in the cell of its nearest centroids. A vector visits cells in the order of
a multi-sequence: rising sum, over the halves, of the squared distance to the plane halfway between the nearest
centroid and the cell's. It stops at a sum that is set from a target recall: the sample's linked pairs, and
pairs made at exactly the least cosine by moving sample vectors in random directions, must be met that
often. Candidates are verified by cosine in double precision, so no link is wrong.

A pair may be met from both sides or from one. Members carry their distances to all cells, so the task that finds a pair
knows whether the other side finds it too, and counts it for that side where it does not: every pair that is found is
counted once on either side.

The codebooks and the stop are fitted on the driver from at most ``sample`` vectors (a parameter; those with the smallest
hashes), for each length of vectors by itself; all vectors are indexed and all are queries. The grid grows with the number
of vectors, about ``CELL`` to a cell, so that a visit stays as dear as it was. A length that the sample holds too few of is one
cell. Cells are dealt out to tasks by tiles of ``tile`` members and ``tile`` visitors, so a cell with a third of all vectors is
many tasks; a tile gives each visitor its number of links and the smallest member of its component within the tile, never pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and are rows of the
result. Vectors of different lengths do not link. Equal vectors link. Rows without ``vec_id`` link with nothing; repeated rows with
one id count as one vector. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.llm.common import by_value, store
from tablewise.llm.components import components

by_value(__name__)

LEAST = 0.95
SAMPLE = 8192
#: Vectors to a cell, on average, and centroids of a half.
CELL = 200
LEAST_CENTROIDS, MOST_CENTROIDS = 4, 512
#: Vectors of one length in the sample from which on that length has codebooks.
FITTED = 64
TILE = 2048
ROUNDS = 8
#: Share of pairs that the visits must meet.
RECALL = 0.9995


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length (a list column without nulls) as double rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(1), 0)


def codebook(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Lloyd's centroids; an empty one keeps its place."""
    x = np.unique(x, axis=0)
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = distances(x, c).argmin(1)
        count = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c)
    return np.unique(c, axis=0)


def bounds(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own cell of each row, and the squared distance to the plane that parts it from each other cell."""
    d = distances(x, centroids)
    own = d.argmin(1)
    apart = np.sqrt(distances(centroids, centroids))[own]
    gap = (d - d[np.arange(len(x)), own][:, None]) / np.where(apart > 0, 2 * apart, np.inf)
    return own, np.maximum(gap, 0) ** 2


def visits(low1: np.ndarray, low2: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and cell of every visit: cells of the product grid whose two distances add up to ``limit`` at most.

    Both lists of a row are taken in rising order, as a multi-sequence does, and left where the sum passes the limit.
    """
    first, second = low1.argsort(1, kind="stable"), low2.argsort(1, kind="stable")
    near, far = np.take_along_axis(low1, first, 1), np.take_along_axis(low2, second, 1)
    rows, cells = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    active = np.arange(len(low1))
    for a in range(low1.shape[1]):
        active = active[near[active, a] + far[active, 0] <= limit]
        if not len(active):
            break
        row, b = np.nonzero(near[active, a, None] + far[active] <= limit)
        rows.append(active[row])
        cells.append(first[active[row], a] * low2.shape[1] + second[active[row], b])
    return np.concatenate(rows), np.concatenate(cells)


def stop(x: np.ndarray, books, least: float, recall: float, seed: int = 11) -> float:
    """The sum up to which cells are visited: what meets the partner in a share ``recall`` of pairs."""
    half = books[0].shape[1]
    random = np.random.default_rng(seed)
    aside = random.standard_normal(x.shape)
    aside = unit(aside - (aside * x).sum(1, keepdims=True) * x)
    other = least * x + np.sqrt(1 - least**2) * aside  # at exactly the least cosine
    parts = (slice(None, half), books[0]), (slice(half, None), books[1])
    (own1, low1), (own2, low2) = (bounds(x[:, h], book) for h, book in parts)
    cell1, cell2 = (bounds(other[:, h], book)[0] for h, book in parts)
    row = np.arange(len(x))
    made = low1[row, cell1] + low2[row, cell2]
    real = []
    for at in range(0, len(x), 512):
        block = slice(at, at + 512)
        near = x[block] @ x.T >= least
        near[np.arange(len(near)), row[block]] = False
        worst = np.where(near, low1[block][:, own1] + low2[block][:, own2], -1).max(1)  # the partner of each row that is hardest to meet
        real.append(worst[worst >= 0])
    real = np.concatenate(real)
    return max(float(np.quantile(made, recall)), float(np.quantile(real, recall)) if len(real) else 0.0)


def fit(vectors: DataFrame, sample: int, k: int, least: float, recall: float) -> dict[int, tuple]:
    """By length: codebooks of the two halves, and the sum at which visits stop."""
    by_size: dict[int, list] = {}
    for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").collect():
        by_size.setdefault(len(r[0]), []).append(r[0])
    fitted = {}
    for size, rows in by_size.items():
        if size > 1 and len(rows) >= FITTED:
            x, half = unit(np.array(rows, np.float64)), size // 2
            books = codebook(x[:, :half], k), codebook(x[:, half:], k)
            fitted[size] = (*books, stop(x, books, least, recall))
    return fitted


def _located(x: np.ndarray, fitted):
    """Cell of each row, its distances to the cells of either half, and its visits; without codebooks there is one cell."""
    if fitted is None:
        nothing = np.zeros((len(x), 1))
        return np.zeros(len(x), np.int64), nothing, nothing, np.arange(len(x)), np.zeros(len(x), np.int64)
    one, two, limit = fitted
    own1, low1 = bounds(x[:, : one.shape[1]], one)
    own2, low2 = bounds(x[:, one.shape[1] :], two)
    return own1 * len(two) + own2, low1, low2, *visits(low1, low2, limit)


def _place(fitted):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                sizes = pc.list_value_length(some.column(1)).to_numpy(zero_copy_only=False)
                for size in np.unique(sizes).tolist():
                    part = some.filter(pa.array(sizes == size))
                    own, low1, low2, row, cell = _located(unit(matrix(part.column(1))), fitted.get(size))
                    n = len(own)
                    pick = pa.array(np.concatenate([np.arange(n), row]))
                    lows = [*np.concatenate([low1, low2], axis=1), *[None] * len(row)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n + len(row), size, np.int32)), pa.array(np.concatenate([own, cell])), pa.array(np.arange(n + len(row)) < n),
                            pa.array(np.concatenate([own, own[row]])), pa.array(lows, pa.list_(pa.float64())), part.column(0).take(pick), part.column(1).take(pick),
                        ],
                        ["size", "cell", "member", "own", "lows", "vec_id", "embedding"],
                    )

    return run


def _verify(fitted, least: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        member = table.column("member").to_numpy()
        ids, own = table.column("vec_id").to_numpy(), table.column("own").to_numpy()
        m_ids, v_ids = ids[member], ids[~member]
        empty = pa.table({"vec_id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "low": pa.array([], pa.int64())})
        if not len(m_ids) or not len(v_ids):
            return empty
        x = unit(matrix(table.column("embedding").combine_chunks()))
        near = (x[~member] @ x[member].T) >= least
        near &= v_ids[:, None] != m_ids[None, :]
        v, m = np.nonzero(near)
        if not len(v):
            return empty
        # Where the member does not visit the visitor's cell, the pair is counted for both here.
        lows = matrix(table.column("lows").combine_chunks().filter(pa.array(member)))
        one, two, limit = fitted.get(x.shape[1]) or (np.zeros(1), np.zeros(1), 0.0)
        cell = own[~member][v]
        alone = lows[m, cell // len(two)] + lows[m, len(one) + cell % len(two)] > limit
        count_v, count_m = near.sum(1), np.bincount(m[alone], minlength=len(m_ids))
        v, m = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        near = near[np.ix_(v, m)]
        low_v, low_m = v_ids[v], m_ids[m]
        top = np.iinfo(np.int64).max
        while True:  # smallest id that links within the tile reach
            new_v = np.minimum(low_v, np.where(near, low_m[None, :], top).min(1))
            new_m = np.minimum(low_m, np.where(near, new_v[:, None], top).min(0))
            if (new_v == low_v).all() and (new_m == low_m).all():
                break
            low_v, low_m = new_v, new_m
        return pa.table({
            "vec_id": np.concatenate([v_ids[v], m_ids[m]]),
            "n": np.concatenate([count_v[v], count_m[m]]).astype(np.int64),
            "low": np.concatenate([low_v, low_m]),
        })

    return run


def near(vectors: DataFrame, least: float = LEAST, sample: int = SAMPLE, centroids: int | None = None, tile: int = TILE, recall: float = RECALL) -> DataFrame:
    """``vec_id, n, low``: links counted and smallest id reached, by tile; ids that occur may repeat."""
    if centroids is None:
        centroids = int(np.clip(round((vectors.count() / CELL) ** 0.5), LEAST_CENTROIDS, MOST_CENTROIDS))
    fitted = fit(vectors, sample, centroids, least, recall)
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    schema = f"size int, cell bigint, member boolean, own bigint, lows array<double>, vec_id bigint, embedding array<{kind}>"
    placed = store(vectors.select("vec_id", "embedding").mapInArrow(_place(fitted), schema), "cells")
    tiles = lambda role: F.ceil(F.count(F.when(role, 1)) / tile)
    sizes = placed.groupBy("size", "cell").agg(tiles(F.col("member")).cast("int").alias("m"), tiles(~F.col("member")).cast("int").alias("v"))
    sizes = sizes.filter("m > 0 AND v > 0")
    one = lambda n: F.array(F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = (
        placed.join(sizes, ["size", "cell"])
        .withColumn("mt", F.explode(F.when(F.col("member"), one("m")).otherwise(every("m"))))
        .withColumn("vt", F.explode(F.when(F.col("member"), every("v")).otherwise(one("v"))))
    )
    return dealt.groupBy("size", "cell", "mt", "vt").applyInArrow(lambda t: _verify(fitted, least)(t), "vec_id bigint, n bigint, low bigint")


def usable(rows: DataFrame) -> DataFrame:
    """Vectors that can link, each id once."""
    e = F.col("embedding")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = e.isNotNull() & F.forall(e, finite) & F.exists(e, lambda x: x != 0)
    kind = "float" if isinstance(rows.schema["embedding"].dataType.elementType, T.FloatType) else "double"  # single precision is kept as it is
    return rows.filter(F.col("vec_id").isNotNull() & good).groupBy("vec_id").agg(F.min(e.cast(f"array<{kind}>")).alias("embedding"))


def classes(rows: DataFrame, **options) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    found = store(near(usable(rows), **options), "tiles")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    roots = components(found.filter("vec_id <> low").select(F.col("vec_id").alias("u"), F.col("low").alias("v")))
    out = rows.select("vec_id").join(counts, "vec_id", "left").join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("root", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("root", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
