"""Ordered computations (running totals, carried values, look-back windows) that split hot groups.

A window function sends every row of a group to one task. That is the best plan while groups are
small, so each function first measures the largest group with a map-side-combined count. When a
group is larger than ``bound`` rows, and always where there is no group key, the rows are instead
range-partitioned on (key, order) into slices, each slice is computed on its own, and only what
crosses a slice border travels: one carried value, or the last few rows, for each slice. A key is
cut by a border only if it is the last key of one slice and the first of a later one, so
everything broadcast here holds at most a few rows for each slice.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewise.session import materialise

#: Rows one task may sort as a single window group.
GROUP_BOUND = 5_000_000

SLICE = "_slice"
_HALO = "_halo"

Order = Sequence[str]


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Row count of the biggest group."""
    top = df.groupBy(*by).count().agg(F.max("count")).first()[0]
    return int(top or 0)


def _fits(df: DataFrame, by: Sequence[str], bound: int | None) -> bool:
    return largest_group(df, by) <= (GROUP_BOUND if bound is None else bound)


def slice_rows(df: DataFrame, by: Sequence[str], order: Order, slices: int | None = None) -> DataFrame:
    """Range-partition on (by, order) and pin the partition number of each row as data."""
    keys = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    ranged = df.repartitionByRange(slices, *keys) if slices else df.repartitionByRange(*keys)
    return materialise(ranged.withColumn(SLICE, F.spark_partition_id()))


def match_keys(
    df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "left", *, small: bool = False
) -> DataFrame:
    """Join on equal keys, null matching null. ``small`` marks a side whose size is bounded."""
    renamed = other.withColumnsRenamed({c: "_k_" + c for c in keys})
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col("_k_" + c)) for c in keys))
    joined = df.join(F.broadcast(renamed) if small else renamed, on, how)
    return joined if how == "left_semi" else joined.drop(*["_k_" + c for c in keys])


def _border_rows(sliced: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows whose key is cut by a slice border (all rows when there is no key)."""
    if not by:
        return sliced
    key = F.struct(*by)
    edges = sliced.groupBy(SLICE).agg(F.min(key).alias("first"), F.max(key).alias("last"))
    ends = edges.select(F.explode(F.array("first", "last")).alias("k"), SLICE)
    cut = ends.groupBy("k").agg(F.count_distinct(SLICE).alias("n")).where("n > 1").select("k.*")
    return match_keys(sliced, cut, by, "left_semi", small=True)


def _window(by: Sequence[str], order: Order, reverse: bool = False) -> WindowSpec:
    keys = [F.col(c).desc_nulls_last() if reverse else F.col(c).asc_nulls_first() for c in order]
    return (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*keys)


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Order,
    *,
    sums: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    bound: int | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Add running sums, the last non-null value so far, and the next non-null value from here on.

    All three include the current row. ``order`` should identify a row within its group; rows that
    tie on it are taken in an arbitrary order.
    """
    sums, last, following = sums or {}, last or {}, following or {}
    sources = {f"_in_{n}": e for n, e in {**sums, **last, **following}.items()}
    df = df.withColumns(sources)

    def local(group: Sequence[str]) -> dict[str, Column]:
        ahead = _window(group, order).rowsBetween(Window.unboundedPreceding, 0)
        behind = _window(group, order, reverse=True).rowsBetween(Window.unboundedPreceding, 0)
        out = {n: F.coalesce(F.sum(f"_in_{n}").over(ahead), F.lit(0)) for n in sums}
        out |= {n: F.last(f"_in_{n}", ignorenulls=True).over(ahead) for n in last}
        out |= {n: F.last(f"_in_{n}", ignorenulls=True).over(behind) for n in following}
        return out

    if by and _fits(df, by, bound):
        return df.withColumns(local(by)).drop(*sources)

    sliced = slice_rows(df, by, order, slices)
    rank = F.struct(*order)
    totals = _border_rows(sliced, by).groupBy(SLICE, *by).agg(
        *[F.sum(f"_in_{n}").alias(f"_t_{n}") for n in sums],
        *[
            F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), rank)).alias(f"_t_{n}")
            for n in last
        ],
        *[
            F.min_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), rank)).alias(f"_t_{n}")
            for n in following
        ],
    )
    # At most two keys for each slice from here on, so these windows are small whatever the table.
    before = _window(by, [SLICE]).rowsBetween(Window.unboundedPreceding, -1)
    after = _window(by, [SLICE], reverse=True).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        SLICE,
        *by,
        *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in last],
        *[F.last(f"_t_{n}", ignorenulls=True).over(after).alias(f"_c_{n}") for n in following],
    )
    out = match_keys(sliced.withColumns(local([SLICE, *by])), carry, [SLICE, *by], small=True)
    final = {n: F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in sums}
    final |= {n: F.coalesce(F.col(n), F.col(f"_c_{n}")) for n in (*last, *following)}
    return out.withColumns(final).drop(
        SLICE, *sources, *[f"_c_{n}" for n in (*sums, *last, *following)]
    )


def look_back(
    df: DataFrame,
    by: Sequence[str],
    order: Order,
    columns: Callable[[WindowSpec], Mapping[str, Column]],
    reach: int,
    *,
    bound: int | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Window columns that see at most the ``reach`` rows before the current one.

    ``columns`` receives the ordered window and returns the new columns; frames inside it must not
    reach further back than ``reach`` rows.
    """
    if by and _fits(df, by, bound):
        return df.withColumns(dict(columns(_window(by, order))))

    sliced = slice_rows(df, by, order, slices)
    row = F.struct(*df.columns)
    tail = Window.partitionBy(SLICE, *by).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    tails = (
        _border_rows(sliced, by)
        .withColumn("_rn", F.row_number().over(tail))
        .where(F.col("_rn") <= reach)
    )
    ends = _window(by, [SLICE, *order])
    halo = (
        tails.select(
            SLICE,
            "_rn",
            *by,
            F.collect_list(row).over(ends.rowsBetween(-(reach - 1), 0)).alias("_rows"),
            *[c for c in order if c not in by],
        )
        .where(F.col("_rn") == 1)
        .withColumn("_next", F.lead(SLICE).over(_window(by, [SLICE])))
        .where(F.col("_next").isNotNull())
        .select(F.col("_next").alias(SLICE), F.explode("_rows").alias("_row"))
        .select(SLICE, "_row.*", F.lit(True).alias(_HALO))
    )
    padded = sliced.withColumn(_HALO, F.lit(False)).unionByName(halo)
    out = padded.withColumns(dict(columns(_window([SLICE, *by], order))))
    return out.where(~F.col(_HALO)).drop(SLICE, _HALO)


def group_totals(df: DataFrame, by: Sequence[str], **aggregates: Column) -> DataFrame:
    """Attach group aggregates to every row.

    The aggregate combines map-side and the join back is planned from its measured size (broadcast
    when small, otherwise a sort-merge join whose hot partitions AQE splits), so no task ever holds
    a whole group.
    """
    totals = df.groupBy(*by).agg(*[e.alias(n) for n, e in aggregates.items()])
    if not by:
        return df.join(F.broadcast(totals))
    return match_keys(df, totals, by)


def tie_ranks(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    *,
    descending: bool = False,
    bound: int | None = None,
    slices: int | None = None,
) -> DataFrame:
    """One row for each distinct (by, value) with its count and its min, average and dense rank.

    Works on pre-aggregated counts, so equal values never travel as rows. Nulls are not ranked.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("ties"))
    key = F.negative(value) if descending else F.col(value)
    ranked = running(
        counts.withColumn("_sort", key),
        by,
        ["_sort"],
        sums={"_upto": F.col("ties"), "rank_dense": F.lit(1).cast("long")},
        bound=bound,
        slices=slices,
    )
    before = F.col("_upto") - F.col("ties")
    return ranked.select(
        *by,
        value,
        "ties",
        (before + 1).alias("rank_min"),
        (before + (F.col("ties") + 1) / 2).alias("rank_avg"),
        "rank_dense",
    )


def carried_ranks(
    df: DataFrame, value: str, tie: str, weight: str, name: str, *, slices: int | None = None
) -> DataFrame:
    """Add ``name``, the average rank of ``value`` among all rows, of which each counts ``weight`` times.

    Rows are cut into slices by (value, tie), so that a value in a third of the table is spread over
    many; ranks are counted inside a slice and carried over its border. Only the first and the last
    value of a slice can go on in another one, and these few are counted over the whole table, so no
    row is joined on its value. ``value`` must not be null.
    """
    sliced = slice_rows(df, [], [value, tie], slices)
    totals = sliced.groupBy(SLICE).agg(
        F.sum(weight).alias("_total"), F.min(value).alias("_first"), F.max(value).alias("_last")
    )
    before = Window.partitionBy(F.lit(0)).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = materialise(totals.withColumn("_carry", F.coalesce(F.sum("_total").over(before), F.lit(0))))
    ends = carry.select(F.explode(F.array("_first", "_last")).alias("_end")).distinct()
    parts = (
        sliced.join(F.broadcast(ends), F.col(value) == F.col("_end"), "left_semi")
        .groupBy(SLICE, F.col(value).alias("_end")).agg(F.sum(weight).alias("_n"))
        .join(F.broadcast(carry), SLICE)
    )
    lower = F.when(F.col("_end") == F.col("_first"), F.lit(0)).otherwise(F.col("_total") - F.col("_n"))
    cut = parts.groupBy("_end").agg(
        F.sum("_n").alias("_end_ties"), F.min(F.col("_carry") + lower).alias("_end_lower")
    )
    upto = F.sum(weight).over(Window.partitionBy(SLICE).orderBy(value))  # with all equal values
    ties = F.sum(weight).over(Window.partitionBy(SLICE, value))
    ranked = (  # both tables hold at most two rows for each slice
        sliced.withColumns({"_ties": ties, "_upto": upto})
        .join(F.broadcast(carry.select(SLICE, "_carry")), SLICE)
        .join(F.broadcast(cut), F.col(value) == F.col("_end"), "left")
    )
    lower = F.coalesce("_end_lower", F.col("_carry") + F.col("_upto") - F.col("_ties"))
    rank = lower + (F.coalesce("_end_ties", "_ties") + 1) / 2
    return ranked.select(*df.columns, rank.alias(name))


def _distinct_fit(df: DataFrame, by: Sequence[str], value: str, bound: int) -> bool:
    """Whether no group holds more than ``bound`` distinct values; estimated with a wide margin."""
    if df.count() <= bound:
        return True
    about = df.groupBy(*by).agg(F.approx_count_distinct(value).alias("d")).agg(F.max("d")).first()[0]
    return int(about or 0) <= bound // 2


def group_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    *,
    weight: str | None = None,
    bound: int | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Exact, linearly interpolated quantiles for each group, whatever the group size.

    Values are counted first (map-side, then by group and value), so a group is only as large as its
    distinct values. Running counts over the ordered values then pick the two order statistics around
    each quantile. Groups of up to ``bound`` distinct values are ordered by a window, which spills
    where the ``percentile`` aggregate would hold them all in memory; larger ones in slices.
    ``weight`` names a column of counts when the input is counted already.
    """
    bound = GROUP_BOUND if bound is None else bound
    values = df.where(F.col(value).isNotNull())
    if weight:  # rows that repeat a value do no harm: each covers positions of its own
        counts = values.select(*by, value, F.col(weight).cast("long").alias("_n"))
    else:
        counts = values.groupBy(*by, value).agg(F.count("*").alias("_n"))
    if _distinct_fit(df, by, value, bound):
        upto = _window(by, [value]).rowsBetween(Window.unboundedPreceding, 0)
        whole = _window(by, [value]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        counts = counts.withColumns({"_upto": F.sum("_n").over(upto), "_total": F.sum("_n").over(whole)})
    else:
        counts = running(counts, by, [value], sums={"_upto": F.col("_n")}, bound=bound, slices=slices)
        counts = group_totals(counts, by, _total=F.sum("_n"))
    first = F.col("_upto") - F.col("_n")
    x = F.col(value).cast("double")

    def holds(place: Column) -> Column:
        return (first <= place) & (place < F.col("_upto"))

    aggregates, needed = [], []
    for name, p in probabilities.items():
        at = F.lit(p) * (F.col("_total") - 1)
        low, high = F.floor(at), F.ceil(at)
        lower, upper = F.max(F.when(holds(low), x)), F.max(F.when(holds(high), x))
        aggregates.append((lower + F.max(at - low) * (upper - lower)).alias(name))
        needed += [holds(low), holds(high)]
    return counts.where(reduce(lambda a, b: a | b, needed)).groupBy(*by).agg(*aggregates)
