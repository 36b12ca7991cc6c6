"""General table operators that need more than one DataFrame call."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewise.functions.types import ident, is_floating
from tablewise.operators import ordered
from tablewise.operators.ordered import group_totals, match_keys, running
from tablewise.session import materialise

#: Values in one part of a group's list.
LIST_PART = 100_000


# ---- columns -------------------------------------------------------------------------------------


def select_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Columns whose name matches a regular expression."""
    return df.select(*[ident(c) for c in df.columns if re.search(pattern, c)])


def select_types(df: DataFrame, *types: type[T.DataType]) -> DataFrame:
    return df.select(*[ident(f.name) for f in df.schema.fields if isinstance(f.dataType, types)])


def select_except(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[ident(c) for c in df.columns if c not in names])


def map_columns(df: DataFrame, columns: Sequence[str], fn, *, prefix: str = "", suffix: str = "") -> DataFrame:
    """Apply one expression to several columns, naming the results by prefix and suffix."""
    return df.withColumns({f"{prefix}{c}{suffix}": fn(F.col(ident(c))) for c in columns})


# ---- rows ----------------------------------------------------------------------------------------


def head(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows, in order."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n).orderBy(*order)


def slice_rows(df: DataFrame, order: Sequence[str], start: int, n: int) -> DataFrame:
    """Rows ``start`` to ``start + n`` in ascending order, however deep.

    Only the order columns are sorted, in range slices; their counts tell which slices hold the first and the last row, and
    these tell the keys to filter by. No task holds the rows that are passed over.
    """
    total = df.count()
    last = min(start + n, total) - 1
    if n <= 0 or start >= total:
        return df.limit(0)
    keys = ordered.slice_rows(df.select(*map(ident, order)), [], order)
    sizes = sorted((r[ordered.SLICE], r["count"]) for r in keys.groupBy(ordered.SLICE).count().collect())  # one row for each slice
    first_key, below = _key_at(keys, sizes, order, start)
    last_key, _ = _key_at(keys, sizes, order, last)
    place = F.struct(*map(ident, order))
    ends = first_key.withColumnRenamed("_key", "_first").join(F.broadcast(last_key.withColumnRenamed("_key", "_last")))  # one row each
    between = df.join(F.broadcast(ends))
    kept = between.where((place >= F.col("_first")) & (place <= F.col("_last"))).drop("_first", "_last")
    if kept.count() == last - start + 1:
        return kept.orderBy(*map(ident, order))
    return kept.orderBy(*map(ident, order)).offset(start - below).limit(last - start + 1)  # rows that tie with the first or last


def _key_at(keys: DataFrame, sizes: list[tuple[int, int]], order: Sequence[str], place: int) -> tuple[DataFrame, int]:
    """The order columns of the row at a place, as one struct, and the number of rows below them."""
    before = 0
    for slice_, size in sizes:
        if place < before + size:
            break
        before += size
    window = Window.partitionBy(ordered.SLICE).orderBy(*map(ident, order))
    here = keys.where(F.col(ordered.SLICE) == slice_).withColumns({"_row": F.row_number().over(window), "_rank": F.rank().over(window)})
    found = materialise(here.where(F.col("_row") == place - before + 1).select(F.struct(*map(ident, order)).alias("_key"), "_rank"))
    return found.select("_key"), before + found.first()["_rank"] - 1


def drawn(key: str, seed: int = 0) -> Column:
    """A number below 2**32 for each key: the first eight digits of its MD5, so that any engine draws the same."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ident(key)).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows, the same for the same seed: the smallest hashes win."""
    return slice_rows(df.withColumn("_drawn", drawn(key, seed)), ["_drawn", key], 0, n).drop("_drawn")


def sample_share(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """About ``share`` of the rows, picked by the hash of ``key``: independent of the layout."""
    return df.where(drawn(key, seed) < int(share * 2**32))


def unique_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key, the first in ``order``. Combines map-side; no window."""
    row = F.struct(*[F.col(ident(c)) for c in df.columns])
    first = F.min_by(row, F.struct(*order)).alias("row")
    return df.groupBy(*[F.col(ident(k)).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(first).select("row.*")


def list_per_group(
    df: DataFrame, by: Sequence[str], value: str, order: Sequence[str], *, size: int = LIST_PART
) -> DataFrame:
    """The values of each group as ordered lists of ``size`` values, numbered by ``part`` from 0.

    A list is one cell and cannot outgrow a task; every group is cut in the same way, whatever its length.
    """
    element = F.struct(*order, F.col(value).alias("_v"))
    at = running(df, by, order, sums={"_at": F.lit(1).cast("long")})
    numbered = at.withColumn("part", F.floor((F.col("_at") - 1) / size))
    lists = numbered.groupBy(*by, "part").agg(F.sort_array(F.collect_list(element)).alias("_l"))
    return lists.select(*by, "part", F.transform("_l", lambda e: e["_v"]).alias("values"))


# ---- joins and concatenation ---------------------------------------------------------------------


def join_full(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join with the key columns of both sides merged."""
    return left.join(right, list(on), "full")


def cross_join(df: DataFrame, few: DataFrame) -> DataFrame:
    """Every row of ``df`` with every row of ``few``, for frames such as dates x stores.

    The result is the product by definition. The caller names the side with few rows; Spark sends it to
    every task where it knows it to be small, and pairs partitions otherwise.
    """
    return df.crossJoin(few)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    by: Sequence[str] = (),
    *,
    bound: int | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Each left row with the latest right row at or before it (within ``by``).

    Both sides are put in one order, right rows first on equal times, and the last right row seen is
    carried forward. One exchange, no pairs; a hot key is cut into slices, and so is a time that many rows share.
    """
    payload = [c for c in right.columns if c not in by]
    clash = sorted(set(payload) & set(left.columns))
    if clash:
        raise ValueError(f"rename these columns of the right side first: {', '.join(clash)}")
    a = left.select(
        *[F.col(c) for c in by],
        F.col(left_on).alias("_t"),
        F.lit(1).alias("_side"),
        F.struct(*left.columns).alias("_left"),
        F.lit(None).cast(right.select(F.struct(*payload).alias("r")).schema["r"].dataType).alias("_right"),
    )
    b = right.where(F.col(right_on).isNotNull()).select(
        *[F.col(c) for c in by],
        F.col(right_on).alias("_t"),
        F.lit(0).alias("_side"),
        F.lit(None).cast(left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType).alias("_left"),
        F.struct(*payload).alias("_right"),
    )
    both = a.unionByName(b).withColumn("_n", F.monotonically_increasing_id())  # borders may fall between equal times
    carried = running(both, by, ["_t", "_side", "_n"], last={"_hit": F.col("_right")}, bound=bound, slices=slices)
    rows = carried.where(F.col("_side") == 1)
    matched = F.when(F.col("_t").isNotNull(), F.col("_hit"))
    keys = [F.col(c).isNotNull() for c in by]
    for known in keys:  # null keys match nothing
        matched = F.when(known, matched)
    hit = rows.select("_left.*", matched.alias("_m"))
    return hit.select(*left.columns, *[F.col(f"_m.{ident(c)}").alias(c) for c in payload])


def concat(*frames: DataFrame) -> DataFrame:
    """Stack tables: columns by name, missing ones null, types widened to the common one."""
    names = list(dict.fromkeys(c for f in frames for c in f.columns))
    target: dict[str, T.DataType] = {}
    for name in names:
        kinds = [f.schema[name].dataType for f in frames if name in f.columns]
        target[name] = _common_type(kinds)
    aligned = [
        f.select(
            *[
                (F.col(ident(n)) if n in f.columns else F.lit(None)).cast(target[n]).alias(n)
                for n in names
            ]
        )
        for f in frames
    ]
    out = aligned[0]
    for frame in aligned[1:]:
        out = out.unionByName(frame)
    return out


def _common_type(kinds: Sequence[T.DataType]) -> T.DataType:
    if all(k == kinds[0] for k in kinds):
        return kinds[0]
    if all(isinstance(k, T.IntegralType) for k in kinds):
        return T.LongType()
    if all(isinstance(k, T.NumericType) for k in kinds):
        return T.DoubleType()
    if all(isinstance(k, (T.DateType, T.TimestampType, T.TimestampNTZType)) for k in kinds):
        return T.TimestampNTZType()
    return T.StringType()


def hconcat(left: DataFrame, right: DataFrame, key: str | None) -> DataFrame:
    """Side by side, matched on a row key. Rows have no position, so a key is required."""
    if key is None:
        raise ValueError("side-by-side concatenation needs a row key")
    return left.join(right, key, "full")


# ---- missing values ------------------------------------------------------------------------------


def nan_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = columns or [f.name for f in df.schema.fields if is_floating(f.dataType)]
    return df.withColumns({c: F.when(~F.isnan(ident(c)), F.col(ident(c))) for c in names})


def fill_mean(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Nulls take the mean of the column, or of the row's group."""
    out = group_totals(df, list(by), _mean=F.avg(ident(column)))
    filled = F.coalesce(F.col(ident(column)).cast("double"), F.col("_mean"))
    return out.withColumn(column, filled).drop("_mean")


def fill_forward(
    df: DataFrame, column: str, order: Sequence[str], by: Sequence[str] = (), *,
    bound: int | None = None, slices: int | None = None,
) -> DataFrame:
    """Nulls take the last value before them."""
    out = running(df, list(by), order, last={"_last": F.col(ident(column))}, bound=bound, slices=slices)
    return out.withColumn(column, F.col("_last")).drop("_last")


def interpolate(
    df: DataFrame, column: str, order: Sequence[str], by: Sequence[str] = (), *,
    bound: int | None = None, slices: int | None = None,
) -> DataFrame:
    """Nulls between two values are put on the straight line by row position; outer nulls stay."""
    numbered = running(
        df, list(by), order, sums={"_at": F.lit(1).cast("long")}, bound=bound, slices=slices
    )
    x = F.col(ident(column)).cast("double")
    known = F.when(x.isNotNull(), F.struct(F.col("_at").alias("at"), x.alias("x")))
    out = running(
        numbered, list(by), order, last={"_a": known}, following={"_b": known}, bound=bound, slices=slices
    )
    gap = F.nullif((F.col("_b.at") - F.col("_a.at")).cast("double"), F.lit(0.0))
    line = F.col("_a.x") + (F.col("_b.x") - F.col("_a.x")) * (F.col("_at") - F.col("_a.at")) / gap
    return out.withColumn(column, F.coalesce(x, line)).drop("_at", "_a", "_b")


# ---- time ----------------------------------------------------------------------------------------

_BUCKET = re.compile(r"^(\d+)(mo|[mhdwqy])$")
_MONTHS = {"mo": 1, "q": 3, "y": 12}
_SECONDS = {"m": 60, "h": 3600, "d": 86_400, "w": 7 * 86_400}


def time_bucket(when: Column, every: str) -> Column:
    """Start of the bucket a time falls in: ``15m 1h 1d 1w 1mo 1q 1y 3mo`` and their multiples.

    Weeks start on Monday; months, quarters and years follow the calendar.
    """
    found = _BUCKET.match(every)
    if not found:
        raise ValueError(f"unknown bucket {every!r}")
    size, unit = int(found[1]), found[2]
    local = when.cast("timestamp_ntz")
    if unit in _MONTHS:
        size *= _MONTHS[unit]
        months = F.year(local) * 12 + F.month(local) - 1
        start = months - months % size
        day = F.make_date(F.floor(start / 12).cast("int"), (start % 12 + 1).cast("int"), F.lit(1))
        return day.cast("timestamp_ntz")
    width = size * _SECONDS[unit] * 1_000_000
    # 1970-01-05 was a Monday.
    origin = 4 * 86_400_000_000 if unit == "w" else 0
    micros = F.unix_micros(local.cast("timestamp"))
    start = micros - F.pmod(micros - origin, F.lit(width))
    return F.timestamp_micros(start).cast("timestamp_ntz")


def bucketed(
    df: DataFrame, when: str, every: str, by: Sequence[str] = (), **aggregates: Column
) -> DataFrame:
    """Aggregates by time bucket (and key); buckets without rows do not appear."""
    out = df.groupBy(time_bucket(F.col(ident(when)), every).alias("bucket"), *by)
    return out.agg(*[e.alias(n) for n, e in aggregates.items()])


def resampled(df: DataFrame, when: str, step: str, bucket: str = "1d", **aggregates: Column) -> DataFrame:
    """Like :func:`bucketed`, with a row for every bucket from the first to the last.

    ``step`` is the interval between buckets, such as ``INTERVAL 1 DAY``. The calendar is generated
    from the two ends of the aggregated data.
    """
    found = bucketed(df, when, bucket, **aggregates)
    ends = found.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    calendar = ends.select(F.explode(F.sequence("a", "b", F.expr(step))).alias("bucket"))
    return calendar.join(found, "bucket", "left")


def rolling_time(
    df: DataFrame,
    when: str,
    key: str,
    seconds: int,
    value: str,
    by: Sequence[str] = (),
    *,
    bound: int | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Sum and count of ``value`` over the ``seconds`` up to each row, the far end excluded.

    Rows sharing a time see each other; rows without a time get nulls. Time is cut into blocks as long as the period, so
    a window is the start of its own block and the end of the block before. Both are running sums within a block:
    values are only ever added, so no value outside a window (NaN, or a very large one) can touch it. Hot keys
    are cut into slices as in every running sum.
    """
    period = seconds * 1_000_000
    at = F.unix_micros(F.col(ident(when)).cast("timestamp"))
    x = F.col(ident(value))
    times = df.withColumn("_t", at).where("_t IS NOT NULL").groupBy(*by, "_t").agg(
        F.coalesce(F.sum(x), F.lit(0)).alias("_s"), F.count(x).alias("_n")
    )
    block = F.floor(F.col("_t") / period)
    starts = running(
        times.withColumn("_block", block), [*by, "_block"], ["_t"],
        sums={"_cs": F.col("_s"), "_cn": F.col("_n")}, bound=bound, slices=slices,
    )
    # From the end of a block backwards. A window that reaches down to some time asks before the rows of that time.
    rows = times.select(*by, block.alias("_block"), (-F.col("_t")).alias("_r"), F.lit(1).alias("_side"), "_s", "_n")
    nothing = [F.lit(0).cast(times.schema[c].dataType).alias(c) for c in ("_s", "_n")]
    asks = times.select(
        *by, (block - 1).alias("_block"), (F.lit(period) - F.col("_t")).alias("_r"), F.lit(0).alias("_side"), *nothing
    )
    ends = running(
        rows.unionByName(asks), [*by, "_block"], ["_r", "_side"],
        sums={"_cs": F.col("_s"), "_cn": F.col("_n")}, bound=bound, slices=slices,
    ).where(F.col("_side") == 0)
    parts = starts.select(*by, "_t", "_cs", "_cn").unionByName(
        ends.select(*by, (F.lit(period) - F.col("_r")).alias("_t"), "_cs", "_cn")
    )
    windows = parts.groupBy(*by, "_t").agg(F.sum("_cs").alias("rolling_sum"), F.sum("_cn").alias("rolling_n"))
    return match_keys(df.withColumn("_t", at), windows, [*by, "_t"]).drop("_t")


# ---- reshaping -----------------------------------------------------------------------------------


def pivot(df: DataFrame, index: Sequence[str], on: str, values: Mapping | Sequence, measure: Column) -> DataFrame:
    """One column for each of the listed values, which saves the job that would look them up."""
    return df.groupBy(*index).pivot(on, list(values)).agg(measure)


def unpivot(df: DataFrame, index: Sequence[str], on: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot([F.col(ident(c)) for c in index], [F.col(ident(c)) for c in on], name, value)


def target_encode(df: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """For each key column the mean target of the row's value, as ``<key>_encoded``."""
    for key in keys:
        df = group_totals(df, [key], **{f"{key}_encoded": F.avg(ident(target))})
    return df
