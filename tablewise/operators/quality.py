"""Data-quality findings."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.text import strip
from tablewise.functions.types import columns_where, comparable, ident, is_floating, is_numeric, is_string
from tablewise.operators.stats import QUARTILES, column_quantiles, column_shapes, nulls_distinct, numbers, stacked, wide

# Thresholds of the findings.
NULL_RATE_NOTE = 0.20
NULL_RATE_HIGH = 0.60
NEAR_CONSTANT = 0.95
HIGH_CARDINALITY = 0.90
IMBALANCE = 10.0
FENCE = 1.5
MAD_SCALE = 0.6745
MEAN_AD_SCALE = 1.253314
Z_CUTOFF = 3.5
MIN_OUTLIER_VALUES = 4


def _null_marks(columns: Sequence[Column]) -> list[Column]:
    """Which of ``columns`` are null, as bits of whole numbers: the hash passes over nulls."""
    bits = [F.when(c.isNull(), F.lit(1 << (i % 62))).otherwise(F.lit(0)).cast("long") for i, c in enumerate(columns)]
    return [reduce(lambda x, y: x.bitwiseOR(y), bits[at : at + 62]) for at in range(0, len(bits), 62)]


def duplicates(df: DataFrame) -> DataFrame:
    """Rows, exact extra copies, and extra copies once text is stripped and lower-cased.

    One scan; only two 128-bit fingerprints a row are shuffled, so wide rows and long text need not travel, and equal rows
    combine map-side, so a row copied over and over does not load one task.
    """
    cells = {f.name: comparable(F.col(ident(f.name)), f.dataType) for f in df.schema.fields}
    texts = [cells[c] for c in columns_where(df, is_string)]
    others = [x for c, x in cells.items() if c not in columns_where(df, is_string)] + _null_marks(list(cells.values()))
    plain = [x.alias(f"t{i}") for i, x in enumerate(texts)]
    base = df.select(F.xxhash64(F.lit(1), *others).alias("a"), F.xxhash64(F.lit(2), *others).alias("b"), *plain)
    base = base.select("*", *[F.lower(strip(F.col(f"t{i}"))).alias(f"n{i}") for i in range(len(texts))])
    prints = base.select(*[
        F.xxhash64(half, *[f"{kind}{i}" for i in range(len(texts))]).alias(f"{name}_{half}")
        for name, kind in (("exact", "t"), ("near", "n")) for half in ("a", "b")
    ])
    exact = prints.groupBy(*prints.columns).agg(F.count("*").alias("copies"))
    near = exact.groupBy("near_a", "near_b").agg(F.sum("copies").alias("copies"), F.count("*").alias("kinds"))
    return near.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("copies") - F.sum("kinds"), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum("copies") - F.count("*"), F.lit(0)).alias("near_duplicate_rows"),
    )


def null_issues(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``all_null``, ``high_null_rate`` and ``null_rate`` findings."""
    columns = list(columns or df.columns)
    return null_kinds(wide(df, columns, lambda c: {"rows": F.count("*"), "nulls": F.count_if(c.isNull())}))


def null_kinds(rates: DataFrame) -> DataFrame:
    """The findings for a table of (column, rows, nulls)."""
    rate = F.col("nulls") / F.nullif(F.col("rows"), F.lit(0))
    kind = (
        F.when((F.col("rows") > 0) & (F.col("nulls") == F.col("rows")), "all_null")
        .when(rate >= NULL_RATE_HIGH, "high_null_rate")
        .when(rate >= NULL_RATE_NOTE, "null_rate")
    )
    return rates.select(
        "column",
        kind.alias("kind"),
        rate.alias("null_rate"),
        F.when(kind == "null_rate", "info").otherwise("warning").alias("severity"),
    ).where(F.col("kind").isNotNull())


def shape_issues(
    df: DataFrame, semantics: dict[str, str], *, shapes: DataFrame | None = None
) -> DataFrame:
    """``constant``, ``near_constant``, ``high_cardinality`` and ``class_imbalance`` findings."""
    shape = shapes if shapes is not None else column_shapes(df, list(semantics))
    shape = shape.where(F.col("column").isin(*semantics) & (F.col("distinct") > 0))
    semantic = F.create_map(*[F.lit(x) for kv in semantics.items() for x in kv])[F.col("column")]
    shape = shape.withColumn("semantic", semantic)
    share = F.col("max_n") / F.col("n")
    spread = F.col("max_n") / F.col("min_n")
    varied = F.col("distinct") > 1
    labels = F.array_compact(
        F.array(
            F.when(~varied, F.struct(F.lit("constant").alias("kind"), F.lit("warning").alias("severity"))),
            F.when(varied & (share >= NEAR_CONSTANT),
                   F.struct(F.lit("near_constant").alias("kind"), F.lit("warning").alias("severity"))),
            F.when(
                varied
                & F.col("semantic").isin("categorical", "text")
                & (F.col("distinct") / F.col("rows") >= HIGH_CARDINALITY),
                F.struct(F.lit("high_cardinality").alias("kind"), F.lit("info").alias("severity")),
            ),
            F.when(
                varied & F.col("semantic").isin("categorical", "boolean") & (spread >= IMBALANCE),
                F.struct(F.lit("class_imbalance").alias("kind"), F.lit("info").alias("severity")),
            ),
        )
    )
    return shape.select("column", "distinct", "n", "max_n", "min_n", F.inline(labels))


def outlier_counts(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    centre: DataFrame | None = None,
    bound: int | None = None,
) -> DataFrame:
    """IQR-fence and modified-z outliers of each numeric column.

    Quartiles and the median deviation are exact column quantiles; what counts as an outlier is then a fixed test, so
    one aggregate over the cells counts all columns. ``centre`` gives the quartiles by column if they are known.
    """
    columns = list(columns or columns_where(df, is_numeric))
    x = {c: F.col(ident(c)).cast("double") for c in columns}
    if centre is None:
        centre = column_quantiles(df, x, QUARTILES, bound=bound)
    middle = {r["column"]: r for r in centre.collect()}  # one row for each column
    away = {c: F.abs(x[c] - F.lit(middle[c]["median"])) for c in columns}
    spread = {r["column"]: r["mad"] for r in column_quantiles(df, away, {"mad": 0.5}, bound=bound).collect()}
    level = {c: away[c] for c in columns if spread[c] == 0}  # most values are equal: the mean deviation has to serve
    means = {r["column"]: r["mean"] for r in stacked(df, level, lambda v: {"mean": F.avg(v)}).collect()} if level else {}

    none = float("nan")  # nothing is above it
    low, high, factor, divisor, tested = [], [], [], [], []
    for c in columns:
        q1, q3 = middle[c]["q1"], middle[c]["q3"]
        fenced = q1 is not None and q3 > q1
        low.append(q1 - FENCE * (q3 - q1) if fenced else -math.inf)
        high.append(q3 + FENCE * (q3 - q1) if fenced else none)
        tested.append(bool(spread[c] or means.get(c)))
        factor.append(MAD_SCALE if spread[c] else 1.0)
        divisor.append(spread[c] or MEAN_AD_SCALE * (means.get(c) or 0.0) or 1.0)
    centres = [none if middle[c]["median"] is None else middle[c]["median"] for c in columns]

    def fields(v: Column) -> dict[str, Column]:
        own = lambda values: F.get(numbers(values), F.col("at"))
        fence = (v < own(low)) | (v > own(high))
        z = (own(tested) == 1) & (F.abs(v - own(centres)) * own(factor) / own(divisor) > Z_CUTOFF)
        enough = F.count(v) >= MIN_OUTLIER_VALUES
        return {
            "iqr_outliers": F.when(enough, F.count_if(fence)).otherwise(0).cast("long"),
            "modified_z_outliers": F.when(enough, F.count_if(z)).otherwise(0).cast("long"),
        }

    return stacked(df, x, fields).drop("at")


def candidate_keys(df: DataFrame) -> DataFrame:
    """Columns that are never null and unique on every row; floating columns never qualify.

    An approximate distinct count rules out most columns, so only near-unique ones are counted
    exactly.
    """
    columns = columns_where(df, lambda t: not is_floating(t))
    if not columns:
        return df.sparkSession.createDataFrame([], "column string")
    triage = wide(
        df,
        columns,
        lambda c: {
            "rows": F.count("*"),
            "nulls": F.count_if(c.isNull()),
            "about": F.approx_count_distinct(c.cast("string"), 0.02),
        },
    )
    likely = [
        r["column"]
        for r in triage.where((F.col("nulls") == 0) & (F.col("about") >= 0.85 * F.col("rows"))
                              & (F.col("rows") > 0)).collect()
    ]
    if not likely:
        return df.sparkSession.createDataFrame([], "column string")
    exact = nulls_distinct(df, likely)
    return exact.where(F.col("distinct") == F.col("rows")).select("column")
