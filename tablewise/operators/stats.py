"""Statistics of many columns in one job, from plans whose size does not grow with the width.

Moments and text facts stack the cells of a row and aggregate them map-side by column; they move no values. Quantiles are bracketed
by summaries first, so that only the values around them are counted. Columns of few values are counted by one scan; exact
distinct counts of the others shuffle each value once, in the type it has.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewise.functions import dates
from tablewise.functions.numeric import lenient_double
from tablewise.functions.text import strip
from tablewise.functions.types import columns_where, comparable, ident, is_floating, is_numeric, is_string
from tablewise.operators import selection
from tablewise.operators.tallies import tallies
from tablewise.session import pin, together

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
TOP_VALUES = 5
#: Characters up to which a text travels as it is where values are only counted; longer ones as a digest.
LONG_TEXT = 256
#: Share of the rows from which on a column may be a key, given an estimate of its distinct values.
LIKELY_KEY = 0.85
#: Share of the second moment below which a deviation is rounding: the side is constant.
CONSTANT = 1e-13


def wide(
    df: DataFrame, columns: Sequence[str], fields: Callable[[Column], Mapping[str, Column]]
) -> DataFrame:
    """One aggregate over ``columns`` in the types they have, returned as one row for each column."""
    structs = [
        F.struct(F.lit(name).alias("column"), *[e.alias(k) for k, e in fields(F.col(ident(name))).items()]).alias(f"c{i}")
        for i, name in enumerate(columns)
    ]
    row = df.agg(*structs)
    return row.select(F.inline(F.array(*row.columns)))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) for the non-null values of all columns as text: one shuffle, combined map-side."""

    def shown(c: str) -> Column:
        x = F.col(ident(c))
        return (x + 0.0 if is_floating(df.schema[c].dataType) else x).cast("string")  # -0.0 is 0.0

    pairs = [F.struct(F.lit(c).alias("column"), shown(c).alias("value")) for c in columns]
    stacked = df.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull())
    return stacked.groupBy("column", "value").agg(F.count("*").alias("n"))


def column_shapes(df: DataFrame, columns: Sequence[str] | None = None, *, exact: bool = True) -> DataFrame:
    """Rows, nulls, distinct values and the largest and smallest frequency of each column.

    One scan tells which columns have few values, and counts these. Only the others are counted by value, in the type they
    have (whole, real or text; long text as a 128-bit digest), which shuffles a value once and writes nothing. With ``exact``
    false that is done only for columns that may be keys: full, not floating, and about as many values as rows.
    The others then have an estimated ``distinct``, no frequencies, and ``estimated`` set.
    """
    columns = list(columns or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    present = {c: comparable(F.col(ident(c)), types[c]) for c in columns}
    told = {r["at"]: r for r in tallies(df, [F.when(x.isNotNull(), F.xxhash64(x)) for x in present.values()]).collect()}
    if not told:  # no partition at all
        told = {i: Row(rows=0, nulls=0, exact=True, distinct=0, max_n=None, min_n=None) for i in range(len(columns))}

    def wanted(c: str, r: Row) -> bool:
        likely_key = not is_floating(types[c]) and r["nulls"] == 0 and r["distinct"] >= LIKELY_KEY * r["rows"]
        return not r["exact"] and (exact or likely_key)

    many = [c for c, r in zip(columns, map(told.get, range(len(columns)))) if wanted(c, r)]
    counted = _counted(df, {c: (present[c], types[c]) for c in many}) if many else {}
    rows = []
    for i, c in enumerate(columns):
        r = told[i]
        known = counted.get(c, r)
        n = r["rows"] - r["nulls"]
        rows.append((c, r["rows"], r["nulls"], known["distinct"], n if n else None, known["max_n"], known["min_n"], not (r["exact"] or c in counted)))
    schema = "column string, rows long, nulls long, distinct long, n long, max_n long, min_n long, estimated boolean"
    return df.sparkSession.createDataFrame(rows, schema)


def _counted(df: DataFrame, columns: Mapping[str, tuple[Column, T.DataType]]) -> dict[str, Row]:
    """Exact distinct values and frequencies: one job for each kind of value, whatever the number of columns."""
    kinds: dict[str, list[Column]] = {}
    for at, (c, (x, dtype)) in enumerate(columns.items()):
        if is_floating(dtype):
            kind, cell = "double", x.cast("double") + 0.0
        elif isinstance(dtype, T.IntegralType):
            kind, cell = "long", x.cast("long")
        elif isinstance(dtype, T.DateType):
            kind, cell = "long", F.unix_date(x).cast("long")
        else:
            kind, cell = "string", x.cast("string")
            cell = F.when(F.char_length(cell) > LONG_TEXT, F.concat(F.lit("md5:"), F.md5(cell))).otherwise(cell)
        kinds.setdefault(kind, []).append(F.struct(F.lit(at).alias("at"), cell.alias("x")))

    def counts(cells: list[Column]) -> list[Row]:
        stacked = df.select(F.inline(F.array(*cells))).where("x IS NOT NULL").groupBy("at", "x").agg(F.count("*").alias("n"))
        return stacked.groupBy("at").agg(F.count("*").alias("distinct"), F.max("n").alias("max_n"), F.min("n").alias("min_n")).collect()

    names = list(columns)
    return {names[r["at"]]: r for found in together(df.sparkSession, *[partial(counts, cells) for cells in kinds.values()]) for r in found}


def nulls_distinct(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, nulls, null rate and exact distinct non-null values of each column."""
    return column_shapes(df, columns).select(
        "column", "rows", "nulls", "distinct", (F.col("nulls") / F.col("rows")).alias("null_rate")
    )


def column_quantiles(
    df: DataFrame, values: Mapping[str, Column], probabilities: Mapping[str, float], *, bound: int | None = None
) -> DataFrame:
    """Exact, linearly interpolated quantiles of each of ``values``: one row (column, quantiles)."""
    return selection.quantiles(df, values, probabilities, bound=bound)


def stacked(df: DataFrame, values: Mapping[str, Column], fields: Callable[[Column], Mapping[str, Column]], kind: str = "double") -> DataFrame:
    """Aggregates of the cells of each of ``values``: one row (at, column, fields) for each, from one plan for any width.

    ``fields`` gets the cell and may use its position ``at``. Every column has a null cell of its own besides, so a table
    without rows has a row for each column too: count cells, not rows.
    """
    names = list(values)
    cells = df.select(F.posexplode(F.array(*[x.cast(kind) for x in values.values()])).alias("at", "x"))
    own = df.sparkSession.range(len(names)).select(F.col("id").cast("int").alias("at"), F.lit(None).cast(kind).alias("x"))
    made = cells.union(own).groupBy("at").agg(*[e.alias(k) for k, e in fields(F.col("x")).items()])
    known = df.sparkSession.createDataFrame(list(enumerate(names)), "at int, column string")
    return made.join(F.broadcast(known), "at")  # one row for each column


def numbers(values: Sequence[float]) -> Column:
    """An array of doubles as one constant, however long."""
    return F.split(F.lit(",".join(map(repr, map(float, values)))), ",").cast("array<double>")


def numeric_stats(
    df: DataFrame, columns: Sequence[str] | None = None, *, bound: int | None = None
) -> DataFrame:
    """Min, max, mean, median, std, quartiles, zeros, negatives and skew, one row for each column."""
    values = {c: F.col(ident(c)) for c in columns or columns_where(df, is_numeric)}

    def moments(x: Column) -> dict[str, Column]:
        return {
            "n": F.count(x), "minimum": F.min(x), "maximum": F.max(x), "mean": F.avg(x),
            "std": F.stddev_samp(x), "zeros": F.count_if(x == 0), "negatives": F.count_if(x < 0),
            "skew": F.when(F.count(x) >= 3, F.skewness(x)),
        }

    of_cells, middle = together(
        df.sparkSession,
        lambda: pin(stacked(df, values, moments)),
        lambda: column_quantiles(df, values, QUARTILES, bound=bound),
    )
    out = of_cells.join(F.broadcast(middle), "column")  # one row for each column
    return out.select(
        "column", "n", "minimum", "maximum", "mean", "median", "std", "q1", "q3", "zeros", "negatives", "skew"
    )


def categorical_stats(df: DataFrame, columns: Sequence[str], top: int = TOP_VALUES) -> DataFrame:
    """Distinct values, imbalance ratio and the most frequent values of each column."""
    counts = value_counts(df, columns)
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    # Only ``top`` rows of a column survive the map side, so the window stays small.
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    best = ranked.groupBy("column").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "value", "n"))),
            lambda r: F.struct(r["value"].alias("value"), r["n"].alias("n")),
        ).alias("top")
    )
    shape = counts.groupBy("column").agg(
        F.count("*").alias("distinct"),
        F.sum("n").alias("n"),
        F.max("n").alias("max_n"),
        F.min("n").alias("min_n"),
        F.when(F.count("*") > 1, F.max("n") / F.min("n")).alias("imbalance_ratio"),
    )
    return shape.join(F.broadcast(best), "column", "left")  # one row for each column


def text_facts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lengths, blanks, numbers and texts shaped like dates, from the whole values of each text column."""
    return stacked(
        df,
        {c: F.col(ident(c)) for c in columns},
        lambda c: {
            "n": F.count(c),
            "min_length": F.min(F.char_length(c)),
            "max_length": F.max(F.char_length(c)),
            "mean_length": F.avg(F.char_length(c)),
            "empty_strings": F.count_if(strip(c) == ""),
            "numeric_text": (F.count(c) > 0) & (F.count_if(c.isNotNull() & lenient_double(c).isNull()) == 0),
            "shaped": F.count_if(c.rlike(dates.SHAPE)),
        },
        "string",
    ).drop("at")


def text_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Character lengths and blank strings of each text column."""
    return text_facts(df, list(columns or columns_where(df, is_string))).drop("numeric_text", "shaped")


def temporal_stats(df: DataFrame, formats: Mapping[str, str | None]) -> DataFrame:
    """Earliest, latest and distinct values. ``formats`` maps a column to its text format or None."""
    parsed = df.select(
        *[
            (F.col(ident(c)) if fmt is None else dates.parse_date(F.col(ident(c)), fmt)).alias(c)
            for c, fmt in formats.items()
        ]
    )
    names = list(formats)
    ends = wide(parsed, names, lambda c: {"earliest": F.min(c).cast("string"),
                                          "latest": F.max(c).cast("string")})
    distinct = nulls_distinct(parsed, names).select("column", "distinct")
    return ends.join(distinct, "column")


def date_scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For each text column and date format: values parsed, and the range of years.

    Works on counted values, so a date that occurs a million times is parsed once.
    """
    tries = F.array(
        *[
            F.struct(F.lit(fmt).alias("format"), F.year(dates.parse_date(F.col("value"), fmt)).alias("year"))
            for fmt, _ in dates.FORMATS
        ]
    )
    shaped = value_counts(df, columns).where(F.col("value").rlike(dates.SHAPE))
    parsed = shaped.select("column", "n", F.inline(F.filter(tries, lambda t: t["year"].isNotNull())))
    return parsed.groupBy("column", "format").agg(
        F.sum("n").alias("parsed"), F.min("year").alias("min_year"), F.max("year").alias("max_year")
    )


def detect_dates(
    df: DataFrame, columns: Sequence[str] | None = None, *, facts: DataFrame | None = None
) -> DataFrame:
    """(column, format, ambiguous) of the text columns that hold dates.

    Only columns in which enough values have the shape of a date are counted and parsed; ``facts`` are their
    :func:`text_facts` if the caller has them.
    """
    columns = list(columns or columns_where(df, is_string))
    sizes = pin(facts if facts is not None else text_facts(df, columns)).select("column", "n", "shaped")
    enough = (F.col("n") >= dates.MIN_VALUES) & (F.col("shaped") / F.col("n") >= dates.MATCH_SHARE)
    likely = [r["column"] for r in sizes.where(enough).collect()]
    if not likely:
        return df.sparkSession.createDataFrame([], "column string, format string, parsed long, ambiguous boolean")
    fits = date_scores(df, likely).join(F.broadcast(sizes), "column").where(  # one row for each column
        (F.col("parsed") / F.col("n") >= dates.MATCH_SHARE)
        & (F.col("min_year") >= dates.MIN_YEAR)
        & (F.col("max_year") <= dates.MAX_YEAR)
    )
    position = F.array_position(F.array(*[F.lit(f) for f, _ in dates.FORMATS]), F.col("format"))
    swapped = F.translate("format", "dm", "md")
    best = fits.groupBy("column").agg(
        F.max_by(F.struct("format", "parsed", swapped.alias("rival")), F.struct("parsed", -position))
        .alias("best"),
        F.collect_list(F.struct("format", "parsed")).alias("all"),
    )
    has_rival = F.col("best.format").rlike("^(%m/%d|%d/%m)")
    return best.select(
        "column",
        F.col("best.format").alias("format"),
        F.col("best.parsed").alias("parsed"),
        (
            has_rival
            & F.exists("all", lambda s: (s["format"] == F.col("best.rival"))
                       & (s["parsed"] == F.col("best.parsed")))
        ).alias("ambiguous"),
    )


def numeric_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Whether every value of a text column is a number."""
    return text_facts(df, list(columns or columns_where(df, is_string))).select("column", "numeric_text")


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson coefficient of every pair of numeric columns over the rows that have both.

    Columns are centred, and each task adds up one matrix of products, sums, squares and counts over all pairs, so one
    scan and one plan of constant size serve any width; what is shuffled is one row for each pair and task. A pair with
    a constant side has no coefficient and is left out; one that meets a value that is not finite is NaN.
    """
    columns = list(columns or columns_where(df, is_numeric))
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    xs = [F.col(ident(c)).cast("double") for c in columns]
    finite = [F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x) for x in xs]
    centres = df.agg(*[F.avg(x) for x in finite]).first()
    cells = F.array(*[x - F.lit(m if m is not None else 0.0) for x, m in zip(xs, centres)])
    width = len(columns)
    fields = ["n", "sx", "sy", "sxx", "syy", "sxy", "bad"]

    def products(batches):
        i, j = np.triu_indices(width, 1)
        total = np.zeros((len(fields), len(i)))
        for batch in batches:
            flat = batch.column(0).flatten()
            present = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, width)
            x = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, width)
            there, odd = present.astype(float), ~np.isfinite(x)
            x = np.where(odd, 0.0, x)
            sums, squares, strange = x.T @ there, (x * x).T @ there, odd.astype(float).T @ there
            total += [
                (there.T @ there)[i, j], sums[i, j], sums[j, i], squares[i, j], squares[j, i], (x.T @ x)[i, j],
                strange[i, j] + strange[j, i],
            ]
        columns_out = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(t) for t in total]]
        yield pa.RecordBatch.from_arrays(columns_out, ["i", "j", *fields])

    parts = df.select(cells.alias("x")).mapInArrow(products, "i int, j int" + "".join(f", {f} double" for f in fields))
    s = {f: F.col(f) for f in fields}
    by_pair = parts.groupBy("i", "j").agg(*[F.sum(f).alias(f) for f in fields])
    vx, vy = s["n"] * s["sxx"] - s["sx"] * s["sx"], s["n"] * s["syy"] - s["sy"] * s["sy"]
    varied = (vx > CONSTANT * s["n"] * s["sxx"]) & (vy > CONSTANT * s["n"] * s["syy"])
    r = (s["n"] * s["sxy"] - s["sx"] * s["sy"]) / (F.sqrt(F.when(varied, vx)) * F.sqrt(F.when(varied, vy)))
    names = F.array(*map(F.lit, columns))
    return by_pair.select(
        F.get(names, F.col("i")).alias("a"),
        F.get(names, F.col("j")).alias("b"),
        F.when(s["bad"] > 0, F.lit(float("nan")))
        .when(varied, F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))  # these two skip nulls, hence the test
        .alias("r"),
    ).where(F.col("r").isNotNull())
