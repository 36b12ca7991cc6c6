"""Load a catalogued source as a DataFrame."""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from tablewise.functions.numeric import PLAIN_NUMBER
from tablewise.functions.text import strip
from tablewise.functions.types import ident, is_string
from tablewise.operators.stats import wide
from tablewise.session import ship_package
from tablewise.sources import quoted, readers
from tablewise.sources.catalogue import CP1252, decode_cp1252
from tablewise.sources.sinks import scratch

KEY = "key"
MIN_KEYED_RECORDS = 3
#: Why a format that is recognised cannot be loaded.
REFUSED = {
    "excel": "spreadsheets are parsed one file at a time, which Spark cannot split; export to CSV or Parquet",
    "excel_legacy": "spreadsheets are parsed one file at a time, which Spark cannot split; export to CSV or Parquet",
    "ods": "save the spreadsheet as CSV or Parquet",
    "sqlite": "read databases through spark.read.jdbc",
    "duckdb": "read databases through spark.read.jdbc",
    "html": "no reader for HTML tables",
    "hdf5": "no reader for HDF5",
    "spss": "no reader for SPSS files",
    "stata": "no reader for Stata files",
    "sas": "no reader for SAS files",
    "zip": "point at one member of the archive",
    "unknown": "the format could not be determined",
}


class UnsupportedFormat(ValueError):
    """The source was recognised but cannot be loaded."""


def load(spark: SparkSession, spec: Row | Mapping[str, Any], *, row_tag: str = "row") -> DataFrame:
    """Load the source that a catalogue row describes."""
    spec = spec.asDict(recursive=True) if isinstance(spec, Row) else dict(spec)
    fmt, packed, path = spec["format"], spec.get("compression", "none"), spec["path"]
    if fmt in REFUSED:
        raise UnsupportedFormat(f"{fmt}: {REFUSED[fmt]}")
    if packed == "zstd":
        raise UnsupportedFormat("zstd-compressed: decompress it first")
    if packed == "gzip" and fmt != "parquet" and _misnamed(spark, path):
        packed = "zip"  # unpacked by content; Spark would go by the name
    if fmt in ("csv", "tsv"):
        return load_delimited(spark, path, spec.get("dialect") or {}, spec.get("encoding") or "utf-8", packed)
    if fmt == "arrow" or (packed in ("gzip", "zip") and fmt == "parquet"):
        return load_arrow(spark, path, fmt)
    if packed == "zip":
        return _load_zipped_json(spark, path, fmt, spec.get("encoding") or "utf-8")
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "jsonl":
        return spark.read.json(path)
    if fmt == "json":
        return load_document(spark, path)
    if fmt == "orc":
        return spark.read.orc(path)
    if fmt == "xml":
        return spark.read.option("rowTag", row_tag).xml(path)
    raise UnsupportedFormat(f"{fmt}: no reader")


def _misnamed(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether there are files whose name does not say that they are packed with gzip."""
    files = spark.read.format("binaryFile").load(path).select("path")
    return not files.where(~F.col("path").endswith(".gz")).isEmpty()


# ---- delimited text ------------------------------------------------------------------------------


def load_delimited(
    spark: SparkSession,
    path: str | list[str],
    dialect: Mapping[str, Any],
    encoding: str = "utf-8",
    compression: str = "none",
    *,
    narrow_types: bool = True,
) -> DataFrame:
    """Every column as text first, then narrowed by one aggregate; dates stay text."""
    sep = dialect.get("delimiter") or ","
    quote = dialect.get("quotechar") or '"'
    header = dialect.get("has_header", True)
    if compression == "zip":
        df = _split_lines(unzip_lines(spark, path, encoding, quote), sep, quote, header, dialect.get("comment_prefix"))
    else:
        charset, wide_chars = _spark_encoding(encoding)
        comment = dialect.get("comment_prefix")
        reader = spark.read.options(sep=sep, quote=quote, escape=quote, header=header, encoding=charset)
        if comment:
            reader = reader.option("comment", comment)
        splits = None if wide_chars else quoted.functions(spark, path, sep, quote, charset)
        if splits is None:  # 16 and 32 bit characters: such files are not split, and their records are kept whole
            df = reader.option("multiLine", True).csv(path)
        elif splits.where("broken").isEmpty():  # every record is a line
            df = reader.csv(path)
        else:
            found = quoted.records(spark, path, splits, sep, quote, charset)
            found = found.withColumn("value", F.regexp_replace("value", "\r\\z", ""))
            df = _split_lines(found, sep, quote, header, comment)
        if encoding == "cp1252":
            df = df.select(
                *[decode_cp1252(F.col(ident(c))).alias(_cp1252_name(c)) for c in df.columns]
            )
    if header:
        df = df.withColumnsRenamed({c: c.removeprefix("﻿") for c in df.columns})
    return narrow(df, dialect.get("decimal") or ".") if narrow_types else df


def _spark_encoding(encoding: str) -> tuple[str, bool]:
    known = {"ascii": "UTF-8", "utf-8": "UTF-8", "utf-8-sig": "UTF-8", "utf-16": "UTF-16", "utf-32": "UTF-32"}
    return known.get(encoding, "ISO-8859-1"), encoding in ("utf-16", "utf-32")


def _cp1252_name(name: str) -> str:
    return name.translate(CP1252)


def narrow(df: DataFrame, decimal: str = ".") -> DataFrame:
    """Text columns become bigint, double or boolean where every value allows it.

    Written with a decimal comma, ``1.234,5`` is left as text: only the comma is replaced.
    """
    texts = [f.name for f in df.schema.fields if is_string(f.dataType)]
    if not texts:
        return df

    def number(c: Column) -> Column:
        return F.replace(c, F.lit(","), F.lit(".")) if decimal == "," else c

    def fields(c: Column) -> dict[str, Column]:
        x = number(c)
        return {
            "n": F.count(c),
            "whole": F.count_if(c.rlike(r"^[+-]?\d{1,18}$")),
            "real": F.count_if(x.rlike(PLAIN_NUMBER)),
            "truth": F.count_if(F.lower(c).isin("true", "false")),
        }

    kinds = {r["column"]: r for r in wide(df, texts, fields).collect()}

    def typed(name: str) -> Column:
        c, k = F.col(ident(name)), kinds.get(name)
        if k is None or k["n"] == 0:
            return c
        if k["whole"] == k["n"]:
            return c.cast("bigint").alias(name)
        if k["real"] == k["n"]:
            return number(c).cast("double").alias(name)
        return c.cast("boolean").alias(name) if k["truth"] == k["n"] else c

    return df.select(*[typed(c) for c in df.columns])


def unzip_lines(spark: SparkSession, path: str, encoding: str = "utf-8", quote: str | None = None) -> DataFrame:
    """(path, line, value) of each packed file, one task for each; with ``quote``, of its records."""
    ship_package(spark)
    paths = spark.read.format("binaryFile").load(path).select("path")
    return paths.mapInPandas(partial(readers.packed_lines, encoding=encoding, quote=quote), "path string, line long, value string")


def _load_zipped_json(spark: SparkSession, path: str, fmt: str, encoding: str) -> DataFrame:
    """Unpacked to shared storage first, so that records are then read in parallel."""
    lines, folder = unzip_lines(spark, path, encoding), scratch(spark, "unzipped")
    if fmt == "jsonl":
        lines.select("value").write.text(folder)
        return spark.read.json(folder)
    whole = lines.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "value"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["value"]), " ")
    whole.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return load_document(spark, folder)


def _split_lines(lines: DataFrame, sep: str, quote: str, header: bool, comment: str | None) -> DataFrame:
    lines = lines.where(F.length("value") > 0)
    if comment:
        lines = lines.where(~F.col("value").startswith(comment))
    first = lines.orderBy("path", "line").first()
    if first is None:
        return lines.select("value")
    options = {"sep": sep, "quote": quote, "escape": quote, "multiLine": "true"}  # line breaks in quotes stay as they are
    probe = lines.sparkSession.createDataFrame([(first["value"],)], "value string")
    # One line, read with room for as many fields as it could hold.
    room = first["value"].count(sep) + 1
    schema = ", ".join(f"f{i} string" for i in range(room))
    cells = probe.select(F.from_csv("value", F.lit(schema), options).alias("r")).first()["r"]
    names = [c for c in cells if c is not None] if header else [f"_c{i}" for i in range(room)]
    if header:
        heads = lines.groupBy("path").agg(F.min("line").alias("line"))
        lines = lines.join(F.broadcast(heads), ["path", "line"], "left_anti")  # one row for each file
    target = ", ".join(f"{ident(n)} string" for n in names)
    return lines.select(F.from_csv("value", F.lit(target), options).alias("r")).select("r.*")


# ---- Arrow and packed Parquet --------------------------------------------------------------------


def load_arrow(spark: SparkSession, path: str, fmt: str = "arrow") -> DataFrame:
    """Arrow IPC files (or packed Parquet), one task for each file, batch by batch."""
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("path")
    first = files.orderBy("path").first()
    if first is None:
        raise FileNotFoundError(path)
    schema = from_arrow_schema(readers.arrow_schema(first["path"], fmt))
    names = [f.name for f in schema.fields]
    return files.mapInArrow(partial(readers.arrow_batches, fmt=fmt, names=names), schema)


# ---- keyed JSON ----------------------------------------------------------------------------------


def load_document(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON documents: rows of an array, or the records of one document that is keyed by an identifier.

    Whether a document is keyed is decided on its records as rows, with the test of :func:`unkey`; no schema names the keys, so
    plans have one size for ten records and for millions. The document is parsed by one task, as no JSON document can be
    split; its records are then lines on shared storage, which all later work reads in parallel.
    """
    documents = spark.read.text(path, wholetext=True)
    records = documents.select(F.explode(F.from_json("value", "map<string,string>")).alias(KEY, "record"))
    names = F.sort_array(F.json_object_keys("record"))
    facts = records.select("record", names.alias("names")).agg(
        F.count("*").alias("n"),
        F.count_if(F.coalesce(F.col("record").startswith("{"), F.lit(False))).alias("objects"),
        F.count_if((F.size("names") > 0) & ~F.array_contains("names", KEY)).alias("fit"),
        F.count_distinct("names").alias("shapes"),
    ).first()
    keyed = facts["n"] == facts["objects"] == facts["fit"] and facts["n"] >= MIN_KEYED_RECORDS and facts["shapes"] == 1
    if not keyed or documents.select(F.lit(1)).limit(2).count() > 1:
        return spark.read.option("multiLine", True).json(path)
    folder = scratch(spark, "records")
    # {"key": "...", and the fields of the record
    start = F.expr(f"""regexp_replace(to_json(named_struct('{KEY}', {KEY})), '\\\\}}$', ',')""")
    records.select(F.concat(start, F.substr("record", F.lit(2))).alias("value")).repartition(spark.sparkContext.defaultParallelism).write.text(folder)
    out = spark.read.json(folder)
    return out.select(KEY, *[ident(c) for c in out.columns if c != KEY])


def unkey(df: DataFrame) -> DataFrame:
    """Records keyed by an identifier become rows with a ``key`` column.

    Claimed only when it is unmistakable: one row, three or more struct columns, all with the same
    fields, none called ``key``. The test reads the schema; anything else is returned as it was.
    """
    fields = df.schema.fields
    if len(fields) < MIN_KEYED_RECORDS or not all(isinstance(f.dataType, T.StructType) for f in fields):
        return df
    names = {tuple(f.dataType.fieldNames()) for f in fields}
    if len(names) != 1:
        return df
    inner = next(iter(names))
    if not inner or KEY in inner or len(df.limit(2).take(2)) != 1:
        return df
    common = {n: _widest([f.dataType[n].dataType for f in fields]) for n in inner}
    records = [
        F.when(
            F.col(ident(f.name)).isNotNull(),
            F.struct(
                F.lit(f.name).alias(KEY),
                *[F.col(ident(f.name))[n].cast(common[n]).alias(n) for n in inner],
            ),
        )
        for f in fields
    ]
    return df.select(F.inline(F.array_compact(F.array(*records))))


def _widest(kinds: list[T.DataType]) -> T.DataType:
    if all(k == kinds[0] for k in kinds):
        return kinds[0]
    return T.DoubleType() if all(isinstance(k, T.NumericType) for k in kinds) else T.StringType()


def decimal_comma(text: Column) -> Column:
    """A number written with a decimal comma; other text becomes null."""
    number = F.replace(strip(text), F.lit(","), F.lit("."))
    return F.when(number.rlike(PLAIN_NUMBER), number.try_cast("double"))
