"""Catalogue a folder of files: format, encoding, dialect and confidence of each, in one job.

Tasks read the first 8 KB of a file (through the container, if it is one); what those bytes mean is
decided with column expressions over all files at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.functions.text import let, strip
from tablewise.session import ship_package
from tablewise.sources.heads import SAMPLE_BYTES, csv_opinion, read_heads

# Sizes, extensions, signatures, confidences and the shapes of written numbers.
PROBE_LINES = 50
DELIMITERS = (",", ";", "\t", "|", ":")
CONFIDENT = 0.8
EXTENSIONS = {
    "csv": "csv", "tsv": "tsv", "txt": "csv", "xlsx": "excel", "xlsm": "excel", "xls": "excel_legacy",
    "ods": "ods", "parquet": "parquet", "feather": "arrow", "arrow": "arrow", "orc": "orc",
    "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "xml": "xml", "html": "html", "htm": "html",
    "sqlite": "sqlite", "db": "sqlite", "duckdb": "duckdb", "sav": "spss", "dta": "stata",
    "sas7bdat": "sas", "h5": "hdf5", "hdf5": "hdf5",
}
COMPRESSIONS = {"gz": "gzip", "gzip": "gzip", "zst": "zstd", "zstd": "zstd", "zip": "zip"}
SIGNATURES = {
    "parquet": "PAR1".encode().hex(),
    "arrow": "ARROW1".encode().hex(),
    "orc": "ORC".encode().hex(),
    "sqlite": "SQLite format 3\0".encode().hex(),
    "excel_legacy": "d0cf11e0",
}
CONFIDENCE = {
    "magic": 0.99, "container": 0.97, "structured": 0.92, "agreed": 0.95, "disputed": 0.72,
    "extension": 0.55, "opaque": 0.45, "none": 0.1,
}
COMMA_THOUSANDS = r"^-?\d{1,3}(,\d{3})+(\.\d+)?$"
DOT_THOUSANDS = r"^-?\d{1,3}(\.\d{3})+(,\d+)?$"
COMMA_DECIMAL = r"^-?\d+,\d+$"
DOT_DECIMAL = r"^-?\d+\.\d+$"
#: cp1252 characters at 0x80-0x9F, where ISO-8859-1 has control codes.
CP1252 = {b: bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}

_HEAD_SCHEMA = "path string, length long, head binary, wrapper string, inner string, note string"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files under a path or glob. The content column is never read.

    A scan passes over empty files, so those are added from the file index.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = spark.createDataFrame([(name,) for name in files.inputFiles()], "uri string")
    plain = F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B")))
    every = named.select(F.regexp_replace(plain, "^file:/+", "file:/").alias("path"))
    found = every.join(files.select("path", "length"), "path", "left")
    return found.select("path", F.coalesce("length", F.lit(0)).alias("length"))


def decode_cp1252(text: Column) -> Column:
    """Text read as ISO-8859-1, corrected to cp1252."""
    return F.translate(text, "".join(map(chr, CP1252)), "".join(CP1252.values()))


def _decoded(df: DataFrame) -> DataFrame:
    """Adds ``encoding`` and ``text``: byte-order mark, then strict UTF-8, then cp1252, then latin-1."""
    code = F.hex("head")
    size = F.octet_length("head")
    utf8 = [F.substring(F.col("head"), F.lit(1), size - k).cast("string") for k in range(4)]
    # The sample may end inside a character.
    whole = F.when(F.is_valid_utf8(utf8[0]), utf8[0])
    for shorter in utf8[1:]:
        whole = whole.when((size >= SAMPLE_BYTES) & F.is_valid_utf8(shorter), shorter)
    latin = F.decode("head", "ISO-8859-1")
    undefined = code.rlike("^(..)*?(81|8D|8F|90|9D)")
    df = df.withColumn("_utf8", whole).withColumn(
        "encoding",
        F.when(code.startswith("EFBBBF"), "utf-8-sig")
        .when(code.startswith("FFFE0000"), "utf-32")
        .when(code.startswith("FFFE") | code.startswith("FEFF"), "utf-16")
        .when(F.col("_utf8").isNotNull(), F.when(F.col("_utf8").rlike(r"[^\x00-\x7F]"), "utf-8").otherwise("ascii"))
        .when(undefined, "latin-1")
        .otherwise("cp1252"),
    )
    body = F.substring(F.col("head"), F.lit(4), size).cast("string")
    # An odd byte at the end of the sample is half a character.
    even = F.substring(F.col("head"), F.lit(1), size - size % 2)
    text = (
        F.when(F.col("encoding") == "utf-8-sig", F.make_valid_utf8(body))
        .when(F.col("encoding") == "utf-16", F.decode(even, "UTF-16"))
        .when(F.col("encoding") == "utf-32", F.decode(F.substring(F.col("head"), F.lit(1), size - size % 4), "UTF-32"))
        .when(F.col("encoding").isin("utf-8", "ascii"), F.col("_utf8"))
        .when(F.col("encoding") == "cp1252", decode_cp1252(latin))
        .otherwise(latin)
    )
    return df.withColumn("text", text).drop("_utf8")


def content_lines(text: Column, comment: Column) -> Column:
    """Lines that count: not blank, not comments, at most 50, the last one left out as it may be cut."""
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: strip(x) != "")
    kept = F.filter(lines, lambda x: comment.isNull() | ~F.ltrim(x).startswith(comment))
    first = F.slice(kept, 1, PROBE_LINES)
    return F.when(F.size(first) > 2, F.slice(first, F.lit(1), F.size(first) - 1)).otherwise(first)


def outside_quotes(line: Column) -> Column:
    return F.when(line.contains('"'), F.regexp_replace(line, r'"[^"]*("|$)', "")).otherwise(line)


def occurrences(text: Column, char: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, char, F.lit("")))


def delimiter_vote(lines: Column) -> Column:
    """Of the delimiters that occur once a line or more, the one whose count varies least over an array of lines:
    struct of variance, negative mean, rank and delimiter; null without any."""

    def vote(bare: Column, rank: int, delimiter: str) -> Column:
        counts = F.transform(bare, lambda x: occurrences(x, F.lit(delimiter)).cast("double"))

        def judged(counts: Column) -> Column:
            n = F.nullif(F.size(counts).cast("double"), F.lit(0.0))
            mean = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) / n
            variance = F.aggregate(counts, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
            found = F.struct(variance.alias("variance"), (-mean).alias("m"), F.lit(rank).alias("i"), F.lit(delimiter).alias("delimiter"))
            return F.when(mean >= 1, found)

        return let(counts, judged)

    def votes(bare: Column) -> Column:
        return F.array_min(F.array_compact(F.array(*[vote(bare, i, d) for i, d in enumerate(DELIMITERS)])))

    return let(F.transform(lines, outside_quotes), votes)  # quoted text is taken out once for all delimiters


def number_convention(fields: Column, delimiter: Column) -> Column:
    """How the numbers in an array of data fields are written, by vote: struct of decimal sign and thousands sign (null: none)."""

    def hits(pattern: str) -> Column:
        return F.size(F.filter(fields, lambda f: f.rlike(pattern)))

    shapes = {"ct": COMMA_THOUSANDS, "dt": DOT_THOUSANDS, "cd": COMMA_DECIMAL, "dd": DOT_DECIMAL}

    def judged(v: Column) -> Column:
        grouped = (v["ct"] > 0) | (v["dt"] > 0)
        anglo = v["ct"] >= v["dt"]
        comma = (grouped & ~anglo) | (~grouped & (delimiter != ",") & (v["cd"] > v["dd"]))
        return F.struct(
            F.when(comma, ",").otherwise(".").alias("decimal"),
            F.when(grouped, F.when(anglo, ",").otherwise(".")).alias("thousands"),
        )

    return let(F.struct(*[hits(p).alias(k) for k, p in shapes.items()]), judged)


def data_fields(line: Column, delimiter: Column) -> Column:
    """Fields of a delimited line; a delimiter inside quotes does not split."""
    literal = F.concat(F.lit(r"\Q"), delimiter, F.lit(r'\E(?=(?:[^"]*"[^"]*")*[^"]*$)'))
    return F.transform(F.split(line, literal), lambda f: strip(F.regexp_replace(strip(f), '^"|"$', "")))


def _extension(path: Column) -> tuple[Column, Column]:
    """(format, compression) the file name suggests; a compression suffix is peeled first."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    outer = F.regexp_extract(name, r"\.([^.]+)$", 1)
    pack = F.create_map(*[F.lit(x) for kv in COMPRESSIONS.items() for x in kv])
    kind = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    packed = F.array_contains(F.map_keys(pack), outer)
    inner = F.when(packed, F.regexp_extract(name, r"\.([^.]+)\.[^.]+$", 1)).otherwise(outer)
    return F.try_element_at(kind, inner), F.coalesce(F.try_element_at(pack, outer), F.lit("none"))


def _looks_numeric(field: Column) -> Column:
    bare = strip(field)
    shapes = [DOT_DECIMAL, COMMA_DECIMAL, COMMA_THOUSANDS, DOT_THOUSANDS, r"^-*\d+$"]
    return bare.rlike("|".join(shapes))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file under ``path``."""
    return describe(list_files(spark, path))


def describe(files: DataFrame) -> DataFrame:
    """Catalogue the files of a (path, length) frame."""
    ship_package(files.sparkSession)
    heads = files.mapInPandas(read_heads, _HEAD_SCHEMA)
    ext, packed = _extension(F.col("path"))
    df = _decoded(heads.withColumns({"extension": ext, "name_compression": packed}))
    code = F.lower(F.hex("head"))
    magic = F.when(F.lit(False), F.lit(""))
    for fmt, signature in SIGNATURES.items():
        magic = magic.when(code.startswith(signature), fmt)
    body = F.regexp_replace("text", r"(?U)^\s+", "")
    lines = F.filter(F.split("text", r"\r\n|\r|\n"), lambda x: strip(x) != "")

    def parses(json: Column) -> Column:
        return F.try_parse_json(json).isNotNull()

    two = parses(F.get(lines, F.lit(0))) & parses(F.get(lines, F.lit(1)))
    declared = F.col("inner") != ""
    empty = F.col("length") == 0
    comment = F.when(F.ltrim(F.get(lines, F.lit(0))).startswith("#"), "#")
    df = df.withColumns({"_magic": magic, "_body": body, "comment_prefix": comment})
    shape = (
        F.when(empty, "empty")
        .when(declared, F.col("inner"))
        .when(F.col("_magic").isNotNull(), "magic")
        .when(F.col("_body") == "", "blank")
        .when(F.col("_body").startswith("<"), "markup")
        .when(F.col("_body").rlike(r"^[{\[]"), "json")
        .otherwise("delimited")
    )
    df = df.withColumn("_shape", shape)
    html = F.lower(F.substring("_body", 1, 512)).rlike("<html|<!doctype html")
    json_kind = F.when(F.coalesce(two, F.lit(False)), "jsonl").otherwise("json")
    complete = (json_kind == "jsonl") | parses(F.col("text"))
    df = df.withColumns({"_html": html, "_json": json_kind, "_complete": complete})
    df = df.withColumn(
        "_lines", F.when(F.col("_shape") == "delimited", content_lines(F.col("text"), F.col("comment_prefix")))
    )
    return _finish(_with_dialect(df))


def _with_dialect(df: DataFrame) -> DataFrame:
    """Delimiter, header, quotes and number convention of the delimited files.

    At most 50 lines of a file take part, so the lines of a file stay in its row.
    """
    df = df.withColumn("_vote", delimiter_vote(F.col("_lines")))
    df = df.withColumn("delimiter", F.col("_vote.delimiter"))
    joined = F.array_join("_lines", "\n")
    opinion = F.pandas_udf(csv_opinion, "struct<delimiter:string,header:boolean>")
    df = df.withColumn("_csv", opinion(F.when(F.col("_shape") == "delimited", F.col("text")), joined))
    fields = F.flatten(
        F.transform(F.slice("_lines", F.lit(2), F.greatest(F.size("_lines"), F.lit(1))),
                    lambda x: data_fields(x, F.col("delimiter")))
    )
    numbers = number_convention(fields, F.col("delimiter"))
    df = df.withColumn("_numbers", F.when(F.col("delimiter").isNotNull(), numbers))
    quotes = F.aggregate(
        "_lines", F.struct(F.lit(0).alias("s"), F.lit(0).alias("d")),
        lambda a, x: F.struct(
            (a["s"] + F.regexp_count(x, F.lit("'"))).alias("s"),
            (a["d"] + F.regexp_count(x, F.lit('"'))).alias("d"),
        ),
    )
    row = [F.transform(data_fields(F.get("_lines", F.lit(i)), F.coalesce("delimiter", F.lit(","))), _looks_numeric)
           for i in (0, 1)]
    numeric = [F.exists(r, lambda b: b) for r in row]
    fallback = F.when(F.size("_lines") < 2, True).otherwise(~numeric[0] & numeric[1])
    return df.withColumns(
        {
            "decimal": F.col("_numbers.decimal"),
            "thousands": F.col("_numbers.thousands"),
            "quotechar": F.when(
                F.col("delimiter").isNotNull(),
                F.when((quotes["s"] > quotes["d"]) & (quotes["s"] >= 2), "'").otherwise('"'),
            ),
            "has_header": F.when(F.col("_shape") == "delimited", F.coalesce("_csv.header", fallback)),
            "line_terminator": F.when(
                F.col("_shape") == "delimited", F.when(F.col("text").contains("\r\n"), "\r\n").otherwise("\n")
            ),
        }
    )


def _finish(df: DataFrame) -> DataFrame:
    """Format and confidence from the evidence, then reconciled with the file name."""
    conf = {k: F.lit(v) for k, v in CONFIDENCE.items()}
    shape, stable = F.col("_shape"), F.col("_vote.variance") == 0
    sniffed = F.col("_csv.delimiter")
    disputed = sniffed.isNotNull() & (sniffed != F.col("delimiter"))
    unknown = shape.isin("empty", "broken", "blank") | ((shape == "delimited") & (F.size("_lines") == 0))
    fmt = (
        F.when(unknown, "unknown")
        .when(shape == "opaque", F.coalesce("extension", F.lit("unknown")))
        .when(shape.isin("excel", "ods"), shape)
        .when(shape.isin("document", "members"), "zip")
        .when(shape == "magic", F.col("_magic"))
        .when(shape == "markup", F.when(F.col("_html"), "html").otherwise("xml"))
        .when(shape == "json", F.col("_json"))
        .when(F.col("delimiter") == "\t", "tsv")
        .otherwise("csv")
    )
    confidence = (
        F.when(shape == "empty", F.lit(0.0))
        .when(unknown, conf["none"])
        .when(shape == "opaque", F.when(F.col("extension").isNull(), conf["none"]).otherwise(conf["opaque"]))
        .when(shape.isin("excel", "ods", "members"), conf["container"])
        .when(shape == "document", conf["opaque"])
        .when(shape == "magic", conf["magic"])
        .when(shape == "markup", conf["structured"])
        .when(shape == "json", F.when(F.col("_complete"), conf["structured"]).otherwise(conf["opaque"]))
        .when(F.col("delimiter").isNull(), conf["extension"])
        .when(disputed | ~stable, conf["disputed"])
        .otherwise(conf["agreed"])
    )
    df = df.withColumns({"_format": fmt, "confidence": confidence})
    found, named = F.col("_format"), F.col("extension")
    differs = (
        named.isNotNull() & (found != "unknown") & (named != found)
        & ~(named.isin("csv", "tsv") & found.isin("csv", "tsv"))
    )
    weak = F.col("confidence") <= CONFIDENCE["extension"]
    warnings = F.array_compact(
        F.array(
            F.when(shape == "empty", "file is empty"),
            F.when(F.col("note") != "", F.col("note")),
            F.when(shape == "blank", "no printable content in the sample"),
            F.when(shape.isin("json", "markup", "delimited") & F.col("encoding").isin("cp1252", "latin-1"),
                   F.concat(F.lit("not UTF-8; read as "), F.col("encoding"))),
            F.when((shape == "json") & ~F.col("_complete"), "JSON is cut off by the sample"),
            F.when((shape == "delimited") & ~unknown & F.col("delimiter").isNull(), "no delimiter found; one column assumed"),
            F.when(disputed, F.concat(F.lit("the csv module suggests another delimiter: "), sniffed)),
            F.when((shape == "delimited") & ~disputed & ~stable, "the number of fields varies"),
            F.when(differs & weak, F.concat(F.lit("content unclear; taken as "), named)),
            F.when(differs & ~weak, F.concat(F.lit("named "), named, F.lit(" but the content is "), found)),
        )
    )
    dialect = F.when(
        (shape == "delimited") & ~unknown,
        F.struct(
            F.coalesce("delimiter", F.lit(",")).alias("delimiter"),
            F.coalesce("quotechar", F.lit('"')).alias("quotechar"),
            "has_header",
            F.coalesce("decimal", F.lit(".")).alias("decimal"),
            "thousands",
            "comment_prefix",
            "line_terminator",
        ),
    )
    return df.select(
        "path",
        "length",
        F.when(differs & weak, named).otherwise(found).alias("format"),
        F.when(shape.isin("markup", "json", "delimited", "blank"), F.col("encoding")).otherwise("utf-8").alias("encoding"),
        dialect.alias("dialect"),
        F.when(shape == "empty", F.col("name_compression")).otherwise(F.col("wrapper")).alias("compression"),
        "confidence",
        (F.col("confidence") >= CONFIDENT).alias("is_confident"),
        warnings.alias("warnings"),
    )


