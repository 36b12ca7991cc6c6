"""Detection and loading of generated files; one catalogue job for the whole folder."""

import gzip
import io
import itertools
import json
import random
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tablewise.sources import catalogue as C
from tablewise.sources import loaders as L
from tablewise.sources import sinks

HEAD = ["region", "units", "revenue"]
ROWS = [["North", "12", "104.50"], ["South", "7", "88.25"], ["East", "19", "203.00"], ["West", "3", "12.75"], ["Mid", "5", "44.10"]]


def text(sep=",", rows=ROWS, head=HEAD, end="\n"):
    lines = [sep.join(r) for r in ([head] if head else []) + rows]
    return end.join(lines) + end


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def parquet_bytes():
    out = io.BytesIO()
    pq.write_table(pa.table({"region": ["N", "S"], "units": [1, 2]}), out)
    return out.getvalue()


def arrow_bytes():
    out = io.BytesIO()
    table = pa.table({"region": ["N", "S"], "units": [1, 2]})
    with pa.ipc.new_file(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue()


COMMA = [["Süd", "12", "104,50"], ["Nörd", "7", "88,25"], ["Ost", "19", "203,00"], ["West", "3", "12,75"]]
DOTTED = [["A", "1.234,50"], ["B", "12.345,00"], ["C", "2.000,10"], ["D", "9.876,54"]]
KEYED = {k: {"Type": t, "Base": b} for k, t, b in (("Abo", "ice", 1), ("Sta", "air", 2), ("Cha", "fire", 3))}
RECORDS = [{"region": "N", "units": 1}, {"region": "S", "units": 2}, {"region": "E", "units": None}]

# name -> (content, format, compression, confident)
FILES = {
    "plain.csv": (text().encode(), "csv", "none", True),
    "bom.csv": (b"\xef\xbb\xbf" + text().encode(), "csv", "none", True),
    "european.csv": (text(";", COMMA).encode("cp1252"), "csv", "none", True),
    "dotted.csv": (text(";", DOTTED, ["kind", "value"]).encode(), "csv", "none", True),
    "tabs.tsv": (text("\t").encode(), "tsv", "none", True),
    "pipes.csv": (text("|").encode(), "csv", "none", True),
    "utf16.csv": (text(";").encode("utf-16"), "csv", "none", True),
    "comment.csv": (("# exported\n" + text()).encode(), "csv", "none", True),
    "windows.csv": (text(end="\r\n").encode(), "csv", "none", True),
    "headless.csv": (text(head=None, rows=[["1", "2", "3"], ["4", "5", "6"], ["7", "8", "9"], ["1", "1", "2"]]).encode(), "csv", "none", True),
    "table.parquet": (parquet_bytes(), "parquet", "none", True),
    "table.arrow": (arrow_bytes(), "arrow", "none", True),
    "lines.jsonl": ("\n".join(map(json.dumps, RECORDS)).encode(), "jsonl", "none", True),
    "array.json": (json.dumps(RECORDS).encode(), "json", "none", True),
    "pretty.json": (json.dumps(RECORDS, indent=2).encode(), "json", "none", True),
    "keyed.json": (json.dumps(KEYED).encode(), "json", "none", True),
    "cut.json": (json.dumps([{"x": "y" * 100}] * 200).encode(), "json", "none", False),
    "book.xlsx": (zipped({"[Content_Types].xml": "<a>spreadsheetml</a>"}), "excel", "none", True),
    "text.docx": (zipped({"[Content_Types].xml": "<a>wordprocessingml</a>"}), "zip", "zip", False),
    "sheet.ods": (zipped({"mimetype": "application/vnd.oasis.opendocument.spreadsheet"}), "ods", "none", True),
    "old.xls": (b"\xd0\xcf\x11\xe0" + bytes(100), "excel_legacy", "none", True),
    "data.db": (b"SQLite format 3\0" + bytes(100), "sqlite", "none", True),
    "packed.csv.gz": (gzip.compress(text().encode()), "csv", "gzip", True),
    "packed.parquet.gz": (gzip.compress(parquet_bytes()), "parquet", "gzip", True),
    "one.csv.zip": (zipped({"inner.csv": text()}), "csv", "zip", True),
    "lines.jsonl.zip": (zipped({"a.jsonl": "\n".join(map(json.dumps, RECORDS))}), "jsonl", "zip", True),
    "keyed.json.zip": (zipped({"a.json": json.dumps(KEYED, indent=1)}), "json", "zip", True),
    "two.zip": (zipped({"a.csv": "x", "b.csv": "y"}), "zip", "zip", True),
    "some.csv.zst": (b"\x28\xb5\x2f\xfd" + bytes(50), "csv", "zstd", False),
    "page.html": (b"<!DOCTYPE html><html><body>x</body></html>", "html", "none", True),
    "rows.xml": (b"<?xml version='1.0'?><rows><row><a>1</a></row><row><a>2</a></row></rows>", "xml", "none", True),
    "empty.csv": (b"", "unknown", "none", False),
    "wrongly.csv": (parquet_bytes(), "parquet", "none", True),
    "really_csv.parquet": (text().encode(), "csv", "none", True),
    "broken.gz": (b"\x1f\x8bnot gzip", "unknown", "gzip", False),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    for name, (content, *_) in FILES.items():
        (root / name).write_bytes(content)
    return root


@pytest.fixture(scope="module")
def specs(spark, folder):
    return {r["path"].rsplit("/", 1)[1]: r for r in C.catalogue(spark, str(folder)).collect()}


@pytest.mark.parametrize("name", FILES)
def test_format(specs, name):
    _, fmt, packed, confident = FILES[name]
    r = specs[name]
    assert (r["format"], r["compression"], r["is_confident"]) == (fmt, packed, confident), r


def test_dialects(specs):
    d = specs["european.csv"]["dialect"]
    assert (d["delimiter"], d["decimal"], d["thousands"], d["has_header"]) == (";", ",", None, True)
    assert specs["european.csv"]["encoding"] == "cp1252"
    d = specs["dotted.csv"]["dialect"]
    assert (d["decimal"], d["thousands"]) == (",", ".")
    assert specs["comment.csv"]["dialect"]["comment_prefix"] == "#"
    assert specs["comment.csv"]["dialect"]["has_header"]
    assert specs["windows.csv"]["dialect"]["line_terminator"] == "\r\n"
    assert not specs["headless.csv"]["dialect"]["has_header"]
    assert specs["bom.csv"]["encoding"] == "utf-8-sig" and specs["utf16.csv"]["encoding"] == "utf-16"


def test_contradictions_are_recorded(specs):
    assert "but the content is parquet" in " ".join(specs["wrongly.csv"]["warnings"])
    assert "but the content is csv" in " ".join(specs["really_csv.parquet"]["warnings"])
    assert specs["plain.csv"]["warnings"] == []


@pytest.mark.parametrize("name", ["plain.csv", "bom.csv", "pipes.csv", "tabs.tsv", "utf16.csv", "comment.csv",
                                  "windows.csv", "packed.csv.gz", "one.csv.zip"])
def test_delimited_files_load_alike(spark, specs, name):
    df = L.load(spark, specs[name])
    assert df.dtypes == [("region", "string"), ("units", "bigint"), ("revenue", "double")]
    got = sorted((r["region"], r["units"], r["revenue"]) for r in df.collect())
    assert got == sorted((a, int(b), float(c)) for a, b, c in ROWS)


def test_european_numbers_and_umlauts(spark, specs):
    df = L.load(spark, specs["european.csv"])
    assert dict(df.dtypes)["revenue"] == "double"
    assert {r["region"]: r["revenue"] for r in df.collect()}["Süd"] == 104.5


def test_thousands_stay_text(spark, specs):
    assert dict(L.load(spark, specs["dotted.csv"]).dtypes)["value"] == "string"


def test_headless_keeps_every_row(spark, specs):
    df = L.load(spark, specs["headless.csv"])
    assert df.columns == ["_c0", "_c1", "_c2"] and df.count() == 4


@pytest.mark.parametrize("name", ["table.parquet", "wrongly.csv", "table.arrow", "packed.parquet.gz"])
def test_binary_tables(spark, specs, name):
    got = sorted(tuple(r) for r in L.load(spark, specs[name]).select("region", "units").collect())
    assert got == [("N", 1), ("S", 2)]


@pytest.mark.parametrize("name", ["lines.jsonl", "array.json", "pretty.json", "lines.jsonl.zip"])
def test_json(spark, specs, name):
    assert sorted(r["region"] for r in L.load(spark, specs[name]).collect()) == ["E", "N", "S"]


@pytest.mark.parametrize("name", ["keyed.json", "keyed.json.zip"])
def test_keyed_records_become_rows(spark, specs, name):
    got = sorted((r["key"], r["Type"], r["Base"]) for r in L.load(spark, specs[name]).collect())
    assert got == [("Abo", "ice", 1), ("Cha", "fire", 3), ("Sta", "air", 2)]


def test_other_shapes_are_left_alone(spark):
    two = spark.sql("select struct(1 as a) as x, struct(1 as a) as y")
    mixed = spark.sql("select struct(1 as a) as x, struct(1 as b) as y, struct(1 as a) as z")
    taken = spark.sql("select struct(1 as key) as x, struct(1 as key) as y, struct(1 as key) as z")
    for df in (two, mixed, taken):
        assert L.unkey(df).columns == df.columns


KEYED = {
    "three": ('{"a": {"x": 1, "y": "p\\n\\"q\\""}, "b }": {"y": "}", "x": 2.5}, "c\\"\\\\": {"x": 3, "y": null}}', [('a', 1.0, 'p\n"q"'), ("b }", 2.5, "}"), ('c"\\', 3.0, None)]),
    "two": ('{"a": {"x": 1}, "b": {"x": 2}}', None),
    "other fields": ('{"a": {"x": 1}, "b": {"z": 2}, "c": {"x": 3}}', None),
    "not a record": ('{"a": {"x": 1}, "b": {"x": 2}, "c": {"x": 3}, "d": 4}', None),
    "has key": ('{"a": {"key": 1}, "b": {"key": 2}, "c": {"key": 3}}', None),
    "array": ('[{"x": 1}, {"x": 2}, {"x": 3}]', None),
}


@pytest.mark.parametrize("name", KEYED)
def test_keyed_documents(spark, tmp_path, name):
    text, want = KEYED[name]
    (tmp_path / "d.json").write_text(text)
    df = L.load_document(spark, str(tmp_path))
    if want is None:
        plain = spark.read.option("multiLine", True).json(str(tmp_path))
        assert df.schema == plain.schema and df.collect() == plain.collect()
    else:
        assert df.columns == ["key", "x", "y"] and sorted(map(tuple, df.collect())) == want


def test_a_document_with_many_keys(spark, tmp_path):
    n = 200_000
    with (tmp_path / "d.json").open("w") as f:
        f.write("{" + ",\n".join(f'"k{i}": {{"v": {i}, "w": "t{i % 7}"}}' for i in range(n)) + "}")
    df = L.load_document(spark, str(tmp_path))
    assert df.dtypes == [("key", "string"), ("v", "bigint"), ("w", "string")] and df.rdd.getNumPartitions() > 1
    assert df.agg(F.count("*"), F.sum("v"), F.count_distinct("key")).first() == (n, n * (n - 1) // 2, n)


def test_xml_loads(spark, specs):
    assert sorted(r["a"] for r in L.load(spark, specs["rows.xml"]).collect()) == [1, 2]


@pytest.mark.parametrize("name", ["book.xlsx", "data.db", "two.zip", "page.html", "empty.csv", "some.csv.zst"])
def test_refusals_name_a_reason(spark, specs, name):
    with pytest.raises(L.UnsupportedFormat, match=".+"):
        L.load(spark, specs[name])


def test_dates_and_mixed_text_stay_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("d,m,b,e\n2024-01-31,1,true,\n2024-02-01,x,False,\n")
    df = L.load_delimited(spark, str(tmp_path / "a.csv"), {})
    assert dict(df.dtypes) == {"d": "string", "m": "string", "b": "boolean", "e": "string"}


def test_dialect_round_trip(spark, tmp_path):
    """Delimiter x decimal x encoding x line ending, found again by one catalogue job."""
    rng = random.Random(5)
    want = {}
    options = itertools.product([",", ";", "\t", "|"], [".", ","], ["utf-8", "cp1252"], ["\n", "\r\n"])
    for i, (sep, dec, enc, end) in enumerate(options):
        if sep == "," and dec == ",":
            continue
        rows = [[rng.choice(["Köln", "Bonn", "Ulm"]), str(rng.randint(1, 99)), f"{rng.randint(1, 99)}{dec}{rng.randint(10, 99)}"]
                for _ in range(rng.randint(6, 10))]
        rows[0][0] = "Köln"
        (tmp_path / f"f{i}.csv").write_bytes(text(sep, rows, end=end).encode(enc))
        want[f"f{i}.csv"] = (sep, dec, enc, end)
    for r in C.catalogue(spark, str(tmp_path)).collect():
        d = r["dialect"]
        assert (d["delimiter"], d["decimal"], r["encoding"], d["line_terminator"]) == want.pop(r["path"].rsplit("/", 1)[1])
    assert not want


def test_arrow_and_findings_sinks(spark, tmp_path):
    df = spark.range(1000).repartition(3)
    assert sinks.write_arrow(df, f"file://{tmp_path}/a") == 1000
    assert L.load_arrow(spark, f"{tmp_path}/a").count() == 1000
    one = spark.createDataFrame([("h1", "q")], "card_hash string, question string")
    sinks.append_findings(one, f"{tmp_path}/f")
    sinks.append_findings(one, f"{tmp_path}/f")
    assert spark.read.parquet(f"{tmp_path}/f").count() == 2


def test_findings_of_a_run_are_added_once(spark, tmp_path):
    def rows(*places, run="r1", card="c"):
        return spark.createDataFrame([(card, run, p, f"q{p}") for p in places], "card_hash string, run string, place int, question string")

    path = f"{tmp_path}/f"
    assert sinks.append_findings(rows(1, 2), path) == 2
    assert sinks.append_findings(rows(1, 2, 3, 3), path) == 1  # the run failed after two and is run again
    assert sinks.append_findings(rows(1, 2, 3), path) == 0
    assert sinks.append_findings(rows(1, run="r2", card="d"), path) == 1
    got = sorted((r["run"], r["place"]) for r in spark.read.parquet(path).collect())
    assert got == [("r1", 1), ("r1", 2), ("r1", 3), ("r2", 1)]
