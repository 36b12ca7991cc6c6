"""Delimited files with line breaks in quotes, cut into small splits, against a reader that takes each file whole."""

import csv
import io
import random

import pytest

from tablewise.sources import loaders as L
from tablewise.sources import quoted

SPLIT = "spark.sql.files.maxPartitionBytes"
COST = "spark.sql.files.openCostInBytes"


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in (SPLIT, COST)}
    spark.conf.set(SPLIT, "397")
    spark.conf.set(COST, "0")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def written(seed, sep=",", end="\n", rows=120):
    r = random.Random(seed)
    cells = ["plain", "", "two words", "a\nb", 'say "so"', '"', "\n\n", f"x{sep}y", "long\n" * 40, '""\n,"', "é\nü", "a\r\nb"]
    out = io.StringIO()
    writer = csv.writer(out, delimiter=sep, lineterminator=end)
    writer.writerow(["id", "one", "two"])
    table = [[f"r{i}", r.choice(cells), r.choice(cells)] for i in range(rows)]
    writer.writerows(table)
    return out.getvalue(), table


def rows_of(df):
    return sorted((r["id"], r["one"] or "", r["two"] or "") for r in df.collect())


@pytest.mark.parametrize(("seed", "sep", "end"), [(1, ",", "\n"), (2, ";", "\n"), (3, "|", "\r\n"), (4, ",", "\n")])
def test_splits_give_the_same_records(small_splits, tmp_path, seed, sep, end):
    want = []
    for i in range(3):
        text, table = written(10 * seed + i, sep, end)
        (tmp_path / f"{i}.csv").write_bytes(text.encode())
        want += [tuple(row) for row in table]
    path = f"{tmp_path}/*.csv"
    splits = quoted.functions(small_splits, path, sep, '"')
    assert splits.count() > 30 and not splits.where("broken").isEmpty()
    df = L.load_delimited(small_splits, path, {"delimiter": sep}, narrow_types=False)
    assert df.columns == ["id", "one", "two"] and rows_of(df) == sorted(want)
    found = quoted.records(small_splits, path, splits, sep, '"')
    assert found.rdd.getNumPartitions() > 3  # not one task for each file


def test_states_joined_by_a_shuffle(small_splits, tmp_path, monkeypatch):
    text, table = written(5)
    (tmp_path / "a.csv").write_bytes(text.encode())
    monkeypatch.setattr(quoted, "BROADCAST_SPLITS", 0)
    assert rows_of(L.load_delimited(small_splits, str(tmp_path), {}, narrow_types=False)) == sorted(map(tuple, table))


@pytest.mark.parametrize("text", [
    'id,one,two\nr1,5" pipe,x\nr2,"a\nb",y\nr3,6" pipe,"c\n"\n',  # quotes inside a field open nothing
    'id,one,two\nr1,"open to the end\n of the file,x',
    'id,one,two\nr1,"' + "\n" * 1500 + '",x\nr2,a,b',  # whole splits inside one record
])
def test_odd_files_are_read_as_spark_reads_them_whole(small_splits, tmp_path, text):
    (tmp_path / "a.csv").write_bytes(text.encode())
    whole = small_splits.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path))
    assert rows_of(L.load_delimited(small_splits, str(tmp_path), {}, narrow_types=False)) == rows_of(whole)


def test_files_without_broken_lines_need_no_second_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,one,two\nr1,"a, b",x\nr2,5" pipe,y\n')
    assert quoted.functions(spark, str(tmp_path), ",", '"').where("broken").isEmpty()
    assert rows_of(L.load_delimited(spark, str(tmp_path), {})) == [("r1", "a, b", "x"), ("r2", '5" pipe', "y")]


def test_line_states():
    inside = lambda line, start=False: quoted.ends_inside(line, start, ",", '"')
    assert inside('a,"b') and inside('"') and inside('"a""') and inside('x,"y""","z')
    assert not inside('a,b"') and not inside('""') and not inside('"a"b,c') and not inside("")
    assert inside("text", True) and inside('""', True) and not inside('"', True) and not inside('end",a', True) and inside('end","again', True)


def test_other_encodings(small_splits, tmp_path):
    text = 'id,one,two\nr1,"Süd\nOst",é\nr2,"5 €",ü\n' * 1
    (tmp_path / "a.csv").write_bytes(text.encode("cp1252"))
    df = L.load_delimited(small_splits, str(tmp_path), {}, "cp1252")
    assert rows_of(df) == [("r1", "Süd\nOst", "é"), ("r2", "5 €", "ü")]
