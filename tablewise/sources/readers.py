"""Readers that tasks run for formats Spark has no source for: one file at a time, in batches."""

from __future__ import annotations

import contextlib
import gzip
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

from tablewise.sources.heads import open_file

LINES = 10_000


@contextlib.contextmanager
def _unpacked(path: str):
    """The file, out of its gzip or one-member zip wrapper if it has one."""
    with open_file(path) as f:
        start = f.read(4)
        f.seek(0)
        if start.startswith(b"\x1f\x8b"):
            yield io.BytesIO(gzip.GzipFile(fileobj=f).read())
        elif start == b"PK\x03\x04":
            yield io.BytesIO(zipfile.ZipFile(f).read(only_member(zipfile.ZipFile(f))))
        else:
            yield f


def only_member(archive: zipfile.ZipFile) -> str:
    members = [n for n in archive.namelist() if not n.endswith("/")]
    if len(members) != 1:
        raise ValueError(f"zip: expected one member, found {len(members)}")
    return members[0]


def arrow_schema(path: str, fmt: str) -> pa.Schema:
    with _unpacked(path) as f:
        return pq.ParquetFile(f).schema_arrow if fmt == "parquet" else pa.ipc.open_file(f).schema


def arrow_batches(batches: Iterator[pa.RecordBatch], fmt: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with _unpacked(path) as f:
                if fmt == "parquet":
                    found = pq.ParquetFile(f).iter_batches()
                else:
                    reader = pa.ipc.open_file(f)
                    found = (reader.get_batch(i) for i in range(reader.num_record_batches))
                for rows in found:
                    yield rows.select(names)


@contextlib.contextmanager
def _stream(path: str):
    """The bytes inside a gzip file or a one-member archive, whatever the file is called."""
    with open_file(path) as f:
        magic = f.read(2)
        f.seek(0)
        if magic == b"\x1f\x8b":
            yield gzip.GzipFile(fileobj=f)
        else:
            with zipfile.ZipFile(f) as z, z.open(only_member(z)) as m:
                yield m


def packed_lines(frames: Iterator[pd.DataFrame], encoding: str, quote: str | None = None) -> Iterator[pd.DataFrame]:
    """Lines of packed files; with ``quote``, a record whose quotes are open goes on in the next line."""
    for frame in frames:
        for path in frame["path"]:
            with _stream(path) as m:
                start, lines, pending, open_quotes = 0, [], [], 0
                for line in io.TextIOWrapper(m, encoding=encoding, errors="replace", newline=""):
                    pending.append(line)
                    open_quotes ^= line.count(quote) & 1 if quote else 0
                    if open_quotes:
                        continue
                    lines.append("".join(pending).rstrip("\r\n"))
                    pending = []
                    if len(lines) == LINES:
                        yield _numbered(path, start, lines)
                        start, lines = start + LINES, []
                if pending:
                    lines.append("".join(pending).rstrip("\r\n"))
                yield _numbered(path, start, lines)


def _numbered(path: str, start: int, lines: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"path": path, "line": range(start, start + len(lines)), "value": lines})
