"""What tasks do with a single file: open it, look through its container, read the first bytes."""

from __future__ import annotations

import csv
import gzip
import zipfile
from collections.abc import Iterator

import pandas as pd

SAMPLE_BYTES = 8192
DELIMITERS = ",;\t|:"


def open_file(path: str):
    """A seekable file on any storage that Arrow knows."""
    from pyarrow import fs

    found, name = fs.FileSystem.from_uri(path)
    return found.open_input_file(name)


def _head(path: str) -> tuple[bytes, str, str, str]:
    """(first bytes of the payload, wrapper, what a container declares, note)."""
    with open_file(path) as f:
        head = f.read(SAMPLE_BYTES)
        f.seek(0)
        if head.startswith(b"\x1f\x8b"):
            try:
                return gzip.GzipFile(fileobj=f).read(SAMPLE_BYTES), "gzip", "", ""
            except (OSError, EOFError) as e:
                return b"", "gzip", "broken", f"gzip stream cannot be read: {e}"
        if head.startswith(b"\x28\xb5\x2f\xfd"):
            return b"", "zstd", "opaque", "zstd payload not inspected"
        if head.startswith(b"PK\x03\x04"):
            try:
                return _zip_head(zipfile.ZipFile(f))
            except (zipfile.BadZipFile, OSError) as e:
                return b"", "zip", "broken", f"zip archive cannot be opened: {e}"
    return head, "none", "", ""


def _zip_head(archive: zipfile.ZipFile) -> tuple[bytes, str, str, str]:
    names = archive.namelist()
    for member in ("[Content_Types].xml", "mimetype"):
        if member in names:
            declared = archive.read(member)
            if b"opendocument.spreadsheet" in declared:
                return b"", "none", "ods", ""
            if b"spreadsheetml" in declared and member != "mimetype":
                return b"", "none", "excel", ""
            return b"", "zip", "document", "container is not a spreadsheet"
    members = [n for n in names if not n.endswith("/")]
    if len(members) != 1:
        return b"", "zip", "members", f"archive holds {len(members)} members; pick one"
    with archive.open(members[0]) as m:
        return m.read(SAMPLE_BYTES), "zip", "", f"format taken from member {members[0]}"


def read_heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, length) to (path, length, head, wrapper, inner, note)."""
    for frame in frames:
        rows = []
        for path, length in zip(frame["path"], frame["length"]):
            try:
                rows.append((path, length, *_head(path)))
            except OSError as e:
                rows.append((path, length, b"", "none", "broken", f"cannot be read: {e}"))
        yield pd.DataFrame(rows, columns=["path", "length", "head", "wrapper", "inner", "note"])


def csv_opinion(text: pd.Series, lines: pd.Series) -> pd.DataFrame:
    """Delimiter and header as the standard library's sniffer sees them; null where it gives up."""

    def ask(sample, question):
        try:
            return question(csv.Sniffer(), sample) if isinstance(sample, str) else None
        except csv.Error:
            return None

    return pd.DataFrame(
        {
            "delimiter": [ask(t, lambda s, x: s.sniff(x, delimiters=DELIMITERS).delimiter) for t in text],
            "header": [ask(x, lambda s, y: s.has_header(y)) for x in lines],
        },
        dtype=object,
    )
