"""What the operators share: word splitting, rolling hashes, Arrow slices, and tables that cut lineage.

Functions of this package travel to the executors by value, so that no code has to be installed or
copied there.
"""

from __future__ import annotations

import sys
import uuid
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from tablewise.session import ensure_checkpoint_dir

#: Bytes of text that one step of vectorised work takes at once (a longer text is taken alone).
CHUNK = 4 << 20
#: Odd multiplier of the rolling hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


def by_value(name: str) -> None:
    """Send the functions of module ``name`` to executors with the task instead of by import."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back: lineage is cut, nothing is on one machine."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def discard(df: DataFrame) -> None:
    """Delete the folder of a table that ``store`` wrote and that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def pieces(batch: pa.RecordBatch, column: int = 0, limit: int = CHUNK):
    """Slices of a batch with about ``limit`` bytes in its text column; no text is cut."""
    n = batch.num_rows
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < n:
        base = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_pieces(texts: pa.Array, limit: int = CHUNK):
    for piece in pieces(pa.RecordBatch.from_arrays([texts], ["text"]), 0, limit):
        yield piece.column(0)


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def hash_words(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of several documents in one array, and the offsets of the documents."""
    offsets = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=offsets[1:])
    flat = np.empty(int(offsets[-1]), dtype=object)
    flat[:] = list(chain.from_iterable(words))
    if not len(flat):
        return np.empty(0, np.uint64), offsets
    return pd.util.hash_array(flat, categorize=False).astype(np.uint64), offsets


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """Hashes of any stretch of a word sequence from running sums: P[j] - P[i], shifted back by i."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers(BASE, n), out=self.sums[1:], dtype=np.uint64)
        self.back = powers(UNBASE, n + 1)

    def span(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.back[start])

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all stretches of ``k`` words, by start."""
        m = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:-k]) * self.back[:m]) if m > 0 else np.empty(0, np.uint64)
