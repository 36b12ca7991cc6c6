"""Write results, with provenance and without overwriting."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.session import ensure_checkpoint_dir, materialise


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder on the storage that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def write_delimited(df: DataFrame, path: str, *, sep: str = ",", compression: str | None = None) -> None:
    writer = df.write.options(sep=sep, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    (writer.option("compression", compression) if compression else writer).csv(path)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str, *, partition_by: list[str] | None = None, codec: str = "zstd") -> None:
    writer = df.write.option("compression", codec)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_arrow(df: DataFrame, path: str) -> int:
    """One Arrow IPC file for each partition; returns the rows written.

    A file appears under its final name only when complete, named by partition, so a task that is
    run again replaces its own file.
    """
    names = df.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        found, folder = fs.FileSystem.from_uri(path)
        found.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        attempt = TaskContext.get().taskAttemptId()
        temporary, final = f"{folder}/_{part}-{attempt}.tmp", f"{folder}/part-{part:05d}.arrow"
        rows, sink, writer = 0, None, None
        for batch in batches:
            if writer is None:
                sink = found.open_output_stream(temporary)
                writer = pa.ipc.new_file(sink, batch.schema)
            writer.write_batch(batch.select(names))
            rows += batch.num_rows
        if writer is not None:
            writer.close()
            sink.close()
            found.move(temporary, final)
        yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64())})

    return df.mapInArrow(write, "rows long").agg(F.sum("rows")).first()[0] or 0


def append_findings(findings: DataFrame, path: str, keys: Sequence[str] = ("run", "place")) -> int:
    """Add findings to the table of findings and return how many were new; earlier ones are never touched.

    Findings whose ``keys`` the table holds already are left out, so a run that failed half-way is simply run again. Without these
    columns everything is added. One writer at a time.
    """
    spark = findings.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = all(k in findings.columns for k in keys)
    if known:
        findings = findings.dropDuplicates(list(keys))
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            earlier = spark.read.parquet(path)
            if all(k in earlier.columns for k in keys):
                findings = findings.join(earlier.select(*keys).distinct(), list(keys), "left_anti")
    new = materialise(findings)  # a table must not be read while it is written
    new.write.mode("append").partitionBy("card_hash").parquet(path)
    return new.count()
