"""Streaming forms of three batch operators. The rules and expressions are those of the batch code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablewise.functions import masking
from tablewise.functions.types import ident
from tablewise.operators.workflows import row_rules


def with_watermark(stream: DataFrame, when: str, delay: str) -> DataFrame:
    """Event time as a timestamp with a watermark; a timestamp without time zone cannot carry one."""
    return stream.withColumn(when, F.col(ident(when)).cast("timestamp")).withWatermark(when, delay)


def buckets(
    stream: DataFrame, when: str, length: str, by: Sequence[str] = (), delay: str = "1 hour",
    **aggregates: Column,
) -> DataFrame:
    """Aggregates by time bucket (and key). A bucket is emitted once the watermark has passed it."""
    timed = with_watermark(stream, when, delay)
    out = timed.groupBy(F.window(when, length).alias("_w"), *by).agg(*[e.alias(n) for n, e in aggregates.items()])
    return out.select(F.col("_w.start").alias("bucket"), *by, *aggregates)


def quality_sweep(
    stream: DataFrame, when: str, measure: str, today: Column, length: str, delay: str = "1 hour"
) -> DataFrame:
    """Rows breaking each rule, by time bucket."""
    rules = row_rules(when, measure, today)
    return buckets(stream, when, length, delay=delay, rows=F.count("*"), **{n: F.count_if(t) for n, t in rules.items()})


def mask(stream: DataFrame) -> DataFrame:
    """Stateless: every column masked by name or by content."""
    return masking.mask_table(stream)


def drain(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is available, append it to Parquet, and stop; resumable from its checkpoint."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def drain_all(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str]) -> DataFrame:
    """Process what is available and return the last state of every bucket, those still open included.

    Each batch writes the buckets it changed to a folder of its own, so a batch that runs again replaces what it
    wrote; of the states of a bucket the one of the latest batch counts.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()
    states = stream.sparkSession.read.parquet(path)
    row = F.struct(*[F.col(c) for c in stream.columns])
    return states.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(row, "batch").alias("r")).select("r.*")
