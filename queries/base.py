"""Registry shared by the query modules: a Spark callable and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, *tables: str, sql: str | None = None):
    """Register ``fn(*dataframes)`` under ``name``."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(*[table(spark, sf_dir, t) for t in tables])

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
