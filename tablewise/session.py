"""Session helpers: lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import sys
import tempfile
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import Any

from pyspark import cloudpickle, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def _has_checkpoint_dir(spark: SparkSession) -> bool:
    return spark.sparkContext.getCheckpointDir() is not None


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by the session; only a local master may fall back to /tmp."""
    if _has_checkpoint_dir(spark):
        return
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_CONF
    )
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
    elif spark.sparkContext.master.startswith("local"):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tablewise-ckpt-"))
    else:
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and return it with its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def pin(df: DataFrame) -> DataFrame:
    """A frame of a few rows (one for each column of a table, say), computed once and kept as literals."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def together(spark: SparkSession, *jobs: Callable[[], Any]) -> list[Any]:
    """Submit independent Spark jobs at the same time, so that one fills the cores another leaves idle."""
    with ThreadPoolExecutor(max_workers=max(1, len(jobs))) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        return [r.result() for r in running]


def by_value(name: str) -> None:
    """Send the functions of module ``name`` to executors with the task, so that no code has to be installed there."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application.

    Only the few per-file readers run Python on executors; they import from here.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tablewise-")) / "tablewise.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in root.rglob("*.py"):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)

