"""Session and shared-folder helpers."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g",
                  settings: dict[str, str] | None = None) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("billsift")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in (SETTINGS | (settings or {})).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name that the driver and every executor can reach.

    It lies under ``spark.checkpoint.dir`` where the session sets it, else in
    the warehouse folder, which Spark itself needs to be shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if not root and warehouse.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        warnings.warn(f"spark.checkpoint.dir is not set and {warehouse} may be local to each machine", stacklevel=2)
    root = root or f"{warehouse.rstrip('/')}/scratch"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files; else they stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written by ``checkpoint()``, its lineage cut there."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession, "cut"))
    return df.checkpoint()


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write a result that several branches read to the shared folder, and read it.

    Each branch would else repeat the work behind ``df``; the written table
    also outlives a lost executor.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
