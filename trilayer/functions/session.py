"""Materialisation in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: With this, Spark deletes the shuffle files of a query when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where the session names none and runs on one machine (tests) is one made."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="trilayer-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def without_leftovers(spark: SparkSession) -> Iterator[None]:
    """What is run here to its end leaves no shuffle files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame) -> DataFrame:
    """Checkpoint ``df``: it is computed once and its lineage is cut."""
    shared_folder(df.sparkSession)
    with without_leftovers(df.sparkSession):
        return df.checkpoint()


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """As ``materialise``, for tables as large as the input or larger: columns in compressed Parquet, of which readers take what they need.

    The shuffles that made the table go when it is written, so a chain of
    stored tables takes the disk of the tables and of one step.
    """
    spark = df.sparkSession
    path = path or scratch(spark, "stored")
    with without_leftovers(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Empty a stored table that nothing reads any more."""
    spark.range(0).write.mode("overwrite").parquet(path)
