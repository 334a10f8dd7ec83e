"""Cutting the lineage of loops through the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, as spark.checkpoint.dir names it; one of our own only in local mode (tests)."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="wayloom-"))
    return spark.sparkContext.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """df computed once and kept in that folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


#: Rows of a task in the mean where rows are dealt by their number.
TASK_ROWS = 1_000_000


def tasks(df: DataFrame) -> int:
    """So many tasks that each has TASK_ROWS rows of df in the mean, and no fewer than the session's."""
    return max(-(-df.count() // TASK_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over its tasks: a task's memory doesn't grow with the table."""
    return df.repartition(tasks(df), *keys)


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in that folder: computed once, and read back with only the columns that are asked for."""
    path = f"{checkpoint_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
