"""Where intermediate results live, and how large a broadcast may be.

Lineage is cut with reliable checkpoints in the folder that the session names in
``spark.checkpoint.dir``; a folder of our own is set only where none is named, as in tests.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only if the session names no folder (single-machine runs and tests).
LOCAL_FOLDER = "/tmp/checkpoints/railside"

#: Rows of a narrow table (a few dozen bytes each) that may be broadcast: tens of MB at most.
BROADCAST_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = LOCAL_FOLDER
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for files that a later step reads again."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path that ``scratch_path`` gave, once nothing reads it any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once, with their lineage cut by a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow, already checkpointed table for broadcast if it has at most ``rows`` rows.

    Beyond that it is returned unmarked, and Spark joins by shuffle.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def missing(column: Column, value) -> Column:
    """The column with nulls replaced."""
    return F.coalesce(column, value if isinstance(value, Column) else F.lit(value))


def drop_existing(df: DataFrame, *names: str) -> DataFrame:
    """Without columns that an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])
