"""Paths for files that a later step reads: in the session's shared folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

#: Used only if the session names no folder (single-machine runs and tests).
LOCAL_FOLDER = "/tmp/checkpoints/railside"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = LOCAL_FOLDER
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for files that a later step reads again."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
