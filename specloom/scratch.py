"""Folders for tables that a computation writes and reads again."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a local one where the master is local and names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
        shared = os.path.join(tempfile.gettempdir(), "specloom-checkpoints")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
