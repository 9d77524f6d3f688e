"""Folders for tables that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir or the context's checkpoint folder, else,
    in a local run alone, a temporary one."""
    jsc = spark.sparkContext._jsc.sc()
    at = spark.conf.get("spark.checkpoint.dir", None) or (None if jsc.getCheckpointDir().isEmpty() else jsc.getCheckpointDir().get())
    if at is None:
        if not jsc.isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
