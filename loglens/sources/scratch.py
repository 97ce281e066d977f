"""A folder that driver and executors share, for tables that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path below the session's ``spark.checkpoint.dir``; below a temporary folder only where that is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loglens-")
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
