"""The folder that driver and executors share, for streams and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; only where that is unset (tests, one
    machine) under a temporary folder."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at is None:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            at = got.get()
        else:
            at = "file://" + tempfile.mkdtemp(prefix="loomfit-")
            spark.sparkContext.setCheckpointDir(at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
