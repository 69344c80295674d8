"""A local session with settings that suit this library; a cluster brings its own."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def share_code(spark: SparkSession) -> SparkSession:
    """Python workers on this machine find this package wherever the driver was started."""
    root, held = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in held.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, held]))
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", app: str = "loomfit") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return share_code(spark)
