"""A folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; a temporary folder only where a local session names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not named and not held.isDefined():
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="leafwise"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return f"{(named or held.get()).rstrip('/')}/leafwise-{uuid.uuid4().hex}"
