"""The folder that all executors share, named by spark.checkpoint.dir."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The setting's folder; one of our own only where it is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or ""
    jsc = spark.sparkContext._jsc.sc()
    if not folder:
        now = jsc.getCheckpointDir()
        folder = now.get() if now.isDefined() else "file://" + tempfile.mkdtemp(prefix="quarrymill-")
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder
