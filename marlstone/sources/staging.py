"""Staged tables of the core: written once in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_folder(spark: SparkSession) -> None:
    """Spark's checkpoint folder: spark.checkpoint.dir, else one of our own on a local master, whose
    executors are the driver; an error on any other."""
    if spark.sparkContext.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="marlstone-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        folder = f"file://{path}"
    spark.sparkContext.setCheckpointDir(folder)


def staged(df: DataFrame) -> DataFrame:
    """df, computed once and read from the shared folder from now on; a lost executor costs a task again."""
    ensure_folder(df.sparkSession)
    return df.checkpoint(eager=True)
