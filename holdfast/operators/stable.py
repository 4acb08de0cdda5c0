"""Reliable materialisation for frames whose rows must be the same for every reader."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder (``spark.checkpoint.dir``). A local session that names none gets a folder that goes
    when the session ends; a cluster must name one that all machines share."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before ranking on a cluster")
        folder = tempfile.mkdtemp(prefix="holdfast-checkpoint-")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    sc.setCheckpointDir(folder)
    return folder


def stable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there, so lost executors cannot change it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
