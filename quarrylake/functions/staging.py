"""Cutting lineage where one result feeds many: a checkpoint in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, spark.checkpoint.dir.

    Only a session on one machine may lack such a folder, and is given a temporary one; elsewhere that would lie on a
    disk of its own for each executor, and raises.
    """
    context = spark.sparkContext
    have = context._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def stage(df: DataFrame) -> DataFrame:
    """df, computed once and read back from the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
