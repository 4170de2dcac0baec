"""The folder that the cluster shares, and cuts of lineage there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only in local mode, where that is unset."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="helixframe-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """df by a checkpoint that outlives any executor: it is read as often as needed and worked out once."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
