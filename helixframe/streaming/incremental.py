"""Running forms of the mergeable aggregates: an extension, as the domain itself is batch.

Each micro-batch is reduced to partial states, which merge with the table kept so far; states are per key, not per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def partial_density(codes: DataFrame) -> DataFrame:
    """(feature_id, n_active, max_z) of a batch of codes."""
    return codes.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n_active"), F.max("z").alias("max_z"))


def merge_density(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("feature_id").agg(F.sum("n_active").alias("n_active"), F.max("max_z").alias("max_z"))


def merge_top(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """The n strongest (feature_id, token, z) of two such tables."""
    w = Window.partitionBy("feature_id").orderBy(F.desc("z"), "token")
    return a.unionByName(b).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def run_density(stream: DataFrame, folder: str, checkpoint: str):
    """A query that keeps the density state under `folder`, a version for each micro-batch; state(spark, folder) reads the last."""

    def step(batch: DataFrame, number: int) -> None:
        now = partial_density(batch)
        if number:
            now = merge_density(now, batch.sparkSession.read.parquet(f"{folder}/version={number - 1}"))
        now.write.mode("overwrite").parquet(f"{folder}/version={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def state(spark, folder: str) -> DataFrame:
    last = spark.read.parquet(folder)
    return last.join(last.agg(F.max("version").alias("version")), "version", "left_semi").drop("version")
