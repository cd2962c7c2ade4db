"""Session settings that the operators rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or one below the working folder where that is unset."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file://" + os.path.abspath("spark-warehouse/checkpoints")


def ensure_checkpoint(spark: SparkSession) -> None:
    """Gives the session a checkpoint folder if it has none."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
