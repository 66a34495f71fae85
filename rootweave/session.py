"""Shared folder and lineage cuts for loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. On one machine, as in tests, a temporary folder where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        folder = context.getCheckpointDir().get()
    return folder.rstrip("/")


def settle(frame: DataFrame, name: str = "step") -> DataFrame:
    """Writes a loop's state as Parquet and reads it again, so that plans stay short and lost executors lose nothing."""
    path = f"{shared_dir(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
