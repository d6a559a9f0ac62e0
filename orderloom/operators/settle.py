"""Small results that several plans read, settled once in the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one where none is named and driver and
    executors are one machine.  On a cluster without one this is an error."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        import tempfile

        found = f"file://{tempfile.mkdtemp(prefix='orderloom-')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def settled(df: DataFrame) -> DataFrame:
    """The rows, computed now and kept in the shared folder; for model-sized tables."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
