"""Cutting lineage between the rounds of a loop, in the folder that all machines share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def settled(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read again, so that a loop's plan stays small and survives lost executors.

    The folder is the session's ``spark.checkpoint.dir``. Where it is unset a
    temporary one stands in on a single machine; on a cluster that is an error.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, set where it isn't yet."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tessera-"))
    return context.getCheckpointDir()


def unsettled(what: str, rounds: int) -> RuntimeError:
    return RuntimeError(f"{what} still changes after {rounds} rounds")
