"""Cutting lineage between iterations, in a folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of ids may be broadcast.
SMALL = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset one of its own, on a local master only."""
    context = spark.sparkContext
    if found := context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir():
        return found.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="netloom-"))
    return context.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def if_small(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """Marks a checkpointed table of ids for broadcast if it has at most ``limit`` rows; else leaves the join to shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
