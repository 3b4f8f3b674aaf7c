"""Cutting the lineage of stages that build on one another."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that ``few`` broadcasts.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only on one machine (a local master, as in tests), where none is set, a temporary one is made and remembered.
    """
    context = spark.sparkContext
    if not (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
    return (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: later stages plan against a scan, not all that came before."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def few(df: DataFrame) -> DataFrame:
    """The written rows ``df``, with a broadcast hint if they are at most ``BROADCAST_ROWS``.

    Few rows go to where the texts lie that they are joined to; the planner can't tell how few they are and would shuffle the texts.
    """
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
