"""Cuts of lineage in the shared folder, for operators that iterate."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _folder(df: DataFrame) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local one only where that is unset and Spark runs in one process (tests)."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    _folder(df)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder. Its size is that of its files, where a checkpoint keeps the estimate of the plan
    that made it: in a loop that joins what it made before, such estimates square with every step."""
    path = f"{_folder(df).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, so that rows of few frequent keys do not meet in few tasks; else
    its many keys spread a shuffle. Give a settled table: it is counted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
