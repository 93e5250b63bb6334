"""Shared storage for intermediate tables, size-checked broadcasts, and columns that keep out of the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A side of at most this many rows of a few numbers each may be broadcast.
BROADCAST_ROWS = 400_000
#: A key with this share of all rows is frequent (and with ``FEW`` at least), so that at most twice its inverse are.
SHARE, FEW = 1 / 10_000, 64

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a local one only where that is unset and Spark runs in one process (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        base = _LOCAL[0]
    if base.startswith("/"):
        base = "file://" + base
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing still to run reads."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._settled_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``rows`` rows; else the join shuffles.

    ``df`` should be a settled table, so that the count is a metadata read.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_frequent_apart(rows: DataFrame, side: DataFrame, keys: list[str], total: int, count: str = "_count") -> DataFrame:
    """The inner join of ``rows`` with ``side`` (one row a key, with the number of rows that hold it as ``count``).

    Keys that hold more than ``SHARE`` of the ``total`` rows are joined by a broadcast, which by that bound has at most
    ``max(1 / SHARE, total / FEW)`` rows, so that none of them is the work of one task; all others by a shuffle.
    """
    edge = max(FEW, int(total * SHARE))
    frequent, rest = side.where(F.col(count) >= edge), side.where(F.col(count) < edge)
    # Rows of frequent keys are taken out before the shuffle, where they would meet in one task for nothing.
    others = rows.join(F.broadcast(frequent.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(frequent), keys).unionByName(others.join(rest, keys)).drop(count)


def extended(df: DataFrame, columns: str) -> StructType:
    """The schema of ``df`` with the columns of a DDL string after it."""
    return StructType([*df.schema.fields, *StructType.fromDDL(columns).fields])


def without(df: DataFrame, names) -> DataFrame:
    """``df`` without columns of these names, whatever their case: an operator's own columns replace them."""
    taken = {n.lower() for n in names}
    return df.drop(*(c for c in df.columns if c.lower() in taken))


def set_aside(df: DataFrame, names) -> tuple[DataFrame, list[Column]]:
    """``df`` with its columns of these names renamed out of an operator's way, and the columns that bring all of ``df`` back."""
    taken = {n.lower() for n in names}
    new = {c: f"_aside{i}_{c}" for i, c in enumerate(df.columns) if c.lower() in taken}
    return df.withColumnsRenamed(new), [F.col(f"`{new.get(c, c)}`").alias(c) for c in df.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
