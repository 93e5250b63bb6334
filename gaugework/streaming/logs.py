"""The log-line parser and running statistics on streams.

Parsing is a pure column function, so a stream of lines goes through the same code as files do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.sources.logs import parse_lines


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Lines of the files that arrive in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def stream_observations(lines: DataFrame) -> DataFrame:
    """name, place, param, attr of each matching line; lines with a bad pair carry their text in ``bad``."""
    return parse_lines(lines, strict=False)


def running_moments(observations: DataFrame) -> DataFrame:
    """Count, mean and deviation of each (name, attr) so far; complete or update mode."""
    long = observations.where("bad is null").select("name", F.explode("attr").alias("attr", "value"))
    return long.groupBy("name", "attr").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def windowed_moments(observations: DataFrame, ts: str, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """The same by time window; rows later than ``late`` behind the newest are dropped."""
    long = observations.withWatermark(ts, late).select(ts, "name", F.explode("attr").alias("attr", "value"))
    return long.groupBy(F.window(ts, width), "name", "attr").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
