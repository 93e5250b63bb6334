"""Exports and reports (inventory 19-26)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.observations import Observations
from gaugework.operators.assess import place_in_group


def raw_table(obs: Observations) -> DataFrame:
    """19: measurement number within the name, parameters and attributes."""
    number = place_in_group(obs.df, [obs.name], obs.obs_id).select(obs.obs_id, F.col("place").alias("measurement"))
    return obs.df.join(number, obs.obs_id).select(obs.name, "measurement", *obs.params, *obs.attrs)


def write_raw_csv(obs: Observations, path: str) -> None:
    """19: a folder of CSV files for each name."""
    raw_table(obs).write.partitionBy(obs.name).option("header", True).mode("overwrite").csv(path)


def aggregated(obs: Observations, attr: str, digits: int | None = None) -> DataFrame:
    """20: each row with the mean of its configuration, maybe as text of some digits."""
    mean = F.avg(attr).over(Window.partitionBy(*obs.config))
    return obs.df.select(obs.obs_id, *obs.config, (mean if digits is None else F.format_string(f"%.{digits}f", mean)).alias(attr))


def value_table(obs: Observations, attr: str) -> DataFrame:
    """21: index, value and parameters as one text a row; an unset parameter is ``{}``."""
    return obs.df.select(F.concat_ws(" ", F.col(obs.obs_id).cast("string"), F.col(attr).cast("string"), *(F.coalesce(F.col(p).cast("string"), F.lit("{}")) for p in obs.params)).alias("value"))


def json_rows(obs: Observations) -> DataFrame:
    """21, 25: observations as JSON objects with param and attribute."""
    return obs.df.select(F.to_json(F.struct(F.col(obs.name).alias("name"), F.struct(*obs.params).alias("param"), F.struct(*obs.attrs).alias("attribute"))).alias("value"))


def report(types: DataFrame, quality: DataFrame) -> DataFrame:
    """23: flat (key, value, unit) rows of parameter counts and errors."""
    counts = types.groupBy("name", "type").agg(F.count("*").alias("n")).select(F.concat_ws("/", F.lit("paramcount"), "name", F.lower("type")).alias("key"), F.col("n").cast("double").alias("value"), F.lit("1").alias("unit"))
    metrics = [c for c in quality.columns if c not in ("name", "attr", "use")]
    errors = quality.unpivot(["name", "attr"], metrics, "metric", "value").select(F.concat_ws("/", F.lit("error"), "name", "attr", "metric").alias("key"), "value", F.when(F.col("metric").contains("smape"), "%").otherwise("1").alias("unit"))
    return counts.unionByName(errors)


def state_signals(df: DataFrame, keys=("state", "run"), order: str = "i") -> DataFrame:
    """26: the power series of each state and run, in order."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, "value"))).alias("series"))
