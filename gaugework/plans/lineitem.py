"""Order lines as observations: the common input of the registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.observations import Observations
from gaugework.plans.registry import table

#: The same observations in SQL.
OBS = """obs AS (
  SELECT (l_orderkey * 10 + l_linenumber) * 1000003 + l_partkey AS obs_id, l_returnflag AS name, l_linestatus AS status, l_quantity AS quantity,
         l_tax AS tax, l_extendedprice / l_quantity AS unit_price, l_extendedprice AS price
  FROM lineitem)"""
LONG = OBS + """, long AS (
  SELECT obs_id, name, status, quantity, tax, 'unit_price' AS attr, unit_price AS value FROM obs
  UNION ALL SELECT obs_id, name, status, quantity, tax, 'price', price FROM obs)"""


def observations(spark, sf_dir) -> Observations:
    """name: return flag; parameters: line status, quantity; attributes: unit price and price. Tax is at hand too."""
    li = table(spark, sf_dir, "lineitem")
    df = li.select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_003 + F.col("l_partkey")).alias("obs_id"), F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("status"), F.col("l_quantity").alias("quantity"),
        F.col("l_tax").alias("tax"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"), F.col("l_extendedprice").alias("price"),
    )
    return Observations(df, ("status", "quantity"), ("unit_price", "price"))


def r(column, places: int = 5):
    return F.round(column, places).alias(column)


def r8(column, places: int = 8):
    """For means of few values of two decimals, which end in a 5 too often at five places."""
    return F.round(column, places).alias(column)
