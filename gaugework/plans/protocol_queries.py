"""Protocol, energy and streaming-parser queries (inventory 77-79)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugework.operators import protocols
from gaugework.plans.lineitem import r8 as r
from gaugework.plans.registry import query, table


@query("q77_protocol_metrics", """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS run, value FROM events)
SELECT user_id AS item, round(median(value) FILTER (WHERE run > 0) - 5, 8) AS cycles, count(*) AS runs FROM e GROUP BY user_id""")
def protocol_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    run = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = e.select(F.col("user_id").alias("item"), run.alias("run"), "value")
    flat = rows.withColumn("attr", F.lit("cycles")).unionByName(rows.select("item", "run", F.lit(5.0).alias("value"), F.lit("nop").alias("attr")))
    return protocols.protocol_metrics(flat, ["item"]).select("item", r("cycles"), "runs")


@query("q78_cycles_to_energy", "SELECT p_partkey, round(3.0 * (p_size % 5 + 1) * p_retailprice / 16e6 * 1e9, 4) AS energy_nj FROM part")
def cycles_to_energy(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.lit("m").alias("mcu"), F.lit(16e6).alias("freq_hz"), F.concat(F.lit("mem"), F.col("p_size") % 5).alias("memory"), F.lit(3.0).alias("volt"), F.col("p_retailprice").alias("cycles"))
    currents = spark.createDataFrame([("m", 16e6, f"mem{i}", 3.0, float(i + 1)) for i in range(5)], "mcu string, freq_hz double, memory string, volt double, ampere double")
    return protocols.cycles_to_energy(part, currents).select("p_partkey", r("energy_nj", 4))


@query("q79_radio_energy", """SELECT conv_id, turn, (n // 100) * (2 + 0.5 * 110) + CASE WHEN n % 100 > 0 THEN 2 + 0.5 * (n % 100 + 10) ELSE 0 END AS energy
FROM (SELECT conv_id, turn, length(text) AS n FROM conversations)""")
def radio_energy(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", protocols.radio_energy(F.length("text"), [2.0, 0.5], 10, 100).alias("energy"))
