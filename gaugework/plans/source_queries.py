"""Source and sink queries (inventory 1-26): logs are made of the tables' rows and read again."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugework.observations import from_maps
from gaugework.operators import assess, lookup, stats
from gaugework.plans.lineitem import LONG, OBS, observations, r8 as r
from gaugework.plans.registry import query, scratch, table
from gaugework.sources import exports, logs, signals

SUMS = f"WITH {OBS} SELECT name, status, count(*) AS n, round(sum(quantity), 3) AS quantity, round(sum(price), 2) AS price FROM obs GROUP BY ALL"


def _sums(obs):
    q = F.col("quantity").cast("double")
    return obs.df.groupBy("name", "status").agg(F.count("*").alias("n"), F.round(F.sum(q), 3).alias("quantity"), F.round(F.sum("price"), 2).alias("price"))


def _lines(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return logs.to_lines(obs.df, obs.params, ("price",))


@query("q01_log_lines", SUMS)
def log_lines(spark, sf_dir):
    parsed = logs.parse_lines(_lines(spark, sf_dir).unionByName(spark.createDataFrame([("other output",)], "value string")))
    return _sums(from_maps(parsed, ("quantity", "status"), ("price",)))


@query("q02_trace_log", "SELECT user_id::VARCHAR AS file, count(*) AS n, 1::BIGINT AS runs, count(*)::BIGINT AS end_offset FROM events GROUP BY 1")
def trace_log(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("line_no"), F.concat(F.lit("[::] call @ "), "event_type", F.lit(" | k=1 | v="), F.col("value").cast("string")).alias("value"))
    ends = e.groupBy("file").agg(F.max("line_no").alias("m"))
    mark = lambda at, kind: ends.select("file", at.alias("line_no"), F.lit(f"[{kind}] bench | mode=1").alias("value"))
    rows, marks = logs.parse_trace(e.unionByName(mark(F.lit(-1).cast("long"), ">>")).unionByName(mark(F.col("m") + 1, "<<")))
    a = rows.groupBy("file").agg(F.count("*").alias("n"), F.count_distinct("run").alias("runs"))
    return a.join(marks.where("kind = 'end'").select("file", F.col("offset").alias("end_offset")), "file")


@query("q03_csv", SUMS)
def csv_source(spark, sf_dir):
    path = scratch(spark)
    obs = observations(spark, sf_dir)
    obs.df.select("obs_id", F.col("name").alias("flag"), "status", "quantity", "price").write.option("header", True).csv(path)
    back = logs.csv_observations(spark, path, ["price"], ["obs_id"]).drop("name").withColumnRenamed("flag", "name")
    return _sums(obs.with_df(back, attrs=("price",)))


@query("q05_json", SUMS)
def json_source(spark, sf_dir):
    path = scratch(spark)
    obs = observations(spark, sf_dir)
    files = max(32, obs.df.count() // 100_000)
    parts = exports.json_rows(type(obs)(obs.df, obs.params, ("price",))).withColumn("part", F.pmod(F.xxhash64("value"), F.lit(files)))
    parts.groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value")).select("value").repartition(files).write.text(path)
    return _sums(from_maps(logs.json_observations(spark, path), ("quantity", "status"), ("price",)))


@query("q06_union", f"WITH {OBS} SELECT i::INT AS input, name, count(*) AS n FROM obs, range(2) g(i) GROUP BY ALL")
def union_inputs(spark, sf_dir):
    df = observations(spark, sf_dir).df
    return logs.union_inputs([df, df.drop("status")]).groupBy("input", "name").agg(F.count("*").alias("n"))


@query("q07_rebase", "WITH s AS (SELECT user_id AS input, count(*) AS n FROM events GROUP BY 1) SELECT input, n + coalesce(sum(n) OVER (ORDER BY input ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM s")
def rebase(spark, sf_dir):
    sizes = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("input")).agg(F.count("*").alias("n"))
    return logs.rebase_marks(sizes.withColumnRenamed("n", "offset"), sizes).select("input", "offset")


@query("q10_charge_words", "SELECT o_orderkey, (o_custkey * 16 + o_orderkey % 16) >> 4 AS charge, ((o_orderkey % 16) >> 3) & 1 AS trigger FROM orders")
def charge_words(spark, sf_dir):
    w = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 16 + F.col("o_orderkey") % 16).alias("word"))
    return signals.decode_words(w).select("o_orderkey", "charge", "trigger")


@query("q11_energy_counter", """WITH e AS (SELECT user_id, event_id, row_number() OVER w AS k, (row_number() OVER w * 3000000000) % 4294967296 AS c, value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id::VARCHAR AS signal, event_id AS line_no, CASE WHEN k > 1 THEN 3000.0::DOUBLE END AS power FROM e""")
def energy_counter(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    lines = e.select(F.col("user_id").cast("string").alias("signal"), F.col("event_id").alias("line_no"), F.format_string("%d %d 1 3 %d", F.pmod("event_id", F.lit(3)), k * 1_000_000, (k.cast("long") * 3_000_000_000) % (1 << 32)).alias("value"))
    return signals.energy_counter(lines).select("signal", "line_no", "power")


@query("q13_bench_csv", "SELECT user_id AS file, count(*) AS n, round(sum(-value), 3) AS current FROM events GROUP BY 1")
def bench_csv(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    body = e.select(F.col("user_id").alias("file"), (F.col("event_id") + 4).alias("line_no"), F.format_string("%d,x,%s", "event_id", F.col("value").cast("string")).alias("value"))
    head = e.select(F.col("user_id").alias("file")).distinct().select("file", F.explode(F.array(*(F.lit(i).cast("long") for i in range(4)))).alias("line_no"), F.lit("a,b,c").alias("value"))
    return signals.bench_csv(head.unionByName(body)).groupBy("file").agg(F.count("*").alias("n"), F.round(F.sum("current"), 3).alias("current"))


@query("q14_counters", "SELECT o_custkey, '[::] run | o_custkey=' || o_custkey || ' | P=' || count(*) || ' P_per_s=' || min(o_orderkey) AS line FROM orders GROUP BY o_custkey")
def counters(spark, sf_dir):
    c = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("value"), F.min("o_orderkey").alias("metric")).select("o_custkey", F.lit("P").alias("event"), "value", F.lit("M/sec").alias("unit"), "metric")
    return logs.counter_observations(c, ["o_custkey"], "run")


@query("q15_counter_delta", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_extendedprice - 20000 < 0 THEN l_extendedprice + 80000 ELSE l_extendedprice - 20000 END / (l_quantity + 1), 8) AS power_uw FROM lineitem")
def counter_delta(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit(20000.0).alias("start_uj"), F.col("l_extendedprice").alias("stop_uj"), F.lit(-1.0).alias("start_s"), F.col("l_quantity").alias("stop_s"))
    return logs.counter_delta(li, 100000.0).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r("power_uw"))


@query("q16_working_set", "WITH s AS (SELECT user_id AS file, event_id % 100 AS t, value FROM events) SELECT file, CASE WHEN t BETWEEN 10 AND 40 THEN 'k1' ELSE 'k2' END AS kernel, round(avg(value), 8) AS mean_insn, round(median(value), 8) AS median_insn, count(*) AS n FROM s WHERE t BETWEEN 10 AND 40 OR t BETWEEN 60 AND 75 GROUP BY ALL")
def working_set(spark, sf_dir):
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), (F.col("event_id") % 100).alias("t"), F.col("value").alias("insn"), F.col("value").alias("data"))
    files = s.select("file").distinct()
    spans = F.array(*(F.struct(F.lit(a).alias("from_t"), F.lit(b).alias("to_t"), F.lit(k).alias("kernel")) for a, b, k in ((0, 9, None), (10, 40, "k1"), (60, 75, "k2"))))
    return logs.working_set_stats(s, files.select("file", F.explode(spans).alias("x")).select("file", "x.*")).select("file", "kernel", r("mean_insn"), r("median_insn"), "n")


@query("q18_log_sink", f"WITH {OBS} SELECT '[::] ' || name || ' | quantity=' || quantity::VARCHAR || ' status=' || status || ' | tax=' || tax::VARCHAR AS value, count(*) AS n FROM obs GROUP BY 1")
def log_sink(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return logs.to_lines(obs.df, obs.params, ("tax",)).groupBy("value").agg(F.count("*").alias("n"))


@query("q19_raw_table", f"WITH {OBS}, u AS (SELECT obs_id, min(name) AS name, min(price) AS price FROM obs GROUP BY obs_id) SELECT name, row_number() OVER (PARTITION BY name ORDER BY obs_id) - 1 AS measurement, price FROM u")
def raw_table(spark, sf_dir):
    obs = observations(spark, sf_dir)
    one = obs.df.groupBy("obs_id").agg(F.min("name").alias("name"), F.min("price").alias("price"))
    return exports.raw_table(type(obs)(one, (), ("price",)))


@query("q20_aggregated", f"WITH {OBS}, a AS (SELECT name, status, quantity, avg(price) OVER (PARTITION BY name, status, quantity) AS price FROM obs) SELECT name, status, quantity, round(price, 6) AS price, count(*) AS n FROM a GROUP BY ALL")
def aggregated(spark, sf_dir):
    rows = exports.aggregated(observations(spark, sf_dir), "price")
    return rows.groupBy("name", "status", "quantity", F.round("price", 6).alias("price")).agg(F.count("*").alias("n"))


@query("q21_value_table", f"WITH {OBS} SELECT obs_id || ' ' || price::VARCHAR || ' ' || quantity::VARCHAR || ' ' || coalesce(NULLIF(status, 'F'), '{{}}') AS value FROM obs")
def value_table(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return exports.value_table(obs.with_df(obs.df.withColumn("status", F.nullif("status", F.lit("F")))), "price")


@query("q23_report", f"""WITH {LONG}, s AS (SELECT name, attr, 'static' AS model, value AS t, median(value) OVER (PARTITION BY name, attr) AS p FROM long),
l AS (SELECT name, attr, 'lut' AS model, value AS t, median(value) OVER (PARTITION BY name, attr, status, quantity) AS p FROM long),
e AS (SELECT name, attr, model, avg(abs(p - t)) AS mae, avg(CASE WHEN t = 0 AND p = 0 THEN 0 ELSE abs(p - t) / ((abs(t) + abs(p)) / 2) END) * 100 AS smape,
  CASE WHEN var_pop(t) > 0 THEN 1 - sum((p - t) * (p - t)) / (var_pop(t) * count(*)) WHEN sum((p - t) * (p - t)) = 0 THEN 1 ELSE 0 END AS rsq
  FROM (FROM s UNION ALL FROM l) GROUP BY ALL),
k AS (SELECT name, CASE d WHEN 0 THEN 'unset' WHEN 1 THEN 'useless' WHEN 2 THEN 'boolean' ELSE more END AS type FROM (
  SELECT name, count(DISTINCT status) AS d, 'enum' AS more FROM obs GROUP BY name UNION ALL SELECT name, count(DISTINCT quantity), 'scalar' FROM obs GROUP BY name))
SELECT 'paramcount/' || name || '/' || type AS key, count(*)::DOUBLE AS value, '1' AS unit FROM k GROUP BY ALL
UNION ALL SELECT 'error/' || name || '/' || attr || '/' || model || '_mae', round(mae, 5), '1' FROM e
UNION ALL SELECT 'error/' || name || '/' || attr || '/' || model || '_smape', round(smape, 5), '%' FROM e
UNION ALL SELECT 'error/' || name || '/' || attr || '/' || model || '_rsq', round(rsq, 5) + 0, '1' FROM e""")
def report(spark, sf_dir):
    obs = observations(spark, sf_dir)
    flat = exports.report(stats.param_types(obs.df, obs.params), assess.quality_table(obs.long(), obs.params))
    return flat.select("key", (F.round("value", 5) + F.lit(0.0)).alias("value"), "unit")


@query("q25_export", f"WITH {OBS} SELECT name, count(*) AS n FROM obs GROUP BY name")
def export(spark, sf_dir):
    path = scratch(spark)
    exports.json_rows(observations(spark, sf_dir)).write.text(path)
    return spark.read.schema("name string").json(path).groupBy("name").agg(F.count("*").alias("n"))


@query("q26_state_signals", "SELECT event_type AS state, user_id AS run, array_to_string(list(event_id ORDER BY event_id), ',') AS ids FROM events GROUP BY ALL")
def state_signals(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("state"), F.col("user_id").alias("run"), F.col("event_id").alias("i"), "value")
    return exports.state_signals(e).select("state", "run", F.array_join(F.transform("series", lambda x: x["i"].cast("string")), ",").alias("ids"))


@query("q52_events_in_runs", "WITH s AS (SELECT user_id, min(event_id) AS a, min(event_id) + 500 AS b FROM events GROUP BY 1) SELECT e.user_id, count(*) AS n FROM events e JOIN s ON e.user_id = s.user_id AND e.event_id BETWEEN a AND b GROUP BY 1")
def events_in_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    runs = e.groupBy("user_id").agg(F.min("event_id").alias("a"), (F.min("event_id") + 500).alias("b"))
    return lookup.interval_join(e, runs, ["user_id"], "event_id", "a", "b", 500.0).groupBy("user_id").agg(F.count("*").alias("n"))
