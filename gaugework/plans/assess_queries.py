"""Lookup, assessment and validation queries (inventory 44-54, 110-125)."""

from __future__ import annotations


from pyspark.sql import functions as F

from gaugework.operators import assess, lookup, stats
from gaugework.plans.lineitem import LONG, OBS, observations, r
from gaugework.plans.registry import micros, query, table

KEYS = ["name", "attr"]


def metric_sql(rows: str, keys: str) -> str:
    """Metrics of a table expression with columns t and p."""
    return f"""SELECT {keys}, count(*) AS count, round(avg(abs(p - t)), 5) AS mae, round(CASE WHEN bool_and(t <> 0) THEN avg(abs(p - t) / abs(t)) * 100 END, 5) AS mape,
  round(avg(CASE WHEN t = 0 AND p = 0 THEN 0 ELSE abs(p - t) / ((abs(t) + abs(p)) / 2) END) * 100, 5) AS smape,
  round(quantile_cont(abs(p - t), 0.5), 5) AS p50, round(quantile_cont(abs(p - t), 0.9), 5) AS p90, round(quantile_cont(abs(p - t), 0.95), 5) AS p95, round(quantile_cont(abs(p - t), 0.99), 5) AS p99,
  round(sqrt(avg((p - t) * (p - t))), 5) AS rmsd,
  round(CASE WHEN var_pop(t) > 0 THEN 1 - sum((p - t) * (p - t)) / (var_pop(t) * count(*)) WHEN sum((p - t) * (p - t)) = 0 THEN 1 ELSE 0 END, 5) + 0 AS rsq
FROM ({rows}) GROUP BY {keys}"""


def shown(m, keys):
    return m.select(*keys, "count", *(r(c) for c in ("mae", "mape", "smape", "p50", "p90", "p95", "p99", "rmsd", "rsq")))


MODELS = f"""WITH {LONG},
s AS (SELECT name, attr, median(value) AS static FROM long GROUP BY ALL),
u AS (SELECT name, attr, status, quantity, median(value) AS lut FROM long GROUP BY ALL)"""


@query("q44_lut_lookup", f"""WITH {LONG}, s AS (SELECT name, attr, median(value) AS static FROM long GROUP BY ALL),
u AS (SELECT name, attr, status, quantity, median(value) AS lut FROM long WHERE quantity <= 40 GROUP BY ALL)
SELECT name, attr, quantity, round(avg(coalesce(lut, static)), 5) AS predicted FROM long JOIN s USING (name, attr) LEFT JOIN u USING (name, attr, status, quantity) GROUP BY ALL""")
def lut_lookup(spark, sf_dir):
    obs = observations(spark, sf_dir)
    long = obs.long()
    lut = stats.lut_model(long.where("quantity <= 40"), obs.params)
    out = lookup.lut_lookup(long, lut, obs.params, stats.static_model(long))
    return out.groupBy("name", "attr", "quantity").agg(F.round(F.avg("predicted"), 5).alias("predicted"))


@query("q45_wildcard_lookup", f"""{MODELS}, q AS (SELECT DISTINCT name, attr, CASE WHEN quantity % 2 = 0 THEN status END AS status, CASE WHEN quantity % 3 = 0 THEN quantity END AS quantity FROM long)
SELECT q.name, q.attr, q.status, q.quantity, round(avg(lut), 5) AS predicted FROM q JOIN u ON q.name = u.name AND q.attr = u.attr AND (q.status IS NULL OR q.status = u.status) AND (q.quantity IS NULL OR q.quantity = u.quantity) GROUP BY ALL""")
def wildcard_lookup(spark, sf_dir):
    obs = observations(spark, sf_dir)
    long = obs.long()
    q = long.select("name", "attr", F.when(F.col("quantity") % 2 == 0, F.col("status")).alias("status"), F.when(F.col("quantity") % 3 == 0, F.col("quantity")).alias("quantity")).distinct()
    return lookup.wildcard_lookup(q, stats.lut_model(long, obs.params), obs.params).withColumn("predicted", F.round("predicted", 5))


@query("q46_partial_match", f"WITH {OBS} SELECT name, count(*) AS n FROM obs WHERE status = 'O' AND quantity = 5 GROUP BY name")
def partial_match(spark, sf_dir):
    return lookup.partial_match(observations(spark, sf_dir).df, {"status": "O", "quantity": 5.0, "unknown": 1}).groupBy("name").agg(F.count("*").alias("n"))


@query("q47_slices", f"WITH {OBS} SELECT name, quantity, array_to_string(list_sort(list(DISTINCT status)), ',') AS values, count(*) AS n FROM obs GROUP BY ALL")
def slices(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return lookup.slices(obs.df, obs.params, "status").withColumn("values", F.array_join("values", ","))




@query("q48_speed_up", f"""WITH {OBS}, a AS (SELECT name, quantity, price, row_number() OVER (PARTITION BY name, quantity ORDER BY obs_id, price) AS rep FROM obs WHERE status = 'O'),
b AS (SELECT name, quantity, price, row_number() OVER (PARTITION BY name, quantity ORDER BY obs_id, price) AS rep FROM obs WHERE status = 'F')
SELECT a.name, a.quantity, a.rep::INT AS rep, round(a.price / b.price, 5) AS speed_up FROM a JOIN b USING (name, quantity, rep)""")
def speed_up(spark, sf_dir):
    df = observations(spark, sf_dir).df
    pairs, _ = lookup.speed_up(df, F.col("status") == "O", F.col("status") == "F", ["name", "quantity"], "price", ["obs_id", "price"])
    return pairs.select("name", "quantity", "rep", r("speed_up"))


@query("q49_positional_join", """WITH p AS (SELECT o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position FROM orders),
e AS (SELECT user_id AS k, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position FROM events)
SELECT k, position::INT AS position, o_orderkey, event_id FROM p JOIN e USING (k, position)""")
def positional_join(spark, sf_dir):
    plan = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    seen = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "event_id")
    return lookup.positional_join(plan, seen, ["k"], ["o_orderkey"], ["event_id"])


@query("q50_as_of", """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t, value, event_type IN ('signup', 'purchase') AS kind FROM events),
n AS (SELECT a.event_id, min(b.t) AS nt FROM e a JOIN e b ON a.user_id = b.user_id AND a.kind AND NOT b.kind AND b.t > a.t GROUP BY a.event_id)
SELECT event_id, nt::DOUBLE AS sample_ts FROM (SELECT event_id FROM e WHERE kind) LEFT JOIN n USING (event_id)""")
def as_of(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", micros("ts").alias("t"), "value", "event_type")
    events = e.where("event_type IN ('signup', 'purchase')").select("event_id", "user_id", "t")
    return lookup.as_of_next(events, e.where("event_type NOT IN ('signup', 'purchase')").drop("event_type"), ["user_id"], "t").select("event_id", "sample_ts")


@query("q51_window_cut_out", """WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, event_type FROM events)
SELECT a.event_id AS centre, b.event_id AS sample FROM e a JOIN e b ON a.user_id = b.user_id AND b.t BETWEEN a.t - 3600 AND a.t + 3600""")
def window_cut_out(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (micros("ts") / 1e6).alias("t"))
    spans = e.select(F.col("event_id").alias("centre"), "user_id", (F.col("t") - 3600).alias("lo"), (F.col("t") + 3600).alias("hi"))
    return lookup.interval_join(e, spans, ["user_id"], "t", "lo", "hi", 7200.0).select("centre", F.col("event_id").alias("sample"))


@query("q53_neighbours", """WITH t AS (SELECT event_type AS name, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT DISTINCT name, before, after FROM t WHERE name = (SELECT min(event_type) FROM events)""")
def neighbours(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min("event_type").alias("first"))
    trace = e.join(F.broadcast(first)).select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("name"), F.when(F.col("event_type") == F.col("first"), "transition").otherwise("state").alias("isa"))
    return lookup.neighbours(trace)


@query("q54_compatibility", """SELECT coalesce(a.name, b.name) AS name, a.name IS NOT NULL AS in_a, b.name IS NOT NULL AS in_b
FROM (SELECT DISTINCT p_brand AS name FROM part WHERE p_size < 3) a FULL JOIN (SELECT DISTINCT p_brand AS name FROM part WHERE p_size > 48) b ON a.name = b.name WHERE a.name IS NULL OR b.name IS NULL""")
def compatibility(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "name")
    return lookup.compatibility(part.where("p_size < 3"), part.where("p_size > 48"))


@query("q112_metrics_static", f"{MODELS} {metric_sql('SELECT name, attr, value AS t, static AS p FROM long JOIN s USING (name, attr)', 'name, attr')}")
def metrics_static(spark, sf_dir):
    return shown(assess.metrics(assess.predict_static(observations(spark, sf_dir).long()), KEYS), KEYS)


@query("q113_assess_lut", f"{MODELS} {metric_sql('SELECT name, attr, value AS t, lut AS p FROM long JOIN u USING (name, attr, status, quantity)', 'name, attr')}")
def assess_lut(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return shown(assess.metrics(assess.predict_lut(obs.long(), obs.params), KEYS), KEYS)


@query("q114_transition_energy", metric_sql("SELECT l_returnflag AS name, l_extendedprice AS t, l_quantity * 1400 AS p FROM lineitem", "name"))
def transition_energy(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("name"), F.col("l_extendedprice").alias("energy"), F.lit(1400).alias("power"), F.col("l_quantity").alias("duration"))
    return shown(assess.transition_energy(df), ["name"])


@query("q115_state_mix", f"""{MODELS}, e AS (SELECT name, avg(abs(value - static)) AS mae FROM long JOIN s USING (name, attr) WHERE attr = 'unit_price' GROUP BY name)
SELECT round(sqrt(sum((mae / (SELECT count(*) FROM e)) ** 2)), 5) AS error, 1.0::DOUBLE AS shares FROM e""")
def state_mix(spark, sf_dir):
    errors = assess.metrics(assess.predict_static(observations(spark, sf_dir).long()), KEYS, wanted=("mae",)).where("attr = 'unit_price'")
    return assess.state_mix_error(errors).select(r("error"), r("shares"))


@query("q116_trace_totals", """WITH x AS (SELECT user_id AS trace_id, value, event_id % 2 = 0 AS state, CASE WHEN event_id % 2 = 0 THEN 2.0 ELSE 0.5 END AS d FROM events)
SELECT trace_id, round(sum(CASE WHEN state THEN value * d ELSE value END), 5) AS energy, round(sum(CASE WHEN state THEN 50 * d ELSE 50 END), 5) AS predicted, round(sum(d), 5) AS duration FROM x GROUP BY trace_id""")
def trace_totals(spark, sf_dir):
    even = F.col("event_id") % 2 == 0
    t = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("trace_id"), F.when(even, "state").otherwise("transition").alias("isa"), F.col("value").alias("power"), F.lit(50.0).alias("predicted_power"),
        F.col("value").alias("energy"), F.lit(50.0).alias("predicted_energy"), F.when(even, 2.0).otherwise(0.5).alias("duration"),
    )
    return assess.trace_totals(t).select("trace_id", r("energy"), r("predicted"), r("duration"))


FOLDS = f"""WITH {OBS}, f AS (SELECT obs_id, name, status, quantity, unit_price AS value, ((row_number() OVER (PARTITION BY name ORDER BY obs_id) - 1) % 5)::INT AS fold FROM (SELECT obs_id, min(name) AS name, min(status) AS status, min(quantity) AS quantity, min(unit_price) AS unit_price FROM obs GROUP BY obs_id))"""


def unique(obs):
    """One row for an id, as folds need."""
    return obs.df.groupBy("obs_id").agg(*(F.min(c).alias(c) for c in ("name", "status", "quantity", "unit_price"))).withColumn("attr", F.lit("unit_price")).withColumnRenamed("unit_price", "value")


@query("q117_k_fold", f"""{FOLDS}, m AS (SELECT name, k AS fold, median(value) AS p FROM f, range(5) g(k) WHERE f.fold <> k GROUP BY name, k)
{metric_sql('SELECT name, value AS t, p FROM f JOIN m USING (name, fold)', 'name')}""")
def k_fold(spark, sf_dir):
    folds = assess.k_folds(unique(observations(spark, sf_dir)), 5)
    return shown(assess.cross_validate_static(folds, 5), ["name"])


@query("q118_config_fold", f"""WITH {OBS}, u AS (SELECT obs_id, min(name) AS name, min(status) AS status, min(quantity) AS quantity, min(unit_price) AS value FROM obs GROUP BY obs_id),
c AS (SELECT name, status, quantity, ((dense_rank() OVER (PARTITION BY name ORDER BY min(obs_id)) - 1) % 5)::INT AS fold FROM u GROUP BY name, status, quantity),
f AS (SELECT u.*, fold FROM u JOIN c USING (name, status, quantity)),
s AS (SELECT name, k AS fold, median(value) AS static FROM f, range(5) g(k) WHERE fold <> k GROUP BY name, k),
l AS (SELECT name, status, quantity, k AS fold, median(value) AS lut FROM f, range(5) g(k) WHERE fold <> k GROUP BY ALL)
{metric_sql('SELECT name, value AS t, coalesce(lut, static) AS p FROM f JOIN s USING (name, fold) LEFT JOIN l USING (name, status, quantity, fold)', 'name')}""")
def config_fold(spark, sf_dir):
    obs = observations(spark, sf_dir)
    folds = assess.config_folds(unique(obs), obs.params, 5)
    return shown(assess.cross_validate_lut(folds, obs.params, 5), ["name"])


REPETITIONS = 200
HASHES = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(assess.split_hashes(REPETITIONS)))


@query("q119_monte_carlo", f"""WITH {OBS}, u AS (SELECT obs_id, min(name) AS name, min(unit_price) AS value FROM obs GROUP BY obs_id),
x AS (SELECT name, rep, value, 3 * ((obs_id % {assess.PRIME} * a + b) % {assess.PRIME}) < {2 * assess.PRIME} AS train FROM u, (VALUES {HASHES}) h(rep, a, b)),
m AS (SELECT name, rep, median(value) AS p FROM x WHERE train GROUP BY ALL)
SELECT name, rep, count(*) AS n, round(avg(abs(value - p)), 5) AS mae, round(sqrt(avg((value - p) ** 2)), 5) AS rmsd,
  round(avg(abs(value - p) / ((abs(value) + abs(p)) / 2)) * 100, 5) AS smape FROM x JOIN m USING (name, rep) WHERE NOT train GROUP BY ALL""")
def monte_carlo(spark, sf_dir):
    """All 200 repetitions."""
    scored = assess.monte_carlo_static(unique(observations(spark, sf_dir)), REPETITIONS)
    return scored.select("name", "rep", "n", r("mae"), r("rmsd"), r("smape"))


@query("q120_quality_table", f"""{MODELS}, a AS (SELECT name, attr, avg(abs(value - static)) AS static_mae FROM long JOIN s USING (name, attr) GROUP BY ALL),
b AS (SELECT name, attr, avg(abs(value - lut)) AS lut_mae FROM long JOIN u USING (name, attr, status, quantity) GROUP BY ALL)
SELECT name, attr, round(static_mae, 5) AS static_mae, round(lut_mae, 5) AS lut_mae, CASE WHEN static_mae <= 1.1 * lut_mae THEN 'static' WHEN lut_mae < static_mae THEN 'lut' ELSE 'static' END AS use FROM a JOIN b USING (name, attr)""")
def quality_table(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return assess.quality_table(obs.long(), obs.params, wanted=("mae",)).select("name", "attr", r("static_mae"), r("lut_mae"), "use")


@query("q121_better_variant", """WITH a AS (SELECT l_returnflag AS name, avg(abs(l_extendedprice - l_quantity * 1400)) AS m FROM lineitem GROUP BY 1), b AS (SELECT l_returnflag AS name, avg(abs(l_extendedprice - 36000)) AS m FROM lineitem GROUP BY 1)
SELECT name, round(least(a.m, b.m), 5) AS mae, CASE WHEN b.m < a.m THEN 'relative' ELSE 'absolute' END AS better FROM a JOIN b USING (name)""")
def better_variant(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("name"), F.col("l_extendedprice").alias("value"), "l_quantity")
    a = assess.metrics(li.withColumn("predicted", F.col("l_quantity") * 1400), ["name"])
    b = assess.metrics(li.withColumn("predicted", F.lit(36000)), ["name"])
    return assess.best_of(a, b, ["name"]).select("name", r("mae"), "better")


@query("q122_outlier_comparison", f"""WITH {OBS}, m AS (SELECT name, avg(price) AS m, stddev_pop(price) AS s FROM obs GROUP BY name),
x AS (SELECT 'raw' AS tag, name, price FROM obs UNION ALL SELECT 'clean', name, price FROM obs JOIN m USING (name) WHERE abs(price - m) <= 1.5 * s),
s AS (SELECT tag, name, median(price) AS p FROM x GROUP BY ALL)
SELECT s.tag AS trained, x.tag AS tested, x.name, round(avg(abs(price - p)), 5) AS mae FROM x JOIN s USING (name) GROUP BY ALL""")
def outlier_comparison(spark, sf_dir):
    obs = observations(spark, sf_dir)
    price = type(obs)(obs.df, obs.params, ("price",))
    out = assess.outlier_comparison(price.long(), stats.remove_outliers(price, 1.5).long())
    return out.select("trained", "tested", "name", r("mae"))


@query("q123_t_test", """WITH g AS (SELECT l_linestatus AS g, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1)
SELECT round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)), 5) AS t, (a.n + b.n - 2)::BIGINT AS free FROM g a JOIN g b ON a.g < b.g""")
def t_test(spark, sf_dir):
    return assess.t_test(table(spark, sf_dir, "lineitem"), "l_linestatus", "l_extendedprice").select(r("t"), "free")


@query("q124_ks_test", """WITH v AS (SELECT l_extendedprice AS v, sum((l_linestatus = 'F')::INT) AS a, sum((l_linestatus <> 'F')::INT) AS b FROM lineitem GROUP BY 1),
c AS (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS fb FROM v)
SELECT round(max(abs(fa - fb)), 6) AS distance FROM c""")
def ks_test(spark, sf_dir):
    return assess.ks_distance(table(spark, sf_dir, "lineitem"), F.col("l_linestatus") == "F", "l_extendedprice").select(r("distance", 6))


@query("q125_overhead", "SELECT o_orderpriority AS file, o_orderstatus AS name, round(median(o_totalprice), 5) AS static FROM orders GROUP BY ALL")
def overhead(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("file"), F.col("o_orderstatus").alias("name"), F.lit("duration").alias("attr"), F.col("o_totalprice").alias("value"))
    return assess.overhead_summary(o).select("file", "name", r("static"))
