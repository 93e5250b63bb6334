"""Behaviour and workload queries (inventory 153-164, 169-170). A user's events are a run of calls."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugework.operators import behaviour, stats
from gaugework.plans.lineitem import LONG, observations, r8 as r
from gaugework.plans.registry import query, table

CALLS = "calls AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_type AS site, value, user_id % 3 AS mode FROM events)"


def calls(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return e.select(F.col("user_id").alias("run"), seq.alias("seq"), F.col("event_type").alias("site"), "value", F.pmod("user_id", F.lit(3)).alias("mode"))


def chat_calls(spark, sf_dir):
    """Turns of conversations, asked or answered by place: a behaviour that guards can tell."""
    c = table(spark, sf_dir, "conversations")
    n = F.count("*").over(Window.partitionBy("conv_id"))
    return c.select(F.col("conv_id").alias("run"), (F.col("turn") + 1).cast("int").alias("seq"), F.when(F.col("turn") % 2 == 0, "ask").otherwise("answer").alias("site"), n.cast("int").alias("turns"))


@query("q153_edges", f"""WITH {CALLS}, s AS (SELECT coalesce(lag(site) OVER w, '__init__') AS source, site AS target FROM calls WINDOW w AS (PARTITION BY run ORDER BY seq)
UNION ALL SELECT arg_max(site, seq), '__end__' FROM calls GROUP BY run) SELECT source, target, count(*) AS n FROM s GROUP BY ALL""")
def edges(spark, sf_dir):
    return behaviour.edge_configs(behaviour.learn_edges(calls(spark, sf_dir)), ["mode"]).select("source", "target", "n")


@query("q154_unroll", f"WITH {CALLS} SELECT run, seq::INT AS seq, site || ' #' || row_number() OVER (PARTITION BY run, site ORDER BY seq) AS site FROM calls")
def unroll(spark, sf_dir):
    return behaviour.unroll_loops(calls(spark, sf_dir)).select("run", "seq", "site")


@query("q155_meta_observations", f"WITH {CALLS} SELECT run, mode, round(sum(value), 8) AS latency FROM calls GROUP BY ALL")
def meta_observations(spark, sf_dir):
    _, latency = behaviour.meta_observations(calls(spark, sf_dir), ["mode"], ["value"], latency="value")
    return latency.select("run", "mode", r("latency"))


STEPS = """WITH c AS (SELECT conv_id AS run, turn AS seq, CASE WHEN turn % 2 = 0 THEN 'ask' ELSE 'answer' END AS site, count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations),
v AS (SELECT *, row_number() OVER (PARTITION BY run, site ORDER BY seq) AS visit FROM c),
e AS (SELECT run, turns, coalesce(lag(site) OVER w, '__init__') AS source, coalesce(lag(visit) OVER w, 1) AS visit, site AS target FROM v WINDOW w AS (PARTITION BY run ORDER BY seq)
  UNION ALL SELECT run, any_value(turns), arg_max(site, seq), arg_max(visit, seq), '__end__' FROM v GROUP BY run)"""


@query("q156_guards", f"""{STEPS} SELECT source, turns::INT AS turns, visit::INT AS visit, min(target) AS target FROM e GROUP BY ALL HAVING count(DISTINCT target) = 1""")
def guards(spark, sf_dir):
    """What the guards of all sites say of every configuration that leaves its site by one edge only."""
    edges_ = behaviour.learn_edges(chat_calls(spark, sf_dir))
    conf = edges_.select(F.col("source").alias("site"), "turns", "visit").distinct()
    told = behaviour.guarded(conf, behaviour.learn_guards(edges_, ["turns"]), ["turns"])
    return told.where(F.size("hits") == 1).select(F.col("site").alias("source"), "turns", "visit", F.get("hits", F.lit(0)).alias("target"))


@query("q159_validated_accuracy")
def validated_accuracy(spark, sf_dir):
    c = chat_calls(spark, sf_dir)
    return behaviour.validated_accuracy(c, ["turns"], limit=_longest(c), cut=50)


@query("q159_argument_errors", f"""WITH {CALLS}, f AS (SELECT run, ((row_number() OVER (ORDER BY run) - 1) % 10)::INT AS fold FROM (SELECT DISTINCT run FROM calls)),
r AS (SELECT site AS name, mode, value, fold FROM calls JOIN f USING (run)),
s AS (SELECT name, k AS fold, median(value) AS static FROM r, range(10) g(k) WHERE fold <> k GROUP BY name, k),
l AS (SELECT name, mode, k AS fold, median(value) AS lut FROM r, range(10) g(k) WHERE fold <> k GROUP BY ALL),
w AS (SELECT name, mode, median(value) AS p FROM r GROUP BY ALL),
a AS (SELECT name, count(*) AS count, round(avg(abs(p - value) / ((abs(p) + abs(value)) / 2)) * 100, 5) AS training FROM r JOIN w USING (name, mode) GROUP BY name),
b AS (SELECT name, round(avg(abs(coalesce(lut, static) - value) / ((abs(coalesce(lut, static)) + abs(value)) / 2)) * 100, 5) AS validation FROM r JOIN s USING (name, fold) LEFT JOIN l USING (name, mode, fold) GROUP BY name)
SELECT name, 'value' AS attr, count, training, validation FROM a JOIN b USING (name)""")
def argument_errors(spark, sf_dir):
    found = behaviour.argument_errors(calls(spark, sf_dir), ["value"], ["mode"])
    return found.select("name", "attr", "count", F.round("training", 5).alias("training"), F.round("validation", 5).alias("validation"))


@query("q157_nondeterminism", """WITH c AS (SELECT conv_id AS run, turn AS seq, CASE WHEN turn % 2 = 0 THEN 'ask' ELSE 'answer' END AS site, count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations),
v AS (SELECT *, row_number() OVER (PARTITION BY run, site ORDER BY seq) AS visit FROM c),
e AS (SELECT run, turns, coalesce(lag(site) OVER w, '__init__') AS source, coalesce(lag(visit) OVER w, 1) AS visit, site AS target FROM v WINDOW w AS (PARTITION BY run ORDER BY seq)
  UNION ALL SELECT run, any_value(turns), arg_max(site, seq), arg_max(visit, seq), '__end__' FROM v GROUP BY run)
SELECT source, turns::INT AS turns, visit::INT AS visit, count(DISTINCT target) AS targets FROM e GROUP BY ALL HAVING count(DISTINCT target) > 1""")
def nondeterminism(spark, sf_dir):
    return behaviour.nondeterministic(behaviour.learn_edges(chat_calls(spark, sf_dir)), ["turns"])


def _longest(calls) -> int:
    """Steps of the longest run, and one more to its end."""
    return (calls.agg(F.max("turns")).first()[0] or 0) + 1


#: The sites of each conversation in order; where all of one length agree, guards on the length tell them.
CHATS = """WITH c AS (SELECT conv_id AS run, turn, CASE WHEN turn % 2 = 0 THEN 'ask' ELSE 'answer' END AS site FROM conversations),
p AS (SELECT run, count(*) AS turns, string_agg(site, ' ' ORDER BY turn) AS path FROM c GROUP BY run)"""


@query("q158_trace_paths", f"{CHATS}, k AS (SELECT turns, min(path) AS path FROM p GROUP BY turns HAVING count(DISTINCT path) = 1) SELECT run, turns::INT AS turns, k.path, 'finished' AS state FROM p JOIN k USING (turns)")
def trace_paths(spark, sf_dir):
    return trace_prediction(spark, sf_dir).withColumn("path", F.array_join("path", " "))


@query("q158_trace_prediction")
def trace_prediction(spark, sf_dir):
    c = chat_calls(spark, sf_dir)
    g = behaviour.learn_guards(behaviour.learn_edges(c), ["turns"])
    return behaviour.predict_traces(c.select("run", "turns").distinct(), g, ["turns"], limit=_longest(c), cut=50)


@query("q159_trace_accuracy", f"{CHATS}, k AS (SELECT turns, count(DISTINCT path) AS paths FROM p GROUP BY turns) SELECT count(*) AS runs, avg((paths = 1)::INT::DOUBLE) AS exact FROM p JOIN k USING (turns)")
def trace_accuracy(spark, sf_dir):
    c = chat_calls(spark, sf_dir)
    g = behaviour.learn_guards(behaviour.learn_edges(c), ["turns"])
    return behaviour.trace_accuracy(behaviour.predict_traces(c.select("run", "turns").distinct(), g, ["turns"], limit=_longest(c), cut=50), c)


@query("q160_trace_costs", f"""WITH {CALLS}, l AS (SELECT site, mode, median(value) AS p FROM calls GROUP BY ALL), s AS (SELECT run, sum(value) AS t, sum(p) AS p FROM calls JOIN l USING (site, mode) GROUP BY run)
SELECT count(*) AS count, round(avg(abs(t - p)), 8) AS mae FROM s""")
def trace_costs(spark, sf_dir):
    rows = calls(spark, sf_dir).withColumn("name", F.col("site")).withColumn("attr", F.lit("value"))
    _, by_run = behaviour.trace_costs(rows, stats.lut_model(rows, ["mode"]), ["mode"], stats.static_model(rows))
    return by_run.select("count", r("mae"))


@query("q161_workload_cost", f"""WITH {LONG}, u AS (SELECT name, attr, status, quantity, median(value) AS lut FROM long GROUP BY ALL)
SELECT round(10 + (SELECT avg(lut) FROM u WHERE name = 'A' AND attr = 'price' AND quantity = 5) + (SELECT avg(lut) FROM u WHERE name = 'R' AND attr = 'price') / 2 + 1000 / (SELECT avg(lut) FROM u WHERE name = 'N' AND attr = 'unit_price' AND status = 'O' AND quantity = 7), 4) AS cost, 3::BIGINT AS events""")
def workload_cost(spark, sf_dir):
    obs = observations(spark, sf_dir)
    text = "A.price(quantity=5) + R.price() / 2 + 1000 / N.unit_price(status=O, quantity=7)"
    return behaviour.workload_cost(spark, text, stats.lut_model(obs.long(), obs.params), obs.params, 10.0).select(r("cost", 4), "events")


@query("q162_trace_pricing", """WITH t AS (SELECT user_id AS trace_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_type AS name, CASE WHEN event_id % 4 = 0 THEN event_id % 8 END AS lv, value FROM events),
c AS (SELECT *, last_value(lv IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY seq) AS level FROM t),
p AS (SELECT DISTINCT event_type AS name, (event_id % 8) AS level FROM events WHERE event_id % 4 = 0)
SELECT trace_id, round(sum(CASE WHEN seq % 2 = 0 THEN (length(c.name) + level) * value ELSE 3.0 END), 8) AS energy, round(sum(CASE WHEN seq % 2 = 0 THEN value ELSE 0 END), 8) AS duration FROM c GROUP BY trace_id""")
def trace_pricing(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    t = e.select(F.col("user_id").alias("trace_id"), seq.alias("seq"), F.col("event_type").alias("name"), F.when(F.col("event_id") % 4 == 0, F.col("event_id") % 8).alias("level"), F.col("value").alias("dwell")).withColumn("isa", F.when(F.col("seq") % 2 == 0, "state").otherwise("transition"))
    names = e.select(F.col("event_type").alias("name")).distinct().select("name", F.explode(F.array(F.lit(0).cast("long"), F.lit(4).cast("long"), F.lit(None).cast("long"))).alias("level"))
    power = names.select("name", "level", (F.length("name") + F.col("level")).cast("double").alias("power"), F.lit(1.0).alias("mae"))
    energy = names.select("name", "level", F.lit(3.0).alias("energy"), F.lit(0.5).alias("mae"))
    return behaviour.price_traces(t, power, energy, ["level"]).select("trace_id", r("energy"), r("duration"))


@query("q163_overflow_bounds", "SELECT round(65535 / max(value), 8) AS shortest, round(65535 / min(value) FILTER (value > 0), 8) AS longest FROM events")
def overflow_bounds(spark, sf_dir):
    return behaviour.overflow_bounds(table(spark, sf_dir, "events").select(F.col("value").alias("power")), 16).select(r("shortest"), r("longest"))


@query("q164_power_breakdown", """WITH p AS (SELECT user_id AS loop, event_type AS component, sum(value * (1 + event_id % 3)) AS e, sum(1 + event_id % 3) AS t FROM events GROUP BY ALL), m AS (SELECT loop, component, e / sum(t) OVER (PARTITION BY loop) AS power FROM p)
SELECT loop, component, round(power, 8) AS power, round(power / sum(power) OVER (PARTITION BY loop) * 100, 8) AS percent FROM m""")
def power_breakdown(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("loop"), F.col("event_type").alias("component"), F.col("value").alias("power"), (1 + F.col("event_id") % 3).alias("duration"))
    return behaviour.power_breakdown(e).select("loop", "component", r("power"), r("percent"))


TIMER = "SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position, event_id, value FROM events"


@query("q169_timer_log", f"SELECT file::VARCHAR AS file, position::INT AS position, (event_id % 7)::INT AS transition, round(greatest(floor(value) * 0.25 + (event_id % 2) * 16 - 2.5, 0), 8) AS duration, CAST(event_id % 5 AS VARCHAR) AS returned FROM ({TIMER})")
def timer_log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    body = e.select(F.col("user_id").cast("string").alias("file"), (F.col("event_id") + 2).alias("line_no"), F.format_string("[PTA] transition=%d prevcycles=%d/0 cycles=%d/%d return=%d", F.col("event_id") % 7, F.lit(8), F.floor("value"), F.col("event_id") % 2, F.col("event_id") % 5).alias("value"))
    users = e.select(F.col("user_id").cast("string").alias("file")).distinct()
    head = users.select("file", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("line_no"), F.lit("[PTA] nop=10/0").alias("value")), F.struct(F.lit(0).cast("long").alias("line_no"), F.lit("[PTA] benchmark start, id=1").alias("value")), F.struct(F.lit(1).cast("long").alias("line_no"), F.lit("[PTA] trace=3 count=9").alias("value")))).alias("x")).select("file", "x.*")
    return behaviour.parse_timer_log(head.unionByName(body), 0.25, 16.0).select("file", "position", "transition", r("duration"), "returned")


@query("q170_propagate", """WITH t AS (SELECT user_id AS trace_id, event_id AS seq, CASE WHEN event_id % 5 = 0 THEN value * 2 END AS v FROM events)
SELECT trace_id, seq, round(last_value(v IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY seq), 8) AS level FROM t""")
def propagate(spark, sf_dir):
    t = table(spark, sf_dir, "events").select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("name"), F.when(F.col("event_id") % 5 == 0, F.col("value").cast("string")).alias("returned"))
    return behaviour.propagate_returns(t, "level", formula=lambda c: c * 2).select("trace_id", "seq", r("level"))
