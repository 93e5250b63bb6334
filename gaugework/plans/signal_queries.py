"""Signal queries (inventory 126-152, 165-168). A user's events are a signal; embeddings are short ones."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugework.operators import drift, signals
from gaugework.plans.lineitem import r8 as r
from gaugework.plans.registry import micros, query, table

SIG = "sig AS (SELECT user_id AS signal, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value, event_type, event_id, epoch_us(ts) / 1e6 AS t FROM events)"
GRAD = f"WITH {SIG}, g AS (SELECT *, CASE WHEN i = 0 THEN lead(value) OVER w - value WHEN lead(value) OVER w IS NULL THEN value - lag(value) OVER w ELSE (lead(value) OVER w - lag(value) OVER w) / 2 END AS gradient FROM sig WINDOW w AS (PARTITION BY signal ORDER BY i))"
RUN = """, f AS (SELECT *, value > 50 AS o FROM sig), n AS (SELECT *, coalesce(o <> lag(o) OVER (PARTITION BY signal ORDER BY i), true)::INT AS new FROM f),
k AS (SELECT *, sum(new) OVER (PARTITION BY signal ORDER BY i) AS run FROM n)"""


def sig(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return e.select(F.col("user_id").alias("signal"), i.alias("i"), "value", "event_type", "event_id", (micros("ts") / 1e6).alias("t"))


@query("q126_running_mean", f"WITH {SIG}, m AS (SELECT signal, i, avg(value) OVER w AS mean, count(*) OVER w AS n FROM sig WINDOW w AS (PARTITION BY signal ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) SELECT signal, i::INT AS i, round(mean, 8) AS mean FROM m WHERE n = 10")
def running_mean(spark, sf_dir):
    return signals.running_mean(sig(spark, sf_dir), 10).select("signal", "i", r("mean"))


@query("q127_threshold_points", f"{GRAD} SELECT signal, i::INT AS i, round(gradient, 8) AS gradient FROM g WHERE abs(gradient) > 20")
def threshold_points(spark, sf_dir):
    return signals.threshold_points(sig(spark, sf_dir), 20).select("signal", "i", r("gradient"))


@query("q128_edges", f"WITH {SIG}, l AS (SELECT signal, i, (value > 50)::INT AS level, lag((value > 50)::INT) OVER (PARTITION BY signal ORDER BY i) AS was FROM sig WHERE i >= 3) SELECT signal, (i + 2)::INT AS edge, level FROM l WHERE level <> was")
def edges(spark, sf_dir):
    return signals.edges(sig(spark, sf_dir), F.col("value") > 50, after=3)


@query("q129_calibration_edges", f"WITH {SIG}, u AS (SELECT signal, min(i) AS up FROM sig WHERE i >= 2 AND value > 60 GROUP BY signal) SELECT signal, up::INT AS up, min(i)::INT AS down FROM sig JOIN u USING (signal) WHERE i > up + 4 AND value < 40 GROUP BY signal, up")
def calibration_edges(spark, sf_dir):
    return signals.calibration_edges(sig(spark, sf_dir), 2, 100.0, 4)


@query("q130_calibration", f"WITH {SIG} SELECT signal, round(avg(CASE WHEN value < 50 THEN 0 + (value - 10) * (2.0 / 40) ELSE 2 + (value - 50) * (10.0 / 40) END), 6) AS current FROM sig GROUP BY signal")
def calibration(spark, sf_dir):
    c = signals.calibration_function(F.col("value"), [(10.0, 0.0), (50.0, 2.0), (90.0, 12.0)])
    return sig(spark, sf_dir).groupBy("signal").agg(F.round(F.avg(c), 6).alias("current"))


@query("q131_charge_to_current", f"WITH {SIG} SELECT signal, round(avg(value * (1.836 / (330.0 * 65535))) * 1e6, 6) AS current FROM sig GROUP BY signal")
def charge_to_current(spark, sf_dir):
    return sig(spark, sf_dir).groupBy("signal").agg(F.round(F.avg(signals.charge_to_current(F.col("value"), 330.0)) * 1e6, 6).alias("current"))


SEG = f"""WITH {SIG}, e AS (SELECT *, coalesce((value > 50) <> lag(value > 50) OVER (PARTITION BY signal ORDER BY i), false)::INT AS edge FROM sig),
s AS (SELECT signal, value, sum(edge) OVER (PARTITION BY signal ORDER BY i) AS segment FROM e),
t AS (SELECT signal, segment, avg(value) AS mean, count(*) AS duration, avg((value >= 90)::INT) AS clip_rate FROM s GROUP BY ALL)"""


def _segments(spark, sf_dir):
    rows = sig(spark, sf_dir)
    w = Window.partitionBy("signal").orderBy("i")
    edge = F.coalesce((F.col("value") > 50) != F.lag(F.col("value") > 50).over(w), F.lit(False))
    return signals.segment_table(signals.segments(rows.withColumn("_edge", edge), F.col("_edge")), 90.0)


@query("q132_segmentation", f"{SEG} SELECT signal, segment::BIGINT AS segment, round(mean, 8) AS mean, duration, round(clip_rate, 8) AS clip_rate, round(mean - lag(mean) OVER w, 8) AS to_prev, lag(duration) OVER w AS timeout FROM t WINDOW w AS (PARTITION BY signal ORDER BY segment)")
def segmentation(spark, sf_dir):
    return _segments(spark, sf_dir).select("signal", "segment", r("mean"), "duration", r("clip_rate"), r("to_prev"), "timeout")


@query("q133_segment_validation", f"{SEG} SELECT CASE WHEN clip_rate > 0 THEN 'clipped' WHEN duration < 1 OR duration > 3 THEN 'wrong duration' END AS reason, count(*) AS n FROM t GROUP BY 1")
def segment_validation(spark, sf_dir):
    t = _segments(spark, sf_dir)
    plan = t.select("signal", "segment", F.lit(2.0).alias("planned"), F.col("is_state").alias("planned_state"), F.lit(False).alias("near_interrupt"))
    return signals.validate_segments(t, plan).groupBy("reason").agg(F.count("*").alias("n"))


@query("q134_sync_pulses", f"WITH {SIG}{RUN}, p AS (SELECT signal, run, min(i) AS a, max(i) AS b FROM k WHERE o GROUP BY signal, run HAVING max(i) - min(i) > 1 AND max(i) - min(i) < 9), c AS (SELECT *, count(*) OVER (PARTITION BY signal) AS n FROM p) SELECT signal, (row_number() OVER (PARTITION BY signal ORDER BY a))::INT AS pulse, a::INT AS start, b::INT AS \"end\" FROM c WHERE n = 3")
def sync_pulses(spark, sf_dir):
    return signals.sync_pulses(sig(spark, sf_dir), 50, 1, 9)


@query("q135_clock_rescale", f"WITH {SIG}, m AS (SELECT signal, max(i) AS m, count(*) AS n FROM sig GROUP BY signal) SELECT signal, i::INT AS i, round(10 + (i + 1) / n * m, 8) AS time FROM sig JOIN m USING (signal)")
def clock_rescale(spark, sf_dir):
    rows = sig(spark, sf_dir)
    m = rows.groupBy("signal").agg(F.max("i").alias("m"))
    pulses = m.select("signal", F.lit(1).alias("pulse"), F.lit(0).alias("start"), F.lit(10).alias("end")).union(m.select("signal", F.lit(2), F.col("m") + 10, F.col("m") + 20))
    return signals.rescale_clock(rows.withColumn("planned", F.lit(1.0)), pulses).select("signal", "i", r("time"))


@query("q136_cut_at_times", f"WITH {SIG} SELECT a.event_id, count(b.t)::BIGINT AS segment FROM sig a LEFT JOIN sig b ON a.signal = b.signal AND b.event_type = 'error' AND b.t <= a.t WHERE a.event_type <> 'error' GROUP BY a.event_id")
def cut_at_times(spark, sf_dir):
    rows = sig(spark, sf_dir)
    samples = rows.where("event_type <> 'error'").select("signal", "t", F.col("event_id").cast("double").alias("value"))
    return signals.cut_at_times(samples, rows.where("event_type = 'error'").select("signal", "t")).select(F.col("value").cast("long").alias("event_id"), F.coalesce("segment", F.lit(0)).alias("segment"))


@query("q137_trim", f"WITH {SIG}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY signal ORDER BY t) > 86400 AS gap FROM sig), l AS (SELECT signal, min(t) FILTER (WHERE gap) AS a, max(t) FILTER (WHERE gap) AS b FROM g GROUP BY signal HAVING count(*) >= 12) SELECT signal, count(*) AS n FROM sig JOIN l USING (signal) WHERE t >= a AND t < b GROUP BY signal")
def trim(spark, sf_dir):
    return signals.trim_at_gaps(sig(spark, sf_dir), 86400.0).groupBy("signal").agg(F.count("*").alias("n"))


@query("q138_offline_attributes", f"WITH {SIG} SELECT event_id, round(value * 1e6 * (1e6 - CASE WHEN i % 2 = 1 THEN 20 ELSE 0 END) / 1e9, 8) AS energy FROM sig")
def offline_attributes(spark, sf_dir):
    rows = sig(spark, sf_dir).select("event_id", F.when(F.col("i") % 2 == 1, "transition").otherwise("state").alias("isa"), F.lit(1.0).alias("duration_s"), F.col("value").alias("power_w"), F.lit(0.0).alias("prev_power"), F.lit(0.0).alias("next_power"))
    return signals.offline_attributes(rows).select("event_id", F.round(F.col("energy") / 1e9, 8).alias("energy"))


@query("q139_traces_to_aggregate", f"WITH {SIG} SELECT event_type AS name, count(*) AS n, count(CASE WHEN i % 2 = 1 THEN value END) AS energies FROM sig WHERE i > 0 GROUP BY 1")
def traces_to_aggregate(spark, sf_dir):
    rows = sig(spark, sf_dir).select(F.col("signal").alias("trace_id"), F.col("i").alias("seq"), F.when(F.col("i") == 0, "UNINITIALIZED").otherwise(F.col("event_type")).alias("name"), F.when(F.col("i") % 2 == 1, "transition").otherwise("state").alias("isa"), F.col("value").alias("energy"))
    return signals.traces_to_aggregate(rows).groupBy("name").agg(F.count("*").alias("n"), F.count("energy").alias("energies"))


@query("q140_concat_traces", "WITH u AS (SELECT DISTINCT user_id FROM events), n AS (SELECT s, user_id, row_number() OVER (ORDER BY s, user_id) AS trace_id FROM u, range(2) g(s)) SELECT trace_id::BIGINT AS trace_id, user_id AS orig_id, count(*) AS n FROM n JOIN events USING (user_id) GROUP BY ALL")
def concat_traces(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("trace_id"), "event_id")
    return signals.concat_traces(e, e).groupBy("trace_id", "orig_id").agg(F.count("*").alias("n"))


@query("q141_normalise", f"WITH {SIG} SELECT event_id, round(value / max(abs(value)) OVER (PARTITION BY signal) * 25, 8) AS value FROM sig")
def normalise(spark, sf_dir):
    return signals.normalise(sig(spark, sf_dir)).select("event_id", r("value"))


@query("q142_resample", f"WITH {SIG}, l AS (SELECT signal, arg_max(value, i) AS last FROM sig GROUP BY signal) SELECT signal, (i // 4)::BIGINT AS i, round((sum(value) + (4 - count(*)) * any_value(last)) / 4, 8) AS value FROM sig JOIN l USING (signal) GROUP BY signal, i // 4")
def resample(spark, sf_dir):
    return signals.down_sample(sig(spark, sf_dir), 4).select("signal", "i", r("value"))


@query("q142_up_sample", f"WITH {SIG}, n AS (SELECT signal, i, value, coalesce(lead(value) OVER (PARTITION BY signal ORDER BY i), value) AS nx FROM sig) SELECT signal, (i * 3 + k)::INT AS i, round(value + (nx - value) * k / 3, 8) AS value FROM n, range(3) g(k)")
def up_sample(spark, sf_dir):
    return signals.up_sample(sig(spark, sf_dir), 3).select("signal", "i", r("value"))


@query("q143_refinement", f"WITH {SIG}, b AS (SELECT signal, min(i) + 2 AS a, max(i) - 2 AS z FROM sig GROUP BY signal), q AS (SELECT signal, quantile_cont(value, 0.01) AS l, median(value) AS m, quantile_cont(value, 0.99) AS h FROM sig JOIN b USING (signal) WHERE i BETWEEN a AND z GROUP BY signal) SELECT 'all' AS name, count(*) AS signals, round(avg((m - l > 40 OR h - m > 40)::INT), 8) AS share FROM q")
def refinement(spark, sf_dir):
    return signals.needs_refinement(sig(spark, sf_dir).withColumn("name", F.lit("all")), edge=2, limit=40.0).select("name", "signals", r("share"))


@query("q145_change_points")
def change_points(spark, sf_dir):
    return signals.detect_changes(sig(spark, sf_dir), range(1, 89), min_distance=3)


#: The whole dynamic programme in SQL: deviations of all stretches of three samples or more, and a step of the recursion for each end.
PROGRAMME = f"""WITH RECURSIVE {SIG}, v AS (SELECT signal, list(value::DOUBLE ORDER BY i) AS v, count(*) AS n FROM sig GROUP BY signal),
p AS (SELECT signal, n, s, t, v[s + 1 : t] AS x FROM v, range(200) a(s), range(201) b(t) WHERE t <= n AND t >= 1 AND (t - s >= 3 OR (s = 0 AND t = n)) AND (s = 0 OR s >= 3)),
c AS (SELECT signal, n, t, list(s ORDER BY s) AS s, list(list_sum(list_transform(x, lambda y: abs(y - list_median(x)))) ORDER BY s) AS c FROM p GROUP BY ALL),
f(signal, n, t, pen, best) AS (
  SELECT signal, n, 0::BIGINT, pen, [-pen::DOUBLE] FROM v, range(1, 89) g(pen)
  UNION ALL
  SELECT f.signal, f.n, f.t + 1, pen, list_append(best, coalesce(list_min(list_transform(list_zip(c.s, c.c), lambda z: best[z[1] + 1] + z[2])) + pen, 1e300))
  FROM f LEFT JOIN c ON c.signal = f.signal AND c.t = f.t + 1 WHERE f.t < f.n),
total AS (SELECT f.signal, pen::DOUBLE AS penalty, best[f.n + 1] AS total, c.c[1] AS whole FROM f JOIN c ON c.signal = f.signal AND c.t = f.n WHERE f.t = f.n)"""


@query("q145_change_totals", f"{PROGRAMME} SELECT signal, penalty, round(total, 5) AS total FROM total")
def change_totals(spark, sf_dir):
    """No other change points cost less: the totals are those of the whole programme."""
    runs = signals.detect_runs(sig(spark, sf_dir), range(1, 89), min_distance=3)
    return signals.change_totals(runs).select("signal", "penalty", r("total", 5))


@query("q144_refinement_by_changes", f"{PROGRAMME} SELECT count(*) AS signals, round(avg((total < whole - 1e-7)::INT), 8) AS share FROM total WHERE penalty = 20")
def refinement_by_changes(spark, sf_dir):
    found = signals.detect_changes(sig(spark, sf_dir), [20.0], min_distance=3)
    return found.agg(F.count("*").alias("signals"), F.round(F.avg((F.size("changes") > 0).cast("double")), 8).alias("share"))


@query("q146_plateau_penalty")
def plateau_penalty(spark, sf_dir):
    return signals.plateau_penalty(signals.detect_changes(sig(spark, sf_dir), range(1, 89), min_distance=3))


@query("q147_substates")
def substates(spark, sf_dir):
    rows = sig(spark, sf_dir).withColumn("name", F.pmod("signal", F.lit(5)))
    found = signals.detect_changes(rows, range(1, 89), keys=["name", "signal"], min_distance=3)
    chosen = signals.plateau_penalty(found, ["name", "signal"])
    return signals.substates(rows, found.join(chosen, ["name", "signal", "penalty"]))


@query("q148_substate_clusters")
def substate_clusters(spark, sf_dir):
    lut = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("name"), F.col("l_quantity").alias("quantity")).agg((F.avg("l_discount") * 5000).alias("duration"), F.avg("l_extendedprice").alias("power"))
    return signals.cluster_substates(lut, limits=(50.0, 5000.0))


def _expected(rows):
    return rows.where("event_type = 'signup'").select("signal", F.col("event_id").alias("event"), "t")


@query("q149_drift_candidates")
def drift_candidates(spark, sf_dir):
    rows = sig(spark, sf_dir)
    return signals.drift_candidates(rows, _expected(rows), [1.0, 2.0, 5.0, 10.0, 15.0, 20.0], 400_000.0)


def _drifts(spark, sf_dir):
    return sig(spark, sf_dir).select("signal", F.floor(F.col("i") / 3).alias("event"), ((F.col("value") - 50) / 1e5).alias("drift"))


@query("q150_drift_min_path")
def drift_min_path(spark, sf_dir):
    return drift.compensate(_drifts(spark, sf_dir))


@query("q150_drift_cost", f"""WITH RECURSIVE {SIG}, x AS (SELECT signal, i // 3 AS event, list((value - 50) / 1e5) AS xs FROM sig GROUP BY ALL),
g(signal, event, d, c) AS (SELECT DISTINCT signal, 0::BIGINT, [0.0::DOUBLE], [0.0::DOUBLE] FROM x UNION ALL
  SELECT g.signal, g.event + 1, list_concat(g.d, x.xs), list_concat(list_transform(g.c, lambda a: a + 270e-6),
    list_transform(x.xs, lambda y: list_min(list_transform(list_zip(g.d, g.c), lambda z: z[2] + abs(z[1] - y))))) FROM g JOIN x ON x.signal = g.signal AND x.event = g.event)
SELECT signal, count(*) - 1 AS events, round(arg_max(list_min(c), event) * 1e3, 6) AS cost FROM g GROUP BY signal""")
def drift_cost(spark, sf_dir):
    """What each run's path costs, against the least cost over all paths."""
    found = drift.compensate(_drifts(spark, sf_dir), block=48)
    was = F.lag("drift", 1, 0.0).over(Window.partitionBy("signal").orderBy("event"))
    step = F.when(F.col("taken"), F.abs(F.col("drift") - was)).otherwise(drift.SKIP)
    return found.withColumn("step", step).groupBy("signal").agg(F.count("*").alias("events"), F.round(F.sum("step") * 1e3, 6).alias("cost"))


@query("q151_greedy_drift", f"WITH RECURSIVE {SIG}, g(signal, event, d) AS (SELECT DISTINCT signal, -1::BIGINT, 0.0::DOUBLE FROM sig UNION ALL SELECT g.signal, s.i, CASE WHEN abs((s.value - 50) / 1e5 - g.d) < 0.0005 THEN (s.value - 50) / 1e5 ELSE g.d END FROM g JOIN sig s ON s.signal = g.signal AND s.i = g.event + 1) SELECT signal, event, round(d * 1e3, 6) AS drift FROM g WHERE event >= 0")
def greedy_drift(spark, sf_dir):
    rows = sig(spark, sf_dir).select("signal", F.col("i").cast("long").alias("event"), ((F.col("value") - 50) / 1e5).alias("drift"))
    return signals.greedy_drift(rows).select("signal", "event", F.round(F.col("drift") * 1e3, 6).alias("drift"))


@query("q152_drift_from_states", f"WITH {SIG}, w AS (SELECT a.signal, a.event_id AS event, count(*) AS n, avg(b.t - a.t) AS d FROM sig a JOIN sig b ON a.signal = b.signal AND b.event_type <> 'signup' AND b.t BETWEEN a.t - 40000 AND a.t + 40000 WHERE a.event_type = 'signup' GROUP BY ALL), e AS (SELECT s.signal, event_id AS event, CASE WHEN n = 2 THEN d END AS d FROM (SELECT signal, event_id FROM sig WHERE event_type = 'signup') s LEFT JOIN (SELECT event, n, d FROM w) w ON w.event = event_id) SELECT e.signal, e.event, round(coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY e.signal ORDER BY e.event), 0), 3) AS drift FROM e")
def drift_from_states(spark, sf_dir):
    rows = sig(spark, sf_dir)
    return signals.drift_from_states(rows.where("event_type <> 'signup'"), _expected(rows), 40_000.0).select("signal", "event", r("drift", 3))


@query("q165_peaks", f"WITH {SIG}, a AS (SELECT *, avg(value) OVER (PARTITION BY signal) AS th, max(i) OVER (PARTITION BY signal) AS z FROM sig), f AS (SELECT *, value >= th AS o, avg(CASE WHEN value < th THEN value END) OVER (PARTITION BY signal) AS base FROM a), n AS (SELECT *, coalesce(o <> lag(o) OVER (PARTITION BY signal ORDER BY i), true)::INT AS new FROM f), k AS (SELECT *, sum(new) OVER (PARTITION BY signal ORDER BY i) AS run FROM n) SELECT signal, min(i)::INT AS start, count(*) AS n, round(sum(value), 8) AS energy, round(sum(value) - count(*) * any_value(base), 8) AS energy_over_baseline FROM k WHERE o GROUP BY signal, run HAVING max(i) < any_value(z)")
def peaks(spark, sf_dir):
    return signals.peaks(sig(spark, sf_dir)).select("signal", "start", "n", r("energy"), r("energy_over_baseline", 8))


@query("q166_threshold_for_peaks", f"WITH {SIG}, e AS (SELECT signal, i, value >= th AS o, th::DOUBLE AS threshold FROM sig, range(50, 100, 5) g(th)), n AS (SELECT *, o AND coalesce(NOT lag(o) OVER (PARTITION BY signal, threshold ORDER BY i), true) AS new FROM e), c AS (SELECT signal, threshold, count(*) FILTER (WHERE new) AS n FROM n GROUP BY ALL) SELECT signal, min(threshold) AS threshold FROM c WHERE n = 5 GROUP BY signal")
def threshold_for_peaks(spark, sf_dir):
    return signals.threshold_for_peaks(sig(spark, sf_dir), range(50, 100, 5), 5)


@query("q167_channel_summary", f"WITH {SIG}, b AS (SELECT *, (min(value) OVER (PARTITION BY signal) + max(value) OVER (PARTITION BY signal)) / 2 AS border FROM sig) SELECT signal, round(min(value), 8) AS least, round(max(value), 8) AS most, round(avg(CASE WHEN value > border THEN value END), 8) AS high, round(avg(CASE WHEN value <= border THEN value END), 8) AS low FROM b GROUP BY signal")
def channel_summary(spark, sf_dir):
    return signals.channel_summary(sig(spark, sf_dir)).select("signal", r("least"), r("most"), r("high"), r("low"))


@query("q168_compare_steps", f"""WITH {SIG}, fa AS (SELECT signal, min(i) AS f FROM sig WHERE value > 20 GROUP BY signal), fb AS (SELECT signal, min(i) AS f FROM sig WHERE value * 1.01 > 20 GROUP BY signal),
a AS (SELECT signal, i - f AS k, value FROM sig JOIN fa USING (signal) WHERE i >= f), b AS (SELECT signal, i - f AS k, value * 1.01 AS vb FROM sig JOIN fb USING (signal) WHERE i >= f),
p AS (SELECT *, CASE WHEN abs(value - lag(value) OVER (PARTITION BY signal ORDER BY k)) > 30 THEN k END AS s FROM a),
q AS (SELECT *, max(s) OVER (PARTITION BY signal ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM p),
t AS (SELECT signal, k, value, sum((s IS NOT NULL AND (prev IS NULL OR s - prev > 2))::INT) OVER (PARTITION BY signal ORDER BY k) AS step FROM q)
SELECT signal, step::BIGINT AS step, round(avg(value), 8) AS mean_a, round(avg(vb), 8) AS mean_b, count(*) AS n FROM t JOIN b USING (signal, k) GROUP BY signal, step""")
def compare_steps(spark, sf_dir):
    rows = sig(spark, sf_dir)
    steps = signals.compare_steps(rows, rows.withColumn("value", F.col("value") * 1.01), 20.0, 30.0, 2)
    return steps.select("signal", "step", r("mean_a"), r("mean_b"), "n")
