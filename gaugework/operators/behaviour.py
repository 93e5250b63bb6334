"""Call traces, their guards and costs, and timer logs (inventory 153-164, 169-170)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.observations import numeric
from gaugework.operators import assess, grove, lineage, lookup, trees
from gaugework.operators.scan import Scan

INIT, END = "__init__", "__end__"


def unroll_loops(calls: DataFrame, run: str = "run", site: str = "site", order: str = "seq") -> DataFrame:
    """154: sites named by how often the run has come there."""
    n = F.row_number().over(Window.partitionBy(run, site).orderBy(order))
    return calls.withColumn(site, F.concat(F.col(site), F.lit(" #"), n.cast("string")))


def learn_edges(calls: DataFrame, run: str = "run", site: str = "site", order: str = "seq", kernel: str | None = None) -> DataFrame:
    """153: steps from site to site in each run, from ``__init__`` to ``__end__``, with the visit number of the source.

    With a ``kernel`` column (null outside of kernels) each kernel starts again from the last site outside.
    """
    rows = Scan.of(calls, [run, site], order).numbered("_visit").rows().withColumn("_visit", F.col("_visit").cast("int"))
    if kernel is None:
        rows = Scan.of(rows, [run], order).shifted(1, _from=site, _v="_visit").shifted(-1, _next=site).rows().withColumn("_last", F.col("_next").isNull()).drop("_next")
    else:
        outside = F.when(F.col(kernel).isNull(), F.struct(F.col(site).alias("s"), F.col("_visit").alias("v")))
        rows = Scan.of(rows, [run], order).known(_known=outside).shifted(1, _o="_known").rows().drop("_known")
        inner = Scan.of(rows, [run, kernel], order).shifted(1, _s=site, _sv="_visit").shifted(-1, _next=site).numbered("_place").rows()
        first = F.col(kernel).isNull() | (F.col("_place") == 1)
        rows = inner.withColumns({"_from": F.when(first, F.col("_o.s")).otherwise(F.col("_s")), "_v": F.when(first, F.col("_o.v")).otherwise(F.col("_sv")), "_last": F.col("_next").isNull()}).drop("_s", "_sv", "_next", "_place")
    rest = [c for c in calls.columns if c not in (run, site, order)]
    steps = rows.select(run, *rest, F.col(order).alias("seq"), F.coalesce("_from", F.lit(INIT)).alias("source"), F.col(site).alias("target"), F.coalesce("_v", F.lit(1)).alias("visit"))
    ends = rows.where("_last").select(run, *rest, (F.col(order) + 1).alias("seq"), F.col(site).alias("source"), F.lit(END).alias("target"), F.col("_visit").alias("visit"))
    return steps.unionByName(ends)


def edge_configs(edges: DataFrame, params) -> DataFrame:
    """153: the edges, and the distinct configurations on each."""
    return edges.groupBy("source", "target").agg(F.count("*").alias("n"), F.count_distinct(F.struct(*params, "visit")).alias("configs"))


def meta_observations(calls: DataFrame, params, args, run: str = "run", latency: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """155: call arguments as observations by site and run configuration; latency summed by run."""
    rows = calls.select(F.col("site").alias("name"), *params, *args)
    return rows, None if latency is None else calls.groupBy(run, *params).agg(F.sum(latency).alias("latency"))


def nondeterministic(edges: DataFrame, params) -> DataFrame:
    """157: configurations that leave a site by more than one edge."""
    return edges.groupBy("source", *params, "visit").agg(F.count_distinct("target").alias("targets")).where("targets > 1")


def learn_guards(edges: DataFrame, params, keys=()) -> DataFrame:
    """156: source, keys and ``rules`` (target and path) of every site, from one keyed grove: no site is a job of its own.

    A tree tells a site's targets, by their numbers, from the parameters and the visit, on distinct configurations; paths
    that end at a single target are rules. ``keys`` may hold a fold.
    """
    by, sides = ["source", *keys], [*params, "visit"]
    conf = lineage.cut(edges.select(*by, "target", *sides).distinct())
    targets = lineage.cut(conf.select(*by, "target").distinct().withColumn("value", F.row_number().over(Window.partitionBy(*by).orderBy("target")).cast("double")))
    rows = conf.join(targets, [*by, "target"])
    grown = grove.prune(grove.grow(grove.moments(rows, sides, by), sides, by, threshold=0.0, relevant=False))
    found = grove.rules(grown, ordered=True).where("squares < 1e-9").withColumn("value", F.round("value"))
    named = found.join(targets, [*by, "value"])
    return lineage.cut(named.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("target", "path"))).alias("rules")))


def guarded(rows: DataFrame, guards: DataFrame, params, keys=(), site: str = "site") -> DataFrame:
    """156: ``rows`` (site, keys, params, visit) with ``hits``: the targets whose rules hold, none at an unknown site."""
    sides = [*params, "visit"]
    text = F.create_map(*(x for p in sides for x in (F.lit(p), trees._key(p))))
    number = F.create_map(*(x for p in sides for x in (F.lit(p), numeric(p))))

    def holds(step):
        x = F.try_element_at(F.col("_x"), step["param"])
        seen = F.array_contains(step["values"], F.try_element_at(F.col("_v"), step["param"]))
        return F.coalesce(F.when(step["values"].isNotNull(), seen).when(step["upto"].isNotNull(), x <= step["upto"]).otherwise(x > step["above"]), F.lit(False))

    met = rows.join(guards.withColumnRenamed("source", site), [site, *keys], "left").withColumns({"_v": text, "_x": number})
    hits = F.transform(F.filter("rules", lambda r: F.forall(r["path"], holds)), lambda r: r["target"])
    return met.withColumn("hits", F.array_distinct(F.coalesce(hits, F.array().cast("array<string>")))).drop("_v", "_x", "rules")


def predict_traces(runs: DataFrame, guards: DataFrame, params, limit: int = 100, cut: int = 10, keys=()) -> DataFrame:
    """158: walk all runs at once from ``__init__`` to ``__end__`` by the guards: a join an iteration.

    No match, or several, ends a run; runs that come to ``limit`` are marked unfinished. Visits
    are counted along the path. Lineage is cut in the shared folder every few steps.
    """
    now = runs.select("run", *keys, *params, F.lit(INIT).alias("site"), F.array().cast("array<string>").alias("path"), F.lit("open").alias("state"))
    done = None
    for step in range(limit):
        visit = F.when(F.col("site") == INIT, 1).otherwise(F.size(F.filter("path", lambda x: x == F.col("site"))))
        now = guarded(now.withColumn("visit", visit), guards, params, keys)
        now = now.withColumn("_n", F.when(F.size("hits") == 1, F.get("hits", F.lit(0))))
        state = F.when(F.col("_n").isNull(), "stuck").when(F.col("_n") == END, "finished").otherwise("open")
        now = now.withColumn("path", F.when(F.col("_n") != END, F.array_append("path", F.col("_n"))).otherwise(F.col("path"))).withColumn("state", state).withColumn("site", F.coalesce("_n", "site"))
        now = now.select("run", *keys, *params, "site", "path", "state")
        last = step == limit - 1
        if last or step % cut == cut - 1:
            now = lineage.cut(now)
        over = now if last else now.where("state <> 'open'")
        done = over if done is None else done.unionByName(over)
        now = now.where("state = 'open'")
        if last or step % cut == cut - 1 and now.isEmpty():
            break
    return done.select("run", *keys, *params, "path", F.when(F.col("state") == "open", "unfinished").otherwise(F.col("state")).alias("state"))


def fold_edges(edges: DataFrame, folds: DataFrame, params, k: int, run: str = "run") -> DataFrame:
    """159: the distinct edges that each fold's guards learn from, those of the runs of all other folds, with the fold.

    Configurations are copied, not runs: one goes to a fold if any run outside of it has it.
    """
    held = edges.join(folds.select(run, "fold"), run).groupBy("source", "target", *params, "visit").agg(F.collect_set("fold").alias("_f"))
    tests = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: F.exists("_f", lambda g: g != f))
    return held.select("source", "target", *params, "visit", F.explode(tests).alias("fold"))


def validated_accuracy(calls: DataFrame, params, k: int = 10, limit: int = 100, cut: int = 10, run: str = "run", order: str = "seq") -> DataFrame:
    """159: runs and share of exact sequences, in training and over ``k`` folds of runs, the guards of all folds from one grove."""
    edges = lineage.cut(learn_edges(calls, run=run, order=order))
    runs = calls.select(run, *params).distinct()
    folds = lineage.cut(assess.place_in_group(runs.withColumn("_all", F.lit(0)), ["_all"], run).select(run, (F.col("place") % k).cast("int").alias("fold")))
    tested = predict_traces(runs.join(folds, run), learn_guards(fold_edges(edges, folds, params, k, run), params, ("fold",)), params, limit, cut, ("fold",))
    trained = predict_traces(runs, learn_guards(edges, params), params, limit, cut)
    both = [trace_accuracy(p, calls, run, order).select(F.lit(tag).alias("part"), "runs", "exact") for tag, p in (("training", trained), ("validation", tested))]
    return both[0].unionByName(both[1])


def argument_errors(calls: DataFrame, args, params, k: int = 10, site: str = "site", run: str = "run") -> DataFrame:
    """159: smape of the arguments of each site, by medians of the run's configuration (else of the site), in training and over ``k`` folds of runs."""
    folds = assess.place_in_group(calls.select(run).distinct().withColumn("_all", F.lit(0)), ["_all"], run).select(run, (F.col("place") % k).cast("int").alias("fold"))
    long = calls.select(run, F.col(site).alias("name"), *params, *(F.col(a).cast("double").alias(a) for a in args)).unpivot([run, "name", *params], list(args), "attr", "value")
    rows = lineage.cut(long.join(folds, run))
    short = lambda m, tag: m.select("name", "attr", "count", F.col("smape").alias(tag))
    keys = ["name", "attr"]
    trained = assess.metrics(assess.predict_lut(rows, params), keys, wanted=("count", "smape"))
    return short(trained, "training").join(short(assess.cross_validate_lut(rows, params, k), "validation").drop("count"), keys)


def trace_accuracy(predicted: DataFrame, calls: DataFrame, run: str = "run", order: str = "seq") -> DataFrame:
    """159: share of runs whose whole sequence of sites is right."""
    true = calls.groupBy(run).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, "site"))), lambda x: x["site"]).alias("true"))
    return predicted.join(true, run).agg(F.count("*").alias("runs"), F.avg((F.col("path") == F.col("true")).cast("double")).alias("exact"))


def trace_costs(calls: DataFrame, lut: DataFrame, params, static: DataFrame, run: str = "run") -> tuple[DataFrame, DataFrame]:
    """160: predicted and observed attributes by call, and their sums by run."""
    by_call = lookup.lut_lookup(calls, lut, params, static)
    sums = by_call.groupBy(run).agg(F.sum("value").alias("value"), F.sum("predicted").alias("predicted"))
    return assess.metrics(by_call, ["name"]), assess.metrics(sums.withColumn("_all", F.lit("all")), ["_all"])


_EVENT = re.compile(r"\s*(?:(?P<mul>[\d.]+)\s*/\s*)?(?P<name>[\w]+)\.(?P<attr>\w+)\((?P<args>[^)]*)\)(?:\s*/\s*(?P<div>[\d.]+))?\s*")


def parse_workload(text: str) -> list[dict]:
    """161: the events of ``name.attr(p=v, ...)``, each maybe ``c / event`` or ``event / c``, joined by ``+``."""
    out = []
    for part in text.split("+"):
        m = _EVENT.fullmatch(part)
        if m is None:
            raise ValueError(f"no event: {part}")
        args = dict(a.strip().split("=", 1) for a in m["args"].split(",") if a.strip())
        out.append({"name": m["name"], "attr": m["attr"], "args": args, "mul": float(m["mul"]) if m["mul"] else None, "div": float(m["div"]) if m["div"] else None})
    return out


def workload_cost(spark, text: str, lut: DataFrame, params, init: float = 0.0) -> DataFrame:
    """161: init plus the sum over the events; parameters left out match anything."""
    events = parse_workload(text)
    kinds = dict(lut.dtypes)
    rows = spark.createDataFrame([(i, e["name"], e["attr"], e["mul"], e["div"], *(e["args"].get(p) for p in params)) for i, e in enumerate(events)], "id int, name string, attr string, mul double, div double, " + ", ".join(f"`{p}` string" for p in params))
    rows = rows.select("id", "name", "attr", "mul", "div", *(F.col(p).cast(kinds[p]).alias(p) for p in params))
    cost = F.when(F.col("mul").isNotNull(), F.col("mul") / F.col("predicted")).when(F.col("div").isNotNull(), F.col("predicted") / F.col("div")).otherwise(F.col("predicted"))
    return lookup.wildcard_lookup(rows, lut, params).agg((F.sum(cost) + init).alias("cost"), F.count("*").alias("events"))


def price_traces(trace: DataFrame, power: DataFrame, energy: DataFrame, params, run: str = "trace_id", order: str = "seq") -> DataFrame:
    """162: state power times dwell plus transition energy, by trace; parameters set once hold until set again; errors add in squares."""
    rows = Scan.of(trace, [run], order).known(**{f"_{p}": p for p in params}).rows().withColumns({p: F.col(f"_{p}") for p in params}).drop(*(f"_{p}" for p in params))
    cond = lambda side: [F.col(f"t.{k}").eqNullSafe(F.col(f"{side}.{k}")) for k in ("name", *params)]
    j = rows.alias("t").join(power.alias("p"), cond("p"), "left").join(energy.alias("e"), cond("e"), "left")
    state = F.col("t.isa") == "state"
    return j.groupBy(f"t.{run}").agg(
        F.sum(F.when(state, F.col("p.power") * F.col("t.dwell")).otherwise(F.col("e.energy"))).alias("energy"), F.sum(F.when(state, F.col("t.dwell")).otherwise(0.0)).alias("duration"),
        F.sqrt(F.sum(F.when(state, (F.col("p.mae") * F.col("t.dwell")) ** 2).otherwise(F.col("e.mae") ** 2))).alias("error"),
    )


def overflow_bounds(power: DataFrame, bits: int) -> DataFrame:
    """163: shortest and longest time until an energy counter overflows; without power it never does."""
    used, most = F.when(F.col("power") > 0, F.col("power")), F.lit(float(2**bits - 1))
    return power.agg((most / F.max(used)).alias("shortest"), (most / F.min(used)).alias("longest"))


def power_breakdown(df: DataFrame, loop: str = "loop", part: str = "component") -> DataFrame:
    """164: mean power of each component over a loop, and its share."""
    p = df.groupBy(loop, part).agg((F.sum(F.col("power") * F.col("duration"))).alias("_e"))
    total = df.groupBy(loop).agg(F.sum("duration").alias("_t"))
    mean = p.join(total, loop).select(loop, part, (F.col("_e") / F.col("_t")).alias("power"))
    return mean.withColumn("percent", F.col("power") / F.sum("power").over(Window.partitionBy(loop)) * 100)


_CYCLES = r"(\d+)/(\d+)"


def parse_timer_log(lines: DataFrame, cycle_us: float, overflow_us: float, max_overflow: int = 1 << 16, line: str = "value", order: str = "line_no", file: str = "file") -> DataFrame:
    """169: on-board timer logs to transition durations: a row for each transition of each trace and benchmark.

    Microseconds are cycles and overflows in time less those of an empty measurement, at least 0; too many
    overflows are an error. ``before`` is the duration of the state in front.
    """
    text = F.col(line)
    get = lambda pattern, g=1: F.regexp_extract(text, pattern, g)
    num = lambda c: c.try_cast("double")
    us = lambda pattern: num(get(pattern + _CYCLES)) * cycle_us + num(get(pattern + _CYCLES, 2)) * overflow_us
    rows = lines.where(text.startswith("[PTA]")).select(
        file, order,
        us(r"nop=").alias("_nop"), num(get(r"benchmark start, id=(\d+)")).alias("_id"), num(get(r"trace=(\d+)")).alias("_trace"),
        num(get(r"transition=(\d+)")).cast("int").alias("transition"), us(r"prevcycles=").alias("_prev"), us(r" cycles=").alias("_us"), num(get(r" cycles=" + _CYCLES, 2)).alias("_over"), F.nullif(get(r"return=(\S+)"), F.lit("")).alias("returned"),
    )
    rows = Scan.of(rows, [file], order).known(nop="_nop", benchmark="_id", trace="_trace").rows()
    rows = rows.withColumns({"nop": F.coalesce("nop", F.lit(0.0)), "benchmark": F.col("benchmark").cast("int"), "trace": F.col("trace").cast("int")})
    rows = Scan.of(rows.where("transition is not null"), [file, "benchmark", "trace"], order).numbered("position").rows()
    return rows.select(
        file, "benchmark", "trace", F.col("position").cast("int").alias("position"), "transition", F.greatest(F.col("_us") - F.col("nop"), F.lit(0.0)).alias("duration"), F.greatest(F.col("_prev") - F.col("nop"), F.lit(0.0)).alias("before"), "returned",
        F.when(F.col("_over") >= max_overflow, "timer overflow").alias("error"),
    )


def propagate_returns(trace: DataFrame, param: str, returned: str = "returned", formula=None, back_to: str | None = None, run: str = "trace_id", order: str = "seq") -> DataFrame:
    """170: a returned value (maybe by a formula) is a parameter of all later elements, and of those back to the last ``back_to``."""
    value = F.col(returned).try_cast("double")
    value = formula(value) if formula else value
    rows = Scan.of(trace.withColumn("_v", value), [run], order).known(_held="_v").rows()
    rows = rows.withColumn(param, F.coalesce("_held", param) if param in trace.columns else F.col("_held")).drop("_held")
    if back_to is not None:
        rows = Scan.of(rows, [run], order).summed(_part=(F.col("name") == back_to).cast("int")).rows()
        # The first value ahead is the last one known in the order turned round.
        turned = Scan.of(rows.withColumn("_back", -F.col(order)), [run, "_part"], "_back").known(_ahead="_v").rows()
        rows = turned.withColumn(param, F.when(F.col("_part") > 0, F.coalesce("_ahead", param)).otherwise(F.col(param))).drop("_part", "_back", "_ahead")
    return rows.drop("_v")
