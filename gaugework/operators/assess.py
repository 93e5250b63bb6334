"""Error metrics, validation and comparison of models (inventory 110-125)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.operators import stats
from gaugework.operators.lineage import broadcast_if_small, written
from gaugework.operators.lookup import lut_lookup

METRICS = ("count", "mae", "mape", "smape", "p50", "p90", "p95", "p99", "msd", "rmsd", "ssr", "rsq")


def _errors(t: Column, p: Column, total, mean, count: Column, spread: Column) -> dict[str, Column]:
    """The aggregates of truth and prediction that need no order."""
    err = F.abs(p - t)
    ssr = total(err * err)
    return {
        "count": count,
        "mae": mean(err),
        "mape": F.when(F.bool_and(t != 0), mean(F.when(t != 0, err / F.abs(t))) * 100),
        "smape": mean(F.when((t == 0) & (p == 0), 0.0).otherwise(err / ((F.abs(t) + F.abs(p)) / 2))) * 100,
        "msd": mean(err * err),
        "rmsd": F.sqrt(mean(err * err)),
        "ssr": ssr,
        "rsq": F.when(spread > 0, 1 - ssr / F.when(spread > 0, spread)).when(ssr == 0, 1.0).otherwise(0.0),
    }


def metrics(df: DataFrame, keys, truth: str = "value", predicted: str = "predicted", wanted=METRICS, weight: str | None = None) -> DataFrame:
    """112: all error metrics of each group: one aggregation, and exact percentiles from counts if these are ``wanted``.

    mape is null unless every truth is other than 0; smape counts 0/0 as 0; rsq of a constant
    truth is 1 if it is met and 0 otherwise. Rows without prediction do not count. With ``weight``, a row stands for so many equal ones.
    """
    t, p = F.col("_t"), F.col("_p")
    err = F.abs(p - t)
    rows = df.select(*keys, F.col(truth).cast("double").alias("_t"), F.col(predicted).cast("double").alias("_p"), (F.lit(1) if weight is None else F.col(weight)).alias("_w")).where(t.isNotNull() & p.isNotNull())
    if weight is None:
        total, mean, count, spread = F.sum, F.avg, F.count("*"), F.var_pop("_t") * F.count("*")
    else:
        # Squares are taken about a value near the mean, so that nothing cancels; a constant truth has none at all.
        origin = written(rows.groupBy(*keys).agg((F.sum(F.col("_w") * t) / F.sum("_w")).alias("_o")))
        rows = rows.alias("r").join(broadcast_if_small(origin).alias("o"), stats._same(list(keys), "r", "o") or F.lit(True)).select("r.*", "_o")
        w, d, count = F.col("_w"), t - F.col("_o"), F.sum("_w")
        total, mean = (lambda c: F.sum(w * c)), (lambda c: F.sum(w * c) / F.sum(F.when(c.isNotNull(), w)))
        spread = F.when(F.min(t) == F.max(t), 0.0).otherwise(F.sum(w * d * d) - F.sum(w * d) * F.sum(w * d) / count)
    out = rows.groupBy(*keys).agg(*(c.alias(m) for m, c in _errors(t, p, total, mean, count, spread).items()))
    if not set(METRICS[4:8]) & set(wanted):
        return out.select(*keys, *wanted)
    counts = written(rows.groupBy(*keys, err.alias("_v")).agg(F.sum("_w").alias("_c")))
    q = stats.count_percentiles(counts, keys, [0.5, 0.9, 0.95, 0.99]).select(*keys, F.col("q__c").alias("_q"))
    out = out.alias("m").join(broadcast_if_small(written(q)).alias("e"), [F.col(f"m.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]).select("m.*", "_q")
    return out.withColumns({m: F.col("_q")[i] for i, m in enumerate(METRICS[4:8])}).select(*keys, *wanted)


def wide_metrics(df: DataFrame, keys, predicted: dict[str, str], truth: str = "value", wanted=("count", "mae", "smape", "rmsd", "rsq")) -> DataFrame:
    """112 for several predictions of a row at once: ``<tag>_<metric>`` for each tag and its column, in one pass, settled. A prediction that is null does not count. No percentiles."""
    rows = df.select(*keys, F.col(truth).cast("double").alias("_t"), *(F.col(c).cast("double").alias(f"_p{i}") for i, c in enumerate(predicted.values()))).where("_t is not null")
    out = []
    for i, tag in enumerate(predicted):
        p = F.col(f"_p{i}")
        t = F.when(p.isNotNull(), F.col("_t"))
        made = _errors(t, p, F.sum, F.avg, F.count(t), F.var_pop(t) * F.count(t))
        out += [made[m].alias(f"{tag}_{m}") for m in wanted]
    return written(rows.groupBy(*keys).agg(*out))


def predict_static(long: DataFrame, train: DataFrame | None = None, keys=("name", "attr")) -> DataFrame:
    """110: every row with its static value."""
    model = stats.static_model(long if train is None else train, keys)
    return long.join(broadcast_if_small(written(model.select(*keys, F.col("static").alias("predicted")))), list(keys))


def predict_lut(long: DataFrame, params, train: DataFrame | None = None, keys=("name", "attr")) -> DataFrame:
    """110: every row with its configuration's value, or the static one."""
    train = long if train is None else train
    return lut_lookup(long, written(stats.lut_model(train, params, keys)), params, written(stats.static_model(train, keys)), keys)


def quality_table(long: DataFrame, params, model: DataFrame | None = None, wanted=("mae", "smape", "rsq")) -> DataFrame:
    """120: errors of lookup table, model (if given, with ``predicted``) and static value, and which one to use. Without metrics beside the mae, rows are read for the medians only."""
    keys = ["name", "attr"]
    wanted = tuple(dict.fromkeys(("mae", *wanted)))
    # Both models are a few medians; no group of rows meets in one task.
    static, lut = stats.middles(long.where("value is not null"), keys, params)
    if wanted == ("mae",):
        mae = F.sum("dev") / F.sum("n")
        out = static.groupBy(*keys).agg(mae.alias("static_mae")).join(lut.groupBy(*keys).agg(mae.alias("lut_mae")), keys)
    else:
        both = written(lut.drop("n", "dev").join(static.drop("n", "dev"), keys))
        rows = long.select(*keys, *params, "value").alias("r").join(broadcast_if_small(both).alias("b"), stats._same([*keys, *params], "r", "b")).select(*(f"r.{k}" for k in keys), "value", "static", "lut")
        out = wide_metrics(rows, keys, {"static": "static", "lut": "lut"}, wanted=wanted)
    model_mae = F.lit(None).cast("double")
    if model is not None:
        out = out.join(metrics(model, keys, wanted=wanted).withColumnsRenamed({m: f"model_{m}" for m in wanted}), keys, "left")
        model_mae = F.col("model_mae")
    verdict = F.when(F.coalesce(model_mae, F.col("static_mae")) <= F.least(F.col("static_mae"), 1.1 * F.col("lut_mae")), F.when(model_mae.isNull(), "static").otherwise("model")).when(F.col("lut_mae") < F.col("static_mae"), "lut").otherwise("static")
    return out.withColumn("use", verdict)


def k_folds(df: DataFrame, k: int, obs_id: str = "obs_id", name: str = "name") -> DataFrame:
    """117: fold = place among the name's observations, modulo k.

    Places come from a range shuffle by id and per-partition offsets, so that a name of many rows is not sorted in one task.
    """
    return df.join(place_in_group(df, [name], obs_id).select(obs_id, (F.col("place") % k).cast("int").alias("fold")), obs_id)


def place_in_group(df: DataFrame, group: list[str], order: str, parts: int = 64) -> DataFrame:
    """(group, order, place from 0) without one task per group: ranks within ranges of ``order`` plus the ranges' offsets."""
    edges = df.select(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    at = F.lit(0) if not edges else F.size(F.filter(F.array(*(F.lit(e) for e in sorted(set(edges)))), lambda e: e < F.col(order)))
    rows = df.select(*group, order).withColumn("_part", at)
    sizes = rows.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(order)) - 1)
    return ranked.join(offsets, [*group, "_part"]).select(*group, order, (F.col("_r") + F.col("_before")).cast("long").alias("place"))


def config_folds(df: DataFrame, params, k: int, obs_id: str = "obs_id", name: str = "name") -> DataFrame:
    """118: fold by configuration in order of first occurrence; by place where a fold would be empty."""
    keys = [name, *params]
    first = df.groupBy(*keys).agg(F.min(obs_id).alias("_first"))
    number = first.withColumn("_c", F.dense_rank().over(Window.partitionBy(name).orderBy("_first")) - 1)
    number = written(number.withColumn("_all", F.max("_c").over(Window.partitionBy(name)) + 1))
    cond = [F.col(f"d.{c}").eqNullSafe(F.col(f"f.{c}")) for c in keys]
    byconf = df.alias("d").join(broadcast_if_small(number).alias("f"), cond).select("d.*", "_c", "_all")
    fold = F.col("_c") % k
    # Places are worked out for names of few configurations alone.
    few = F.col("_all") < k
    if not number.where(few).isEmpty():
        plain = place_in_group(byconf.where(few), [name], obs_id).select(obs_id, "place")
        byconf = byconf.join(plain, obs_id, "left")
        fold = F.when(few, F.col("place") % k).otherwise(fold)
    return byconf.withColumn("fold", fold.cast("int")).select(*df.columns, "fold")


def monte_carlo(df: DataFrame, count: int, obs_id: str = "obs_id", name: str = "name", seed: int = 0) -> DataFrame:
    """119: for each repetition two thirds of a name's observations train, in order of a seeded hash; places come from ranges of hashes."""
    reps = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("rep"))
    order = F.struct(F.xxhash64(F.lit(seed), "rep", obs_id).alias("h"), F.col(obs_id).alias("id"))
    rows = reps.select("rep", name, obs_id, order.alias("_o"), F.shiftright(F.xxhash64(F.lit(seed), "rep", obs_id), 58).alias("_p"))
    sizes = rows.groupBy("rep", name, "_p").agg(F.count("*").alias("_s"))
    whole = Window.partitionBy("rep", name)
    upto = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("rep", name, "_p", F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_before"), F.sum("_s").over(whole).alias("_n"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("rep", name, "_p").orderBy("_o"))).join(sizes, ["rep", name, "_p"])
    return reps.join(ranked.select("rep", obs_id, (F.col("_r") + F.col("_before") <= F.floor(F.col("_n") * 2 / 3)).alias("train")), ["rep", obs_id])


def _complements(k: int) -> dict[str, Column]:
    """For each fold the rows of all others, as weights of value counts."""
    return {f"f{i}": F.col("fold") != i for i in range(k)}


def _by_fold(found: DataFrame, keys, k: int, out: str) -> DataFrame:
    """keys, fold and the first percentile of that fold's complement, where it has rows."""
    each = F.array(*(F.struct(F.lit(i).alias("fold"), F.col(f"q_f{i}")[0].alias(out)) for i in range(k)))
    return found.select(*keys, F.explode(each).alias("_e")).select(*keys, "_e.fold", f"_e.{out}").where(F.col(out).isNotNull())


def cross_validate_static(long_folds: DataFrame, k: int, keys=("name", "attr")) -> DataFrame:
    """117: pooled predictions of a static model, metrics once.

    A fold's training rows are all less its own: values are counted once, with a column for each fold's complement, and all
    medians come from one pass over these counts. No row is copied.
    """
    weights = _complements(k)
    found = stats.count_percentiles(stats.value_counts(long_folds, list(keys), weights=weights), keys, [0.5], list(weights))
    model = _by_fold(found, keys, k, "predicted")
    return metrics(long_folds.join(broadcast_if_small(written(model)), [*keys, "fold"]), list(keys))


def cross_validate_lut(long_folds: DataFrame, params, k: int, keys=("name", "attr")) -> DataFrame:
    """118 with a lookup table that falls back to the static value; configurations and whole keys share one count of values."""
    keys, params, weights = list(keys), list(params), _complements(k)
    # Values are counted once, by fold; folds' complements, models and errors all come from these counts.
    rows = stats.value_counts(long_folds, [*keys, *params, "fold"])
    each = [F.sum(F.when(c, F.col("_c")).otherwise(0)).alias(w) for w, c in weights.items()]
    counts = written(rows.groupBy(*keys, *params, "_v").agg(*each))
    whole = counts.groupBy(*keys, "_v").agg(*(F.sum(w).alias(w) for w in weights))
    static = _by_fold(stats.count_percentiles(whole, keys, [0.5], list(weights)), keys, k, "static")
    lut = _by_fold(stats.count_percentiles(counts, [*keys, *params], [0.5], list(weights)), [*keys, *params], k, "lut")
    return metrics(lut_lookup(rows.withColumnRenamed("_v", "value"), written(lut), params, written(static), (*keys, "fold")), keys, weight="_c")


#: The prime that hashes of repetitions are taken by: (a x + b) modulo it.
PRIME = 2**31 - 1


def split_hashes(count: int, seed: int = 0) -> list[tuple[int, int]]:
    """119: a and b of each repetition, from one linear congruence."""
    out, x = [], seed
    for _ in range(2 * count):
        x = (x * 48271 + 11) % PRIME
        out.append(1 + x % (PRIME - 1))
    return list(zip(out[::2], out[1::2], strict=True))


def _members(ids, hashes) -> np.ndarray:
    """Which rows train in which repetitions: two thirds of the hashes. The prime is 2^31 - 1, so a remainder is the sum of two parts of the bits."""
    a, b = (np.array(x, np.uint64) for x in zip(*hashes, strict=True))
    prime, by = np.uint64(PRIME), np.uint64(31)
    ids = np.asarray(ids).astype(np.uint64) % prime
    out = np.empty((len(ids), len(a)), bool)
    for i in range(0, len(ids), 512):
        h = ids[i : i + 512, None] * a + b
        for _ in range(2):
            h = (h & prime) + (h >> by)
        h -= prime * (h >= prime)
        out[i : i + 512] = np.uint64(3) * h < np.uint64(2 * PRIME)
    return out


def monte_carlo_static(long: DataFrame, count: int = 200, keys=("name", "attr"), obs_id: str = "obs_id", seed: int = 0, parts: int | None = None, chunk: int = 200_000) -> DataFrame:
    """119: ``count`` random splits, two thirds training by a hash of the id: keys, rep, n (tested), mae, rmsd and smape of static medians.

    Rows are never copied: a task works out the repetitions of its rows as a matrix of bits. Values are dealt into ``parts``
    ranges a key (of about 100,000 rows, if not given), a range's upper edge apart from what is below it; sums of bits by
    range, one array a task, tell in which range a repetition's median lies. An edge is a value by itself; other ranges that
    hold a median are looked at again, each by itself. The last pass is over ``chunk`` rows of a key at a time, with the
    medians beside them and not in each row. Ids are not negative.
    """
    keys, hashes = list(keys), split_hashes(count, seed)
    rows = written(long.select(*keys, F.col(obs_id).cast("long").alias("_id"), F.col("value").cast("double").alias("_v")).where("_v is not null and _id is not null"))
    parts = parts or min(10_000, max(256, rows.count() // 100_000))
    cuts = rows.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.percentile_approx("_v", [i / parts for i in range(1, parts)], 10_000))).alias("_e"), F.ceil(F.count("*") / chunk).alias("_k"))
    # Edges lie in runs of about the root of their number: the last ones of runs tell the run, so that few are looked at for a row.
    run = max(2, math.isqrt(parts))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("_e") - 1) / run).cast("int")), lambda i: F.slice("_e", i * run + 1, run))
    cuts = written(cuts.withColumn("_r", runs).select(*keys, "_k", "_r", F.transform("_r", lambda r: F.element_at(r, -1)).alias("_l")))
    at = rows.join(broadcast_if_small(cuts, 10_000), keys).withColumn("_g", F.size(F.filter("_l", lambda e: e < F.col("_v"))))
    at = at.withColumn("_h", F.get("_r", F.col("_g"))).withColumn("_j", F.when(F.col("_h").isNull(), 0).otherwise(F.size(F.filter("_h", lambda e: e < F.col("_v")))))
    edge = F.coalesce(F.get("_h", F.col("_j")) == F.col("_v"), F.lit(False)).cast("int")
    placed = written(at.select(*keys, "_id", "_v", (2 * (F.col("_g") * run + F.col("_j")) + edge).alias("_p"), F.pmod(F.xxhash64("_id"), F.col("_k")).cast("int").alias("_c")))
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def sums(batches):
        held, head = {}, None
        for pdf in batches:
            if not len(pdf):
                continue
            head = pdf.head(0)
            groups = pdf.groupby([*keys, "_p"], dropna=False, sort=False)
            number = groups.ngroup().to_numpy()
            order = np.argsort(number, kind="stable")
            starts = np.flatnonzero(np.diff(number[order], prepend=-1))
            total = np.add.reduceat(_members(pdf["_id"].to_numpy()[order], hashes), starts, axis=0, dtype=np.int64)
            for k, c in zip(pdf[[*keys, "_p"]].iloc[order[starts]].itertuples(index=False, name=None), total, strict=True):
                if k in held:
                    held[k] += c
                else:
                    held[k] = c
            if len(held) > 20_000:
                yield type(pdf)([(*k, c.tolist()) for k, c in held.items()], columns=[*keys, "_p", "c"])
                held = {}
        if held:
            yield type(head)([(*k, c.tolist()) for k, c in held.items()], columns=[*keys, "_p", "c"])

    part = placed.select(*keys, "_id", "_p").mapInPandas(sums, f"{named}, _p int, c array<bigint>").select(*keys, "_p", F.posexplode("c").alias("rep", "c"))
    part = part.groupBy(*keys, "rep", "_p").agg(F.sum("c").alias("c"))
    by = Window.partitionBy(*keys, "rep")
    part = part.withColumns({"to": F.sum("c").over(by.orderBy("_p")), "n": F.sum("c").over(by)})
    middle = F.array(F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2))
    wanted = part.withColumn("place", F.explode(middle)).where((F.col("to") - F.col("c") <= F.col("place")) & (F.col("place") < F.col("to")))
    asked = written(wanted.select(*keys, "_p", F.col("rep").cast("int").alias("rep"), (F.col("place") - F.col("to") + F.col("c")).cast("long").alias("at")))

    def find(pdf, wants):
        if not len(pdf) or not len(wants):
            return type(pdf)({**{k: pdf[k].head(0) for k in keys}, "rep": [], "v": []})
        pdf = pdf.sort_values("_v")
        v, out = pdf["_v"].to_numpy(), []
        for r, places in wants.groupby("rep")["at"]:
            upto = np.cumsum(_members(pdf["_id"], [hashes[r]])[:, 0])
            out += [(*pdf[keys].iloc[0], r, float(v[int(np.searchsorted(upto, p + 1))])) for p in places]
        return type(pdf)(out, columns=[*keys, "rep", "v"])

    by_part = [*keys, "_p"]
    inner = asked.where("_p % 2 = 0")
    open_rows = placed.where("_p % 2 = 0").join(inner.select(*by_part).distinct(), by_part, "left_semi").select(*by_part, "_id", "_v")
    held = open_rows.groupBy(*by_part).cogroup(inner.groupBy(*by_part)).applyInPandas(find, f"{named}, rep int, v double")
    edges = placed.where("_p % 2 = 1").groupBy(*by_part).agg(F.min("_v").alias("v"))
    held = held.unionByName(asked.join(edges, by_part).select(*keys, "rep", "v"))
    medians = held.groupBy(*keys, "rep").agg(F.avg("v").alias("m")).groupBy(*keys).agg(F.collect_list("rep").alias("_reps"), F.collect_list("m").alias("_m"))
    beside = medians.join(cuts.select(*keys, "_k"), keys).select(*keys, F.explode(F.sequence(F.lit(0), F.col("_k").cast("int") - 1)).alias("_c"), "_reps", "_m")

    def errors(pdf, known):
        if not len(pdf) or not len(known):
            return type(pdf)({**{k: pdf[k].head(0) for k in keys}, **{c: [] for c in ("rep", "n", "a", "q", "s")}})
        m = np.full(count, np.nan)
        m[np.asarray(known["_reps"].iloc[0], int)] = known["_m"].iloc[0]
        values, test, total = pdf["_v"].to_numpy(), ~_members(pdf["_id"], hashes) & ~np.isnan(m), np.zeros((4, count))
        m = np.nan_to_num(m)
        for i in range(0, len(values), 512):
            v, t = values[i : i + 512, None], test[i : i + 512]
            e = np.abs(v - m) * t
            size = (np.abs(v) + np.abs(m)) / 2
            total += [t.sum(0), e.sum(0), (e * e).sum(0), (e / np.where(size > 0, size, 1.0)).sum(0)]
        return type(pdf)({**{k: [pdf[k].iloc[0]] * count for k in keys}, "rep": range(count), "n": total[0].astype(np.int64), "a": total[1], "q": total[2], "s": total[3]})

    by_chunk = [*keys, "_c"]
    scored = placed.select(*by_chunk, "_id", "_v").groupBy(*by_chunk).cogroup(beside.groupBy(*by_chunk)).applyInPandas(errors, f"{named}, rep int, n bigint, a double, q double, s double")
    total = scored.groupBy(*keys, "rep").agg(*(F.sum(c).alias(c) for c in "naqs")).where("n > 0")
    return total.select(*keys, "rep", "n", (F.col("a") / F.col("n")).alias("mae"), F.sqrt(F.col("q") / F.col("n")).alias("rmsd"), (F.col("s") / F.col("n") * 100).alias("smape"))


def transition_energy(df: DataFrame, keys=("name",)) -> DataFrame:
    """114: predicted power times duration against measured energy."""
    return metrics(df.withColumn("predicted", F.col("power") * F.col("duration")), list(keys), truth="energy")


def state_mix_error(errors: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """115: sqrt of the sum of (mae * share) squared; equal shares by default."""
    if shares is None:
        n = errors.agg(F.count("*").alias("n"))
        weighted = errors.join(F.broadcast(n)).withColumn("share", 1 / F.col("n"))
    else:
        weighted = errors.join(shares, "name")
    return weighted.agg(F.sqrt(F.sum((F.col("mae") * F.col("share")) ** 2)).alias("error"), F.sum("share").alias("shares"))


def trace_totals(trace: DataFrame, keys=("trace_id",)) -> DataFrame:
    """116: energy, duration and state energy of every trace, measured and predicted."""
    state = F.col("isa") == "state"
    energy = lambda p: F.when(state, F.col(p) * F.col("duration"))
    return trace.groupBy(*keys).agg(
        F.sum(F.coalesce(energy("power"), F.col("energy"))).alias("energy"), F.sum(F.coalesce(energy("predicted_power"), F.col("predicted_energy"))).alias("predicted"),
        F.sum("duration").alias("duration"), F.sum(energy("power")).alias("state_energy"), F.sum(energy("predicted_power")).alias("predicted_state_energy"),
    )


def best_of(a: DataFrame, b: DataFrame, keys, names=("absolute", "relative")) -> DataFrame:
    """121: for each key the variant of lower mae."""
    j = a.select(*keys, F.col("mae").alias("_a")).join(b.select(*keys, F.col("mae").alias("_b")), list(keys))
    return j.select(*keys, F.least("_a", "_b").alias("mae"), F.when(F.col("_b") < F.col("_a"), names[1]).otherwise(names[0]).alias("better"))


def outlier_comparison(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """122: static models trained with and without outliers, each assessed on both."""
    out = None
    for trained, train in (("raw", raw), ("clean", clean)):
        for tested, test in (("raw", raw), ("clean", clean)):
            part = metrics(predict_static(test, train), ["name", "attr"], wanted=("mae", "rmsd")).select("name", "attr", F.lit(trained).alias("trained"), F.lit(tested).alias("tested"), "mae", "rmsd")
            out = part if out is None else out.unionByName(part)
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 400):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + t * d or tiny), 1 + t / c or tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * out / a


def t_test(df: DataFrame, group: str, value: str, level: float = 0.05) -> DataFrame:
    """123: pooled two-sample t of the two values of ``group``: one row with t, degrees of freedom, p and verdict."""
    rows = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).orderBy(group).limit(2).collect()
    (n, m, v), (k, l, w) = [(r["n"], r["m"], r["v"]) for r in rows]
    free = n + k - 2
    t = (m - l) / math.sqrt(((n - 1) * v + (k - 1) * w) / free * (1 / n + 1 / k))
    p = incomplete_beta(free / 2, 0.5, free / (free + t * t))
    return df.sparkSession.createDataFrame([(t, free, p, p < level)], "t double, free long, p double, differs boolean")


def ks_distance(df: DataFrame, group: Column, value: str) -> DataFrame:
    """124: largest distance of the empirical distributions of two samples (group true and false), and both sizes.

    Counts by value first; running sums by range of values and offsets of ranges, not one sort in one task.
    """
    counts = df.groupBy(F.col(value).alias("v")).agg(F.count_if(group).alias("a"), F.count_if(~group).alias("b"))
    edges = df.select(F.percentile_approx(value, [i / 64 for i in range(1, 64)], 10_000)).first()[0] or []
    part = F.size(F.filter(F.array(*(F.lit(float(e)) for e in sorted(set(edges)))), lambda e: e < F.col("v"))) if edges else F.lit(0)
    counts = counts.withColumn("_p", part)
    parts = counts.groupBy("_p").agg(F.sum("a").alias("pa"), F.sum("b").alias("pb"))
    upto = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    parts = parts.select("_p", *(F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"before_{c}") for c in ("pa", "pb")), *(F.sum(c).over(every).alias(f"all_{c}") for c in ("pa", "pb")))
    within = Window.partitionBy("_p").orderBy("v")
    run = counts.join(parts, "_p").select(((F.sum("a").over(within) + F.col("before_pa")) / F.col("all_pa") - (F.sum("b").over(within) + F.col("before_pb")) / F.col("all_pb")).alias("gap"), "all_pa", "all_pb")
    return run.agg(F.max(F.abs("gap")).alias("distance"), F.max("all_pa").alias("n_a"), F.max("all_pb").alias("n_b"))


def ks_p_value(distance: float, n: int, m: int) -> float:
    """124: the asymptotic p of a distance."""
    x = distance * math.sqrt(n * m / (n + m))
    return float(min(1.0, max(0.0, 2 * np.sum([(-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, 101)]))))


def overhead_summary(long: DataFrame, files: str = "file") -> DataFrame:
    """125: static durations of each file's set-up and read-out."""
    return stats.static_model(long.where("attr = 'duration'"), (files, "name"))
