"""Aggregates and parameter statistics (inventory 55-80).

Rows are reduced once to configuration moments (n, mean, M2); all standard deviations come from
merging these. Medians need the rows.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.observations import Observations, numeric
from gaugework.operators.lineage import broadcast_if_small, cut, written

#: A parameter matters if the deviation within configurations is below this share of that without it.
RELEVANT = 0.5
#: Bins of values by unit of their logarithm.
BINS = 128
#: Bins that are listed in a plan at most.
HELD = 1000


def _same(keys, a: str, b: str):
    return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]


def value_counts(df: DataFrame, keys, value: str = "value", weights: dict[str, Column] | None = None) -> DataFrame:
    """keys, _v and, for each of ``weights``, how many rows of that value it holds for (``_c``: all). Nulls do not count. Settled, as it is read several times."""
    named = {"_c": F.count("*")} if weights is None else {w: F.count_if(c) for w, c in weights.items()}
    return written(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(*(c.alias(w) for w, c in named.items())))


def count_percentiles(counts: DataFrame, keys, shares, weights=("_c",), parts: int = 64) -> DataFrame:
    """keys and, for each of ``weights``, n_<weight> and q_<weight>: exact percentiles (on the line between the neighbouring
    values) of ``value_counts``. All weights share one pass.

    Values are cut into ``parts`` ranges a group by a sketch, and places follow from sums within ranges and the ranges'
    offsets, so that no group is sorted or held in one task. A weight without rows has null percentiles.
    """
    keys, weights = list(keys), list(weights)
    cuts = counts.groupBy(*keys).agg(F.percentile_approx("_v", [i / parts for i in range(1, parts)], 1000).alias("_e"))
    part = F.size(F.filter("_e", lambda e: e < F.col("_v")))
    placed = counts.alias("c").join(broadcast_if_small(written(cuts), 10_000).alias("e"), _same(keys, "c", "e") or F.lit(True)).select(*(f"c.{k}" for k in keys), "_v", *weights, part.alias("_p"))
    sums = placed.groupBy(*keys, "_p").agg(*(F.sum(w).alias(w) for w in weights))
    whole, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_p", *(F.coalesce(F.sum(w).over(upto), F.lit(0)).alias(f"_before_{w}") for w in weights), *(F.sum(w).over(whole).alias(f"n_{w}") for w in weights))
    within = Window.partitionBy(*keys, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    run = placed.withColumns({f"_to_{w}": F.sum(w).over(within) for w in weights}).alias("c").join(sums.alias("e"), [*_same(keys, "c", "e"), F.col("c._p") == F.col("e._p")])
    place = lambda w, share: F.lit(float(share)) * (F.col(f"n_{w}") - 1)

    def at(w, where):
        to = F.col(f"_before_{w}") + F.col(f"_to_{w}")
        return F.max(F.when((to - F.col(w) <= where) & (where < to), F.col("_v")))

    got = run.groupBy(*(F.col(f"c.{k}").alias(k) for k in keys)).agg(
        *(F.max(f"n_{w}").alias(f"n_{w}") for w in weights), *(at(w, f(place(w, x))).alias(f"_{w}_{i}_{j}") for w in weights for i, x in enumerate(shares) for j, f in enumerate((F.floor, F.ceil)))
    )

    def line(w, i, x):
        p = place(w, x)
        # Equal neighbours are their own line: its sum would differ from them by rounding.
        return F.when((F.ceil(p) == F.floor(p)) | (F.col(f"_{w}_{i}_0") == F.col(f"_{w}_{i}_1")), F.col(f"_{w}_{i}_0")).otherwise((F.ceil(p) - p) * F.col(f"_{w}_{i}_0") + (p - F.floor(p)) * F.col(f"_{w}_{i}_1"))

    return got.select(*keys, *(f"n_{w}" for w in weights), *(F.array(*(line(w, i, x) for i, x in enumerate(shares))).alias(f"q_{w}") for w in weights))


def percentiles(df: DataFrame, keys, value: str, shares, parts: int = 64) -> DataFrame:
    """keys, n and q: exact percentiles of each group, however few the groups. Nulls do not count."""
    found = count_percentiles(value_counts(df, list(keys), value), keys, shares, parts=parts)
    return found.select(*keys, F.col("n__c").alias("n"), F.col("q__c").alias("q"))


def middles(long: DataFrame, keys, params) -> tuple[DataFrame, DataFrame]:
    """55, 56 together: exact medians of each key (``static``) and of each configuration (``lut``), with n (all rows) and dev
    (the sum of absolute deviations from the median), both settled.

    Two passes over the rows. The first counts and sums them by bins of the logarithm, which tell the bins that hold a middle;
    the second counts the values of these bins alone. All other rows are as many values below or above, so that few rows are
    shuffled even if all values differ.
    """
    keys, by = list(keys), [*keys, *params]
    v, least, most = F.col("_v"), F.lit(float("-inf")), F.lit(float("inf"))
    # Bins keep the order of values; infinite ones and NaN share the outermost.
    place = F.rint(F.log(F.abs(v)) * BINS) + 1000 * BINS
    rows = long.select(*by, F.col("value").cast("double").alias("_v")).withColumn("_x", F.when(F.isnan(v), most).when(v > 0, place).when(v < 0, -place).when(v == 0, 0.0))
    bins = written(rows.groupBy(*by, "_x").agg(F.count("*").alias("_c"), F.sum("_v").alias("_s")))

    def middle(of):
        whole = Window.partitionBy(*of)
        upto = whole.orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
        run = bins.where("_x is not null").groupBy(*of, "_x").agg(F.sum("_c").alias("_c")).select(*of, "_x", F.sum("_c").over(upto).alias("_to"), F.sum("_c").over(whole).alias("_n"))
        return run.groupBy(*of).agg(F.min(F.when(F.col("_to") * 2 >= F.col("_n"), F.col("_x"))).alias("_lo"), F.min(F.when(F.col("_to") * 2 > F.col("_n"), F.col("_x"))).alias("_hi"))

    one, all_ = middle(by), middle(keys)
    cond = _same(keys, "l", "s") or F.lit(True)
    marks = written(one.alias("l").join(all_.alias("s"), cond).select(*(f"l.{k}" for k in by), F.struct("l._lo", "l._hi").alias("_lut"), F.struct("s._lo", "s._hi").alias("_static")))
    # Rows of bins that hold no middle at all go first: a list of numbers tells them for less than the join with their configuration does.
    held = [r[0] for r in marks.select(F.explode(F.array("_lut._lo", "_lut._hi", "_static._lo", "_static._hi")).alias("_x")).distinct().limit(HELD + 1).collect()]
    marks = broadcast_if_small(marks)
    inside = lambda m: F.col("_x").between(F.col(f"{m}._lo"), F.col(f"{m}._hi"))
    marked = lambda df: df.where("_x is not null").alias("r").join(marks.alias("m"), _same(by, "r", "m") or F.lit(True)).select("r.*", "_lut", "_static")
    few = rows.where(F.col("_x").isin(held)) if len(held) <= HELD else rows
    near = written(marked(few).where(inside("_lut") | inside("_static")).groupBy(*by, "_x", "_v", "_lut", "_static").agg(F.count("*").alias("_c")))

    def solved(of, m, name):
        side = F.when(F.col("_x") < F.col(f"{m}._lo"), least).otherwise(most)
        far = marked(bins).where(~inside(m)).withColumn("_v", side).groupBy(*of, "_v").agg(F.sum("_c").alias("_c"), F.sum("_s").alias("_s"))
        kept = near.where(inside(m)).groupBy(*of, "_v").agg(F.sum("_c").alias("_c"), F.lit(None).cast("double").alias("_s"))
        counts = written(kept.unionByName(far))
        found = written(count_percentiles(counts.groupBy(*of, "_v").agg(F.sum("_c").alias("_c")), of, [0.5]).select(*of, F.col("q__c")[0].alias(name)))
        off = F.when(F.col("_s").isNull(), F.abs(v - F.col(name)) * F.col("_c")).when(v < F.col(name), F.col(name) * F.col("_c") - F.col("_s")).otherwise(F.col("_s") - F.col(name) * F.col("_c"))
        dev = counts.alias("c").join(broadcast_if_small(found).alias("m"), _same(of, "c", "m") or F.lit(True)).groupBy(*(F.col(f"c.{k}").alias(k) for k in of)).agg(F.first(name).alias(name), F.sum(off).alias("dev"))
        n = bins.groupBy(*of).agg(F.sum("_c").alias("n"))
        return written(n.alias("c").join(dev.alias("m"), _same(of, "c", "m") or F.lit(True), "left").select(*(f"c.{k}" for k in of), name, "n", "dev"))

    return solved(keys, "_static", "static"), solved(by, "_lut", "lut")


def static_model(long: DataFrame, keys=("name", "attr"), how: str = "median") -> DataFrame:
    """55: median or mean for each (name, attr)."""
    if how == "median":
        counts = cut(long.groupBy(*keys, F.col("value").cast("double").alias("_v")).agg(F.count("*").alias("_c")))
        middle = count_percentiles(counts.where("_v is not null"), keys, [0.5]).select(*keys, F.col("q__c")[0].alias("static"))
        rows = counts.groupBy(*keys).agg(F.sum("_c").alias("n"))
        return rows.alias("c").join(middle.alias("m"), _same(keys, "c", "m"), "left").select(*(f"c.{k}" for k in keys), "static", "n")
    return long.groupBy(*keys).agg(F.avg("value").alias("static"), F.count("*").alias("n"))


def lut_model(long: DataFrame, params, keys=("name", "attr"), how: str = "median") -> DataFrame:
    """56: median or mean for each configuration."""
    agg = F.median("value") if how == "median" else F.avg("value")
    return long.groupBy(*keys, *params).agg(agg.alias("lut"))


def distinct_values(df: DataFrame, params, obs_id: str = "obs_id", name: str = "name") -> DataFrame:
    """57: values of each parameter in order of first occurrence, null among them."""
    rows = df.select(obs_id, name, *(F.col(p).cast("string").alias(p) for p in params)).unpivot([obs_id, name], list(params), "param", "value")
    first = rows.groupBy(name, "param", "value").agg(F.min(obs_id).alias("first"), F.count("*").alias("n"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(name, "param").orderBy("first", "value")))


def param_types(df: DataFrame, params, name: str = "name") -> DataFrame:
    """58: UNSET, USELESS, BOOLEAN, SCALAR or ENUM by the number of distinct set values."""
    rows = df.select(name, *(F.col(p).cast("string").alias(p) for p in params)).unpivot([name], list(params), "param", "value")
    n = rows.groupBy(name, "param").agg(F.countDistinct("value").alias("distinct"), F.bool_and(F.col("value").isNull() | numeric("value").isNotNull()).alias("is_number"))
    kind = F.when(F.col("distinct") == 0, "UNSET").when(F.col("distinct") == 1, "USELESS").when(F.col("distinct") == 2, "BOOLEAN").when(F.col("is_number"), "SCALAR").otherwise("ENUM")
    return n.withColumn("type", kind)


def type_census(types: DataFrame, name: str = "name") -> DataFrame:
    """59: parameters by type; useful ones are boolean, scalar or enum."""
    kinds = ("UNSET", "USELESS", "BOOLEAN", "SCALAR", "ENUM")
    return types.groupBy(name).agg(
        *(F.count_if(F.col("type") == k).alias(k.lower()) for k in kinds), F.count_if(F.col("type").isin("BOOLEAN", "SCALAR", "ENUM")).alias("useful")
    )


def config_moments(long: DataFrame, params, keys=("name", "attr")) -> DataFrame:
    """_n, _mean and _m2 (sum of squares about the mean) of each configuration."""
    return long.groupBy(*keys, *params).agg(F.count("value").alias("_n"), F.avg("value").alias("_mean"), (F.var_pop("value") * F.count("value")).alias("_m2"))


def merged_std() -> Column:
    """Population deviation of merged groups; ``_d`` is a mean less a fixed origin."""
    n, s = F.sum("_n"), F.sum(F.col("_n") * F.col("_d"))
    return F.sqrt(F.greatest((F.sum("_m2") + F.sum(F.col("_n") * F.col("_d") * F.col("_d")) - s * s / n) / n, F.lit(0.0)))


def deviations(long: DataFrame, params, keys=("name", "attr")) -> DataFrame:
    """60-62: std_static, std_lut and, for each parameter, std_by_p: a row for each (keys, param).

    std_lut and std_by_p are unweighted means over configurations and over groups equal in all
    other parameters. One pass over the rows; the rest is on configurations.
    """
    keys, params = list(keys), list(params)
    config = config_moments(long, params, keys)
    origin = config.groupBy(*keys).agg((F.sum(F.col("_n") * F.col("_mean")) / F.sum("_n")).alias("_origin"))
    config = config.join(origin, keys).withColumn("_d", F.col("_mean") - F.col("_origin"))
    whole = config.groupBy(*keys).agg(F.sum("_n").alias("rows"), F.count("*").alias("configs"), merged_std().alias("std_static"), F.avg(F.sqrt(F.col("_m2") / F.col("_n"))).alias("std_lut"))
    sets = [[*keys, *(q for q in params if q != p)] for p in params]
    grouped = config.groupingSets(sets, *keys, *params).agg(merged_std().alias("std"), *(F.grouping(p).alias(f"_{i}") for i, p in enumerate(params)))
    which = reduce(lambda out, ip: F.when(F.col(f"_{ip[0]}") == 1, ip[1]).otherwise(out), enumerate(params), F.lit(None).cast("string"))
    by = grouped.groupBy(*keys, which.alias("param")).agg(F.avg("std").alias("std_by_param"))
    return whole.join(by, keys)


def relevance(dev: DataFrame) -> DataFrame:
    """63, 64: does an attribute depend on a parameter, and how much."""
    by, lut, static = F.col("std_by_param"), F.col("std_lut"), F.col("std_static")
    return dev.withColumns(
        {
            "depends": (by != 0) & (lut / by < RELEVANT),
            "dependence": F.when(by == 0, 0.0).otherwise(1 - lut / by),
            "dependence_all": F.when(static == 0, 0.0).otherwise(1 - lut / static),
        }
    )


def correlation(df: DataFrame, param: str, attr: str, name: str = "name") -> DataFrame:
    """65: Pearson's correlation, 0 if the parameter is constant or not a number."""
    both = F.corr(numeric(param), F.col(attr))
    good = F.count(numeric(param)) == F.count("*")
    return df.groupBy(name).agg(F.when(good, F.coalesce(F.nanvl(both, F.lit(0.0)), F.lit(0.0))).otherwise(0.0).alias("correlation"))


def correlation_dependence(df: DataFrame, params, attrs, name: str = "name") -> DataFrame:
    """64: the size of the correlation of each parameter with each attribute, as a dependence ratio."""
    out = None
    for p in params:
        for a in attrs:
            part = correlation(df, p, a, name).select(name, F.lit(a).alias("attr"), F.lit(p).alias("param"), F.abs("correlation").alias("dependence"))
            out = part if out is None else out.unionByName(part)
    return out


def codependent_pairs(df: DataFrame, params, name: str = "name") -> DataFrame:
    """66, 67: pairs (p, q), p before q, in which p fixes q and neither is constant; and which of them goes.

    The less numeric one of a pair goes, if both are unset in the same rows.
    """
    params = sorted(params)
    configs = df.groupBy(name, *params).agg(F.count("*").alias("rows"))
    pairs = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), F.col(p).cast("string").alias("pv"), F.col(q).cast("string").alias("qv")) for p, q in itertools.combinations(params, 2)))
    each = configs.select(name, "rows", F.explode(pairs).alias("x")).select(name, "rows", "x.*")
    show = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    values = each.groupBy(name, "p", "q", "pv").agg(
        F.count_distinct(show(F.col("qv"))).alias("qs"), F.collect_set(show(F.col("qv"))).alias("qset"), F.bool_and(F.col("pv").isNull() == F.col("qv").isNull()).alias("same"),
        F.sum(F.when(numeric("pv").isNotNull(), F.col("rows")).otherwise(0)).alias("pn"), F.sum(F.when(numeric("qv").isNotNull(), F.col("rows")).otherwise(0)).alias("qn"),
    )
    out = values.groupBy(name, "p", "q").agg(F.max("qs").alias("qs"), F.count("*").alias("ps"), F.size(F.array_distinct(F.flatten(F.collect_list("qset")))).alias("all_q"), F.bool_and("same").alias("same"), F.sum("pn").alias("pn"), F.sum("qn").alias("qn"))
    found = out.where("qs = 1 and ps > 1 and all_q > 1")
    return found.select(name, "p", "q", F.when(F.col("same"), F.when(F.col("pn") >= F.col("qn"), F.col("q")).otherwise(F.col("p"))).alias("drop"))


def _information(df: DataFrame, keys, of: str, bin_: str) -> DataFrame:
    """Mutual information (nats) of two columns within each group, from their joint counts."""
    joint = df.groupBy(*keys, F.col(of).alias("v"), F.col(bin_).alias("bin")).agg(F.count("*").alias("n"))
    p = joint.withColumns({"total": F.sum("n").over(Window.partitionBy(*keys)), "nv": F.sum("n").over(Window.partitionBy(*keys, "v")), "nb": F.sum("n").over(Window.partitionBy(*keys, "bin"))})
    return p.groupBy(*keys).agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("nv") * F.col("nb")))).alias("information"))


def with_bins(df: DataFrame, attr: str, bins: int = 16, name: str = "name") -> DataFrame:
    """``df`` with ``_bin``: the number of the attribute's inner quantiles, of its name, that are below the value."""
    edges = percentiles(df, [name], attr, [i / bins for i in range(1, bins)]).select(name, F.col("q").alias("_edges"))
    return df.join(broadcast_if_small(written(edges)), name).withColumn("_bin", F.size(F.filter("_edges", lambda e: e < F.col(attr)))).drop("_edges")


def binned_information(df: DataFrame, param: str, attr: str, bins: int = 16, name: str = "name") -> DataFrame:
    """68: mutual information (nats) of a parameter's values and an attribute in equal-count bins.

    Bins replace nearest neighbours, which have no scalable exact counterpart.
    """
    return _information(with_bins(df, attr, bins, name), [name], param, "_bin")


def informative_parameters(df: DataFrame, params, attr: str, least: float = 0.1, bins: int = 16, name: str = "name") -> DataFrame:
    """69: for each name and parameter its information on the attribute, and whether a learner gets it: features under ``least`` are dropped."""
    long = with_bins(df, attr, bins, name).select(name, "_bin", *(F.col(p).cast("string").alias(p) for p in params)).unpivot([name, "_bin"], list(params), "param", "value")
    return _information(long, [name, "param"], "value", "_bin").withColumn("selected", F.col("information") >= least)


def info_report(long: DataFrame) -> DataFrame:
    """70: samples and range of each attribute."""
    return long.groupBy("name", "attr").agg(F.count("*").alias("samples"), F.min("value").alias("least"), F.max("value").alias("most"), F.countDistinct("value").alias("distinct_values"))


def remove_outliers(obs: Observations, limit: float = 10.0) -> Observations:
    """71: drop observations with an attribute over ``limit`` deviations from its name's mean."""
    moments = obs.df.groupBy(obs.name).agg(*(f(a).alias(f"{t}_{a}") for a in obs.attrs for t, f in (("_m", F.avg), ("_s", F.stddev_pop))))
    far = reduce(lambda x, y: x | y, [(F.col(f"_s_{a}") > 0) & (F.abs(F.col(a) - F.col(f"_m_{a}")) > limit * F.col(f"_s_{a}")) for a in obs.attrs])
    return obs.with_df(obs.df.join(broadcast_if_small(written(moments)), obs.name).where(~far).select(obs.df.columns))


def box_statistics(long: DataFrame, keys=("name", "attr")) -> DataFrame:
    """72: quartiles, and whiskers at the outermost values within 1.5 interquartile ranges."""
    counts = value_counts(long, list(keys))
    q = broadcast_if_small(written(count_percentiles(counts, keys, [0.25, 0.5, 0.75]).select(*keys, F.col("n__c").alias("n"), F.col("q__c").alias("q"))))
    lo, hi = F.col("q")[0] - 1.5 * (F.col("q")[2] - F.col("q")[0]), F.col("q")[2] + 1.5 * (F.col("q")[2] - F.col("q")[0])
    # Whiskers come from the same counts, beside the quartiles: few keys are not sent to few tasks.
    inner = counts.join(q, list(keys)).where((F.col("_v") >= lo) & (F.col("_v") <= hi))
    return inner.groupBy(*keys, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")).agg(F.min("_v").alias("low"), F.max("_v").alias("high"))


def influence_series(long: DataFrame, param: str, others, grid: int = 500) -> tuple[DataFrame, DataFrame]:
    """73: points (x, mean y) for each configuration of the others, and an even grid of x for model curves."""
    points = long.groupBy("name", "attr", *others, numeric(param).alias("x")).agg(F.avg("value").alias("y"))
    span = points.groupBy("name", "attr").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    line = span.select("name", "attr", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i"), "a", "b").select("name", "attr", "i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / (grid - 1)).alias("x"))
    return points, line


def histogram(long: DataFrame, bins: int) -> DataFrame:
    """74: counts in even bins of each attribute's range."""
    span = long.groupBy("name", "attr").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    at = F.when(F.col("a") == F.col("b"), 0).otherwise(F.least(F.floor((F.col("value") - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1)))
    return long.join(span, ["name", "attr"]).groupBy("name", "attr", at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def always_failing(df: DataFrame, params, failed: Column) -> DataFrame:
    """75: parameter values with failures and no success."""
    rows = df.select(failed.alias("failed"), *(F.col(p).cast("string").alias(p) for p in params)).unpivot(["failed"], list(params), "param", "value")
    return rows.groupBy("param", "value").agg(F.count_if("failed").alias("failures"), F.count("*").alias("n")).where("failures = n").select("param", "value", "failures")


def constant_options(df: DataFrame, params, on: str = "y", off: str = "n") -> DataFrame:
    """76: boolean options that are never on, or never off."""
    rows = df.select(*(F.col(p).cast("string").alias(p) for p in params)).unpivot([], list(params), "param", "value")
    return rows.groupBy("param").agg(F.count_if(F.col("value") == on).alias("on"), F.count_if(F.col("value") == off).alias("off")).where((F.col("on") == 0) | (F.col("off") == 0))


def aggregate_check(grouped: DataFrame, attrs) -> DataFrame:
    """80: names whose attribute arrays differ in length from ``param``."""
    bad = reduce(lambda x, y: x | y, [F.size(a) != F.size("param") for a in attrs])
    return grouped.where(bad).select("name")
