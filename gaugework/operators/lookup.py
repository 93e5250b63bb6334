"""Joins and lookups (inventory 44-54)."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.operators.lineage import broadcast_if_small


def null_safe(left: DataFrame, right: DataFrame, keys) -> Column:
    return reduce(and_, [left[k].eqNullSafe(right[k]) for k in keys])


def lut_lookup(rows: DataFrame, lut: DataFrame, keys, fallback: DataFrame | None = None, on=("name", "attr")) -> DataFrame:
    """44: ``rows`` with ``predicted``: the table's value, or the static one if a fallback is given.

    Unset parameters match unset ones. Without a fallback a missing configuration stays null;
    ``missing_configs`` lists those. Small tables are broadcast; they are counted for it, so settled ones should be given.
    """
    l, r = rows.alias("l"), broadcast_if_small(lut).alias("r")
    cond = reduce(and_, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*on, *keys)])
    out = l.join(r, cond, "left").select("l.*", F.col("r.lut").alias("predicted"))
    if fallback is None:
        return out
    return out.join(broadcast_if_small(fallback.select(*on, "static")), list(on), "left").withColumn("predicted", F.coalesce("predicted", "static")).drop("static")


def missing_configs(rows: DataFrame, lut: DataFrame, keys) -> DataFrame:
    """44: configurations without an entry; for a strict lookup these are errors."""
    return rows.alias("l").join(lut.alias("r"), reduce(and_, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]), "left_anti").select(*keys).distinct()


def wildcard_lookup(queries: DataFrame, lut: DataFrame, params, on=("name", "attr")) -> DataFrame:
    """45: a null in the query matches anything; mean of the entries that match.

    Queries are split by which parameters they set, so that each part is an equi-join on these.
    """
    marked = queries.withColumn("_set", F.concat_ws(",", *(F.when(F.col(p).isNotNull(), p) for p in params)))
    masks = [r["_set"] for r in marked.select("_set").distinct().collect()]
    out = []
    for mask in masks:
        keys = [*on, *(k for k in mask.split(",") if k)]
        means = lut.groupBy(*keys).agg(F.sum("lut").alias("s"), F.count("lut").alias("n"))
        out.append(marked.where(F.col("_set") == mask).join(means, keys).select(*queries.columns, (F.col("s") / F.col("n")).alias("predicted")))
    return reduce(DataFrame.unionByName, out) if out else queries.withColumn("predicted", F.lit(None).cast("double")).limit(0)


def partial_match(df: DataFrame, wanted: dict) -> DataFrame:
    """46: rows equal in every listed key; keys that are no column are ignored."""
    known = {k: v for k, v in wanted.items() if k in df.columns}
    return df.where(reduce(and_, [F.col(k).eqNullSafe(F.lit(v)) for k, v in known.items()], F.lit(True)))


def slices(df: DataFrame, params, param: str, keys=("name",)) -> DataFrame:
    """47: groups equal in all parameters but one, with the values that one takes."""
    rest = [*keys, *(p for p in params if p != param)]
    return df.groupBy(*rest).agg(F.sort_array(F.collect_set(param)).alias("values"), F.count("*").alias("n"))


def speed_up(df: DataFrame, numerator: Column, denominator: Column, keys, value: str, order) -> tuple[DataFrame, DataFrame]:
    """48: ratios of the i-th repetitions of equal configurations, and numerator configurations without partner."""
    place = Window.partitionBy(*keys).orderBy(*order)
    side = lambda cond, name: df.where(cond).select(*keys, F.row_number().over(place).alias("rep"), F.col(value).alias(name))
    top, low = side(numerator, "num"), side(denominator, "den")
    cond = reduce(and_, [F.col(f"t.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys])
    pairs = top.alias("t").join(low.alias("d"), cond & (F.col("t.rep") == F.col("d.rep"))).select(*(F.col(f"t.{k}") for k in keys), "t.rep", (F.col("num") / F.col("den")).alias("speed_up"))
    return pairs, top.alias("t").join(low.alias("d"), cond, "left_anti").select(*keys).distinct()


def positional_join(plan: DataFrame, measured: DataFrame, keys, plan_order, measured_order) -> DataFrame:
    """49: i-th planned element with i-th measured one."""
    number = lambda df, order: df.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return number(plan, plan_order).join(number(measured, measured_order), [*keys, "position"])


def as_of_next(events: DataFrame, samples: DataFrame, keys, ts: str = "ts", value: str = "value") -> DataFrame:
    """50: each event with the first sample strictly later, by one sort of both."""
    e = events.select(*events.columns, F.lit(1).alias("_kind"), F.lit(None).cast("struct<t:double,v:double>").alias("_s"))
    s = samples.select(*(F.col(c) if c in (*keys, ts) else F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns), F.lit(0).alias("_kind"), F.struct(F.col(ts).cast("double").alias("t"), F.col(value).cast("double").alias("v")).alias("_s"))
    # Descending in time: samples of a later time come first; at one time events do, as an equal sample is not later.
    ahead = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col("_kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = e.unionByName(s).withColumn("_next", F.last("_s", ignorenulls=True).over(ahead))
    return both.where("_kind = 1").select(*events.columns, F.col("_next.t").alias("sample_ts"), F.col("_next.v").alias("sample_value"))


def interval_join(points: DataFrame, spans: DataFrame, keys, ts: str, lo: str, hi: str, width: float) -> DataFrame:
    """51, 52: points within spans, as an equi-join on buckets of ``width`` that a span is listed under."""
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    listed = spans.withColumn("_b", F.explode(F.sequence(bucket(lo), bucket(hi))))
    return points.withColumn("_b", bucket(ts)).join(listed, [*keys, "_b"]).where((F.col(ts) >= F.col(lo)) & (F.col(ts) <= F.col(hi))).drop("_b")


def neighbours(trace: DataFrame, trace_id: str = "trace_id", seq: str = "seq") -> DataFrame:
    """53: distinct (state before, state after) of each transition."""
    w = Window.partitionBy(trace_id).orderBy(seq)
    around = trace.withColumns({"before": F.lag("name").over(w), "after": F.lead("name").over(w)})
    return around.where("isa = 'transition'").select("name", "before", "after").distinct()


def compatibility(a: DataFrame, b: DataFrame, key: str = "name") -> DataFrame:
    """54: names that only one of two inputs has."""
    left, right = a.select(key).distinct().withColumn("in_a", F.lit(True)), b.select(key).distinct().withColumn("in_b", F.lit(True))
    both = left.join(right, key, "full_outer").select(key, F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))
    return both.where("in_a <> in_b")
