"""Filters, shifts, normalisation, encodings and regrouping of observations (inventory 27-43)."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.observations import Observations, numeric
from gaugework.operators.lineage import broadcast_if_small

_COMPARE = {"<": operator.lt, "<=": operator.le, "≤": operator.le, "=": operator.eq, ">=": operator.ge, "≥": operator.ge, ">": operator.gt}


def literal(text: str) -> Column:
    """A value of a filter as number if it is one."""
    try:
        return F.lit(float(text))
    except ValueError:
        return F.lit(text)


def _same(p: str, v: str) -> Column:
    try:
        return numeric(p) == float(v)
    except ValueError:
        return F.col(p).cast("string") == v


def parameter_predicate(text: str) -> Column:
    """27: ``p op v`` joined by ``;``. Null fails all comparisons but ``!=``, which it passes."""
    parts = []
    for clause in filter(None, (c.strip() for c in text.split(";"))):
        m = re.fullmatch(r"\s*(\S+?)\s*(<=|>=|!=|≤|≥|≠|∈|<|>|=| in )\s*(.*?)\s*", clause)
        if m is None:
            raise ValueError(f"no parameter filter: {clause}")
        p, op, v = m[1], m[2].strip(), m[3]
        if op in ("∈", "in"):
            parts.append(F.coalesce(functools.reduce(operator.or_, [_same(p, x.strip()) for x in v.split(",")]), F.lit(False)))
        elif op in ("!=", "≠"):
            parts.append(~F.coalesce(_same(p, v), F.lit(False)))
        elif op == "=":
            parts.append(F.coalesce(_same(p, v), F.lit(False)))
        else:
            parts.append(F.coalesce(_COMPARE[op](numeric(p), literal(v)), F.lit(False)))
    return functools.reduce(operator.and_, parts, F.lit(True))


def filter_parameters(obs: Observations, text: str) -> Observations:
    return obs.with_df(obs.df.where(parameter_predicate(text)))


def filter_observations(long: DataFrame, wanted: DataFrame) -> DataFrame:
    """28: the listed (name, attr) pairs of a long table."""
    return long.join(broadcast_if_small(wanted), ["name", "attr"], "left_semi")


def ignore_parameters(obs: Observations, names: list[str]) -> Observations:
    """29."""
    return obs.with_df(obs.df.drop(*names), params=tuple(p for p in obs.params if p not in names))


def shift_parameter(obs: Observations, param: str, op: str, value: float | None = None) -> Observations:
    """30: ``+ - * /`` by a constant, ``categorical`` or ``none-to-0``; ``*`` stands for all parameters."""
    arithmetic = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv}

    def one(p):
        c = F.col(p)
        if op == "none-to-0":
            return F.coalesce(c.cast("string"), F.lit("0"))
        if op == "categorical":
            shown = F.concat(F.lit("="), F.coalesce(c.cast("string"), F.lit("None")))
            return shown if param == "*" else F.when(c.isNotNull(), shown)
        return F.when(numeric(p).isNotNull(), arithmetic[op](numeric(p), F.lit(value)))

    return obs.with_df(obs.df.withColumns({p: one(p) for p in (obs.params if param == "*" else (param,))}))


def normalise_attribute(obs: Observations, old: str, new: str, fun: Callable[[Column], Column]) -> Observations:
    """31: a new attribute in place of an old one."""
    df = obs.df.withColumn(new, fun(F.col(old)))
    return obs.with_df(df if new == old else df.drop(old), attrs=tuple(new if a == old else a for a in obs.attrs))


def normalise_parameter(column: Column, enum: Mapping[str, float] | None = None, formula: Callable[[Column], Column] | None = None) -> Column:
    """32: an enum's number first, then a formula."""
    out = column
    if enum:
        table = F.create_map(*(F.lit(x) for kv in enum.items() for x in (kv[0], float(kv[1]))))
        out = F.coalesce(table[column.cast("string")], column.cast("string").try_cast("double"))
    return formula(out) if formula else out


def soft_casts(text: Column) -> dict[str, Column]:
    """33: text as int, float, the narrower of both, or float with NaN for what is none."""
    whole = F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), text.try_cast("bigint"))
    real = text.try_cast("double")
    return {"as_int": whole, "as_float": real, "is_int": whole.isNotNull(), "or_nan": F.coalesce(real, F.lit(float("nan")))}


def one_hot(df: DataFrame, param: str, values: list[str], yes="1", no="0") -> DataFrame:
    """34: a column for each value of an enum."""
    c = F.col(param).cast("string")
    return df.select(*[x for x in df.columns if x != param], *(F.when(c == v, yes).otherwise(no).alias(f"{param}_{v}") for v in values))


def enum_values(df: DataFrame, param: str) -> list[str]:
    """Values of a parameter with more than two that are not all numbers; otherwise none."""
    rows = df.select(F.col(param).cast("string").alias("v")).where("v is not null").distinct().orderBy("v").collect()
    values = [r["v"] for r in rows]
    if len(values) <= 2 or all(re.fullmatch(r"[+-]?\d+(\.\d*)?", v) for v in values):
        return []
    return values


def category_index(df: DataFrame, column: str) -> DataFrame:
    """35: (value, index) in lexical order."""
    return df.select(F.col(column).alias("value")).where("value is not null").distinct().withColumn("index", (F.row_number().over(Window.orderBy("value")) - 1).cast("double"))


def encode_category(df: DataFrame, column: str, index: DataFrame, to: str) -> DataFrame:
    """35: values by index; an unseen one gets the largest index plus one."""
    top = index.agg((F.max("index") + 1).alias("unseen"))
    return df.join(index.withColumnsRenamed({"value": column, "index": to}), column, "left").join(F.broadcast(top)).withColumn(to, F.coalesce(to, "unseen")).drop("unseen")


def by_config(obs: Observations) -> DataFrame:
    """36: one row for each configuration, with its observations in order."""
    rows = F.sort_array(F.collect_list(F.struct(obs.obs_id, *obs.attrs)))
    return obs.df.groupBy(*obs.config).agg(rows.alias("rows"))


def by_name(grouped: DataFrame, obs: Observations) -> DataFrame:
    """36, back again."""
    return grouped.select(*obs.config, F.explode("rows").alias("r")).select("r.*", *obs.config)


def param_map(params) -> Column:
    """37: set parameters as a map."""
    entries = F.array(*(F.struct(F.lit(p).alias("key"), F.col(p).cast("string").alias("value")) for p in sorted(params)))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def param_string(m: Column, separator: str = " ") -> Column:
    """37: ``k=v`` in order of keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), separator)


def param_from_string(text: Column, separator: str = " ") -> Column:
    """37, back again; an empty value is null."""
    pairs = F.filter(F.split(F.trim(text), re.escape(separator)), lambda x: x != "")
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.nullif(F.regexp_replace(x, "^[^=]*=?", ""), F.lit("")).alias("value"))))


def restrict_features(long_params: DataFrame, features: DataFrame) -> DataFrame:
    """38: rows of the parameters that a feature table names."""
    return long_params.join(broadcast_if_small(features), "param", "left_semi")


def recode_by_dimension(df: DataFrame, dimension: DataFrame, keys: list[str], raw: list[str]) -> DataFrame:
    """39: human-readable columns by a dimension table, instead of the raw ones."""
    return df.join(dimension, keys, "left").drop(*raw)


def total_attribute(obs: Observations) -> Observations:
    """40: TOTAL is the sum of all attributes."""
    total = functools.reduce(operator.add, [F.col(a) for a in obs.attrs])
    return obs.with_df(obs.df.withColumn("TOTAL", total), attrs=(*obs.attrs, "TOTAL"))


def random_subset(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """41: n rows in order of a seeded hash, alike on every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def si_unit(value: Column, unit: str) -> Column:
    """42: a number with an SI prefix from p to G."""
    steps = [(1e9, "G"), (1e6, "M"), (1e3, "k"), (1.0, ""), (1e-3, "m"), (1e-6, "µ"), (1e-9, "n")]
    out = F.format_string("%.2f p" + unit, value * 1e12)
    for size, prefix in reversed(steps):
        out = F.when(F.abs(value) >= size, F.format_string(f"%.2f {prefix}{unit}", value / size)).otherwise(out)
    return out


def json_features(text: Column) -> dict[str, Column]:
    """43: structure of a flat JSON object: lengths of keys and strings, byte classes of integers, counts."""
    entries = F.map_entries(F.from_json(text, "map<string,string>"))
    raw = F.map_entries(F.from_json(text, "map<string,variant>"))
    is_int = lambda v: v.rlike(r"^-?\d+$")
    kind = lambda e: F.schema_of_variant(e["value"])
    width = lambda v: F.when(F.abs(v.try_cast("bigint")) < 256, 1).when(F.abs(v.try_cast("bigint")) < 65536, 2).otherwise(4)
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    return {
        "key_length": total(F.transform(entries, lambda e: F.length(e["key"]))),
        "int_count": F.size(F.filter(raw, lambda e: kind(e) == "BIGINT")),
        "string_count": F.size(F.filter(raw, lambda e: kind(e) == "STRING")),
        "int_bytes": total(F.transform(F.filter(entries, lambda e: is_int(e["value"])), lambda e: width(e["value"]))),
    }
