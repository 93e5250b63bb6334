"""Keyed trees (inventory 91-99, 107, 108, 110, 111): a multiway regression tree for every key, all in one chain of jobs.

A ``Grove`` is two tables, nodes and edges. A node's identifier starts with its tree's, so that one
grouping by (node, parameter, value) serves all nodes of a level in all trees, whatever the number
of keys: the number of jobs grows with the depth of the deepest tree alone, and no node passes
through the driver. Splits are chosen by the least (loss, parameter) of a node. Rows are reduced to
the moments of their configurations first; keys may hold a fold, an attribute or a site.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.observations import numeric
from gaugework.operators import fit as ls
from gaugework.operators import stats
from gaugework.operators.lineage import broadcast_if_small, cut, written
from gaugework.operators.trees import _key, _node_deviation, _node_information, _NULL, NOISE


@dataclass(frozen=True)
class Grove:
    """``nodes``: keys, _node, level, param (null at a leaf), value, n, beta (null but at function leaves).

    ``edges``: _node, level, param, v (a value as text), x (as number), child, n (of the value's rows).
    ``roots``: keys and _node of each tree.
    """

    nodes: DataFrame
    edges: DataFrame
    roots: DataFrame
    keys: tuple[str, ...]
    params: tuple[str, ...]
    depth: int
    terms: tuple = ()


def moments(long: DataFrame, params, keys=("name", "attr"), value: str = "value") -> DataFrame:
    """_n, _mean and _m2 of each configuration of each key."""
    rows = long.select(*keys, *params, F.col(value).cast("double").alias("_v")).where("_v is not null")
    return rows.groupBy(*keys, *params).agg(F.count("*").alias("_n"), F.avg("_v").alias("_mean"), (F.var_pop("_v") * F.count("*")).alias("_m2"))


def complements(config: DataFrame, params, keys=("name", "attr"), fold: str = "fold") -> DataFrame:
    """117: moments of all folds but one, for each configuration and fold, from ``moments`` with the fold among the keys.

    Configurations are merged, not rows copied; a configuration that lies in one fold alone is none for that fold's model.
    """
    folds = config.select(*keys, F.col(fold).alias("_test")).distinct()
    pairs = config.join(folds, list(keys)).where(F.col("_test") != F.col(fold))
    origin = pairs.groupBy(*keys, "_test", *params).agg(F.min(F.struct(fold, "_mean"))["_mean"].alias("_o"))
    both = pairs.alias("a").join(origin.alias("b"), stats._same([*keys, "_test", *params], "a", "b")).select("a.*", "_o")
    n, d = F.sum("_n"), F.col("_mean") - F.col("_o")
    s = F.sum(F.col("_n") * d)
    out = both.groupBy(*keys, F.col("_test").alias(fold), *params).agg(n.alias("_n"), (F.first("_o") + s / n).alias("_mean"), F.greatest(F.sum("_m2") + F.sum(F.col("_n") * d * d) - s * s / n, F.lit(0.0)).alias("_m2"))
    return out


def grow(config: DataFrame, params, keys=("name", "attr"), max_depth: int = 12, threshold: float | None = None, max_std: dict[str, float] | None = None, attr: str = "attr", binary_only: bool = False, relevant: bool | str = True, ignore_scalar: bool = False, keep_scalar: bool = False, min_gain: float = 0.0, least_information: float = 0.1) -> Grove:
    """91-97: all trees of ``config`` (``moments`` by keys), under the rules of ``trees.grow``.

    A tree's threshold is the given one, else that of its ``attr`` in ``max_std``, else the mean deviation within its
    configurations. A split gains if means of its groups differ by more than rounding does (``NOISE``), however little that is
    of the node's squares; ``min_gain`` asks for a share of these. ``keep_scalar`` leaves scalar parameters of three values or more to functions of the leaves. Keys are
    not null; types of parameters are those within the first key.
    """
    keys, params = list(keys), sorted(params)
    root = F.concat(F.to_json(F.struct(*keys)), F.lit("#r"))
    config = cut(config.withColumn("_root", root))
    within = F.avg(F.sqrt(F.col("_m2") / F.col("_n")))
    given = F.lit(threshold).cast("double") if threshold is not None or not max_std else F.try_element_at(F.create_map(*(F.lit(x) for p in max_std.items() for x in p)), F.col(attr)).cast("double")
    heads = config.groupBy(*keys, "_root").agg((F.sum(F.col("_n") * F.col("_mean")) / F.sum("_n")).alias("_origin"), within.alias("_lut"))
    heads = cut(heads.withColumn("_stop", F.coalesce(given, "_lut", F.lit(0.0))))
    kinds = stats.param_types(config, params, keys[0])
    index = F.create_map(*(F.lit(x) for i, p in enumerate(params) for x in (p, i)))
    kinds = cut(kinds.select(F.col(keys[0]).alias("_first"), F.element_at(index, F.col("param")).alias("i"), ((F.col("type") == "SCALAR") & (F.col("distinct") >= 3)).alias("scalar")))
    n, s = F.sum("_n"), F.sum(F.col("_n") * F.col("_d"))
    squares = F.sum("_m2") + F.sum(F.col("_n") * F.col("_d") * F.col("_d")) - s * s / n
    placed = cut(config.join(heads.select("_root", "_origin"), "_root").withColumn("_d", F.col("_mean") - F.col("_origin")).withColumn("_node", F.col("_root")).select("_root", "_node", *params, "_n", "_m2", "_d"))
    each = F.array(*(F.struct(F.lit(i).alias("i"), _key(p).alias("v")) for i, p in enumerate(params)), F.struct(F.lit(-1).alias("i"), F.lit("").alias("v")))
    nodes, edges, level = [], [], 0
    while True:
        long = placed.select("_root", "_node", "_n", "_m2", "_d", F.explode(each).alias("e"))
        groups = cut(long.groupBy("_root", "_node", "e.i", "e.v").agg(n.alias("gn"), F.greatest(squares, F.lit(0.0)).alias("sq"), (s / n).alias("gd")))
        per = groups.groupBy("_root", "_node", "i").agg(F.sum("gn").alias("n"), F.sum("sq").alias("loss"), F.count("*").alias("k"), F.bool_or(F.col("v") == _NULL).alias("unset"), F.first("gd").alias("gd"), (F.max("gd") - F.min("gd")).alias("gap"))
        total = per.where("i = -1").select("_root", "_node", "n", F.col("loss").alias("whole"), "gd").join(heads, "_root")
        best = None
        if level < max_depth:
            may = per.where("i >= 0 and k >= 2 and not unset").drop("n", "gd").join(total, ["_root", "_node"])
            std = F.sqrt(F.greatest("whole", F.lit(0.0)) / F.col("n"))
            may = may.where((std > F.col("_stop")) & (F.col("gap") > NOISE * (F.abs(F.col("_origin") + F.col("gd")) + std)))
            if min_gain > 0:
                may = may.where(F.col("loss") < F.col("whole") * (1 - min_gain))
            if keep_scalar:
                may = may.withColumn("_first", F.col(keys[0])).join(kinds.where("scalar"), ["_first", "i"], "left_anti")
            if binary_only:
                may = may.where("k <= 2")
            if relevant and params:
                matters = _node_information(placed, params, least_information) if relevant == "information" else _node_deviation(placed, params, n, squares)
                matters = matters.where("not depends").select("_node", F.element_at(index, F.col("param")).alias("i"))
                may = may.join(matters, ["_node", "i"], "left_anti")
            if ignore_scalar:
                may = may.join(_settled_by_enums(placed, kinds, heads, params, keys, n, squares), "_node", "left_anti")
            best = may.groupBy("_node").agg(F.min(F.struct("loss", "i"))["i"].alias("_which"))
        here = total if best is None else total.join(best, "_node", "left")
        here = here.select(*keys, "_root", "_node", F.lit(level).alias("level"), (F.lit(None).cast("int") if best is None else F.col("_which")).alias("_which"), (F.col("_origin") + F.col("gd")).alias("value"), "n", F.col("whole").alias("squares"))
        here = cut(here)
        nodes.append(here)
        splits = here.where("_which is not null").select("_root", "_node", "_which")
        if splits.isEmpty():
            break
        order = Window.partitionBy("_node").orderBy(F.col("x").isNull(), F.coalesce("x", F.lit(0.0)), "v")
        kids = groups.join(splits.withColumnRenamed("_which", "i"), ["_root", "_node", "i"]).withColumn("x", F.when(F.col("v") != _NULL, numeric("v")))
        kids = cut(kids.select("_root", "_node", F.lit(level).alias("level"), F.col("i").alias("_which"), "v", "x", F.concat("_node", F.lit("."), (F.row_number().over(order) - 1).cast("string")).alias("child"), F.col("gn").alias("n")))
        edges.append(kids)
        moved = placed.join(splits, ["_root", "_node"]).withColumn("v", F.get(F.array(*(_key(p) for p in params)), "_which"))
        placed = cut(moved.join(kids.select("_root", "_node", "v", "child"), ["_root", "_node", "v"]).select("_root", F.col("child").alias("_node"), *params, "_n", "_m2", "_d"))
        level += 1
    name = F.get(F.array(*(F.lit(p) for p in params)).cast("array<string>"), F.col("_which")).alias("param")
    whole = reduce(DataFrame.unionByName, nodes).select(*keys, "_node", "level", name, "value", "n", "squares", F.lit(None).cast("array<double>").alias("beta"))
    none = config.sparkSession.createDataFrame([], "_node string, level int, param string, v string, x double, child string, n long")
    out = reduce(DataFrame.unionByName, edges).select("_node", "level", name, "v", "x", "child", "n") if edges else none
    return Grove(whole, out, heads.select(*keys, F.col("_root").alias("_node")), tuple(keys), tuple(params), level)


def _settled_by_enums(placed, kinds, heads, params, keys, n, squares) -> DataFrame:
    """95: nodes whose groups equal in all scalar parameters are within the threshold; nodes of trees without any are not."""
    flags = kinds.groupBy("_first").agg(F.array_sort(F.collect_list(F.when(F.col("scalar"), F.col("i")))).alias("which")).where(F.size("which") > 0)
    tree = heads.select("_root", "_stop", F.col(keys[0]).alias("_first")).join(flags, "_first")
    fixed = F.transform("which", lambda i: F.get(F.array(*(_key(p) for p in params)), i))
    groups = placed.join(tree, "_root").groupBy("_node", "_stop", fixed.alias("fixed")).agg(F.sqrt(F.greatest(squares, F.lit(0.0)) / n).alias("std"))
    return groups.groupBy("_node", "_stop").agg(F.max("std").alias("std")).where("std <= _stop").select("_node")


def _placed(rows: DataFrame, grove: Grove) -> DataFrame:
    """``rows`` with the ``_node`` they end in, for rows that the trees were grown on. Configurations are placed; rows meet them
    where they are, as few configurations would else send all rows to few tasks."""
    k = [*grove.keys, *grove.params]
    now = rows.select(*k).distinct().join(grove.roots, list(grove.keys))
    which = F.get(F.array(*(_key(p) for p in grove.params)), F.array_position(F.array(*(F.lit(p) for p in grove.params)), F.col("_p")).cast("int") - 1)
    for level in range(grove.depth):
        here = grove.edges.where(F.col("level") == level)
        now = now.join(here.select("_node", F.col("param").alias("_p")).distinct(), "_node", "left").withColumn("_v", which)
        now = now.join(here.select("_node", F.col("v").alias("_v"), F.col("child").alias("_to")), ["_node", "_v"], "left").withColumn("_node", F.coalesce("_to", "_node")).drop("_p", "_v", "_to")
    return rows.alias("r").join(broadcast_if_small(written(now)).alias("p"), stats._same(k, "r", "p")).select("r.*", "_node")


def _solved(k: int):
    """Coefficients of each row of sums, where they leave less than ``ls.USEFUL`` of the squares about the mean."""

    def run(batches):
        for pdf in batches:
            kept = []
            for r in pdf.to_dict("records"):
                beta = ls.solve(r, k)
                left = r["yy"] - 2 * sum(beta[i] * r[f"r{i}"] for i in range(k)) + sum(beta[i] * beta[j] * r[f"g{min(i, j)}_{max(i, j)}"] for i in range(k) for j in range(k))
                kept.append((r["_node"], [float(b) for b in beta]) if r["configs"] >= 3 and left < ls.USEFUL * r["m2"] else None)
            kept = [x for x in kept if x]
            yield pdf.head(len(kept))[["_node"]].assign(_node=[x[0] for x in kept], beta=[x[1] for x in kept])

    return run


def with_functions(grove: Grove, long: DataFrame, scalar, value: str = "value") -> Grove:
    """93: linear functions of the ``scalar`` parameters in the leaves where they help: one pass, and a small solve for each leaf in the tasks."""
    terms = tuple(ls.fol_terms(sorted(scalar)))
    k = len(terms)
    rows = _placed(long.withColumn("_y", F.col(value).cast("double")).where("_y is not null"), grove)
    named = rows.select("_node", "_y", F.struct(*sorted(scalar)).alias("_c"), *(ls.term(t).cast("double").alias(f"_{i}") for i, t in enumerate(terms)))
    good = reduce(lambda a, b: a & b, [F.col(f"_{i}").isNotNull() for i in range(k)])
    sums = [F.sum(F.col(f"_{i}") * F.col(f"_{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(F.col(f"_{i}") * F.col("_y")).alias(f"r{i}") for i in range(k)]
    by = named.where(good).groupBy("_node").agg(F.sum(F.col("_y") ** 2).alias("yy"), F.count_distinct("_c").alias("configs"), (F.var_pop("_y") * F.count("*")).alias("m2"), *sums)
    beta = cut(by.mapInPandas(_solved(k), "_node string, beta array<double>"))
    nodes = grove.nodes.drop("beta").join(beta, "_node", "left").withColumn("beta", F.when(F.col("param").isNull(), F.col("beta"))).select(grove.nodes.columns)
    return Grove(cut(nodes), grove.edges, grove.roots, grove.keys, grove.params, grove.depth, terms)


def predict(rows: DataFrame, grove: Grove, weighted: bool = False, out: str = "predicted") -> DataFrame:
    """110, 111: ``rows`` with the prediction of their key's tree; rows of a key without tree are left out.

    Worked out once for each different configuration. A value without child goes on to several children with weights: to
    its numeric neighbours (beyond the outermost ones, to these) along the line through them, else to all alike, or by
    their rows if ``weighted``.
    """
    keys, params = list(grove.keys), list(grove.params)
    used = sorted({*params, *(p for t in grove.terms for p, _ in t)})
    kid = F.struct("x", "v", F.col("child").alias("to"), (F.col("n") if weighted else F.lit(1)).cast("double").alias("w"))
    kids = grove.edges.groupBy("level", "_node", "param").agg(F.sort_array(F.collect_list(kid)).alias("_kids"))
    kids = cut(kids.withColumns({"_all": F.aggregate("_kids", F.lit(0.0), lambda a, c: a + c["w"]), "_line": F.forall("_kids", lambda c: c["x"].isNotNull()) & (F.size("_kids") > 1)}))
    now = rows.select(*keys, *used).distinct().join(grove.roots, keys).withColumn("_w", F.lit(1.0))
    at = F.array_position(F.array(*(F.lit(p) for p in params)), F.col("param")).cast("int") - 1
    one = lambda to, w: F.struct(to.alias("to"), w.alias("w"))
    for level in range(grove.depth):
        now = now.join(kids.where(F.col("level") == level).drop("level"), "_node", "left")
        now = now.withColumns({"_v": F.get(F.array(*(_key(p) for p in params)), at), "_x": F.get(F.array(*(numeric(p) for p in params)), at)})
        now = now.withColumn("_same", F.filter("_kids", lambda c: c["v"] == F.col("_v")))
        first, last = F.get("_kids", F.lit(0)), F.get("_kids", F.size("_kids") - 1)
        inside = (F.col("_x") > first["x"]) & (F.col("_x") < last["x"])
        end = lambda c: F.struct(c["x"], c["to"])
        low = F.when(inside, F.array_max(F.transform(F.filter("_kids", lambda c: c["x"] < F.col("_x")), end))).otherwise(end(first))
        high = F.when(inside, F.array_min(F.transform(F.filter("_kids", lambda c: c["x"] > F.col("_x")), end))).otherwise(end(last))
        part = (F.col("_x") - low["x"]) / (high["x"] - low["x"])
        go = (
            F.when(F.col("_kids").isNull(), F.array(one(F.col("_node"), F.lit(1.0))))
            .when(F.size("_same") > 0, F.array(one(F.get("_same", F.lit(0))["to"], F.lit(1.0))))
            .when(F.col("_line") & F.col("_x").isNotNull(), F.array(one(low["to"], 1 - part), one(high["to"], part)))
            .otherwise(F.transform("_kids", lambda c: one(c["to"], c["w"] / F.col("_all"))))
        )
        now = now.withColumn("_go", F.explode(go)).select(*keys, *used, F.col("_go.to").alias("_node"), (F.col("_w") * F.col("_go.w")).alias("_w"))
    value: Column = F.col("value")
    if grove.terms:
        value = F.coalesce(reduce(lambda a, b: a + b, [F.get("beta", F.lit(i)) * ls.term(t) for i, t in enumerate(grove.terms)]), value)
    leaves = grove.nodes.where("param is null").select("_node", F.col("value"), "beta")
    found = now.join(leaves, "_node").groupBy(*keys, *used).agg(F.sum(F.col("_w") * value).alias(out))
    return rows.alias("r").join(broadcast_if_small(written(found)).alias("p"), stats._same([*keys, *used], "r", "p")).select("r.*", out)


def prune(grove: Grove) -> Grove:
    """98: equal sub-trees of a split become one, from the leaves up; a split of one remaining child becomes that child."""
    known = cut(grove.nodes.where(F.col("param").isNull()).select("_node", F.sha2(F.concat_ws("|", F.lit("leaf"), F.col("value").cast("string"), F.to_json(F.struct("beta"))), 256).alias("sig"), F.col("_node").alias("target")))
    edges = []
    for level in reversed(range(grove.depth)):
        here = grove.edges.where(F.col("level") == level).join(known.select(F.col("_node").alias("child"), "sig", "target"), "child")
        same = Window.partitionBy("_node", "sig")
        here = here.withColumn("_to", F.min("target").over(same))
        split = here.groupBy("_node", "param").agg(F.count_distinct("sig").alias("k"), F.min("_to").alias("to"), F.min("sig").alias("only"), F.sha2(F.concat_ws("|", "param", F.to_json(F.sort_array(F.collect_list(F.struct("v", "sig"))))), 256).alias("own"))
        split = cut(split)
        known = cut(known.union(split.select("_node", F.when(F.col("k") == 1, F.col("only")).otherwise(F.col("own")), F.when(F.col("k") == 1, F.col("to")).otherwise(F.col("_node")))))
        edges.append(cut(here.join(split.where("k > 1").select("_node"), "_node", "left_semi").select("_node", "level", "param", "v", "x", F.col("_to").alias("child"), "n")))
    roots = cut(grove.roots.join(known.select("_node", "target"), "_node").select(*grove.keys, F.col("target").alias("_node")))
    every = reduce(DataFrame.unionByName, edges) if edges else grove.edges
    # What no root reaches any more goes; levels are counted anew from the roots.
    reach, nodes, kept, level = roots.select("_node"), [], [], 0
    while True:
        met = grove.nodes.drop("level").join(reach, "_node").withColumn("level", F.lit(level))
        going = cut(every.drop("level").join(reach, "_node").withColumn("level", F.lit(level)))
        nodes.append(met)
        if going.isEmpty():
            break
        kept.append(going)
        reach, level = going.select(F.col("child").alias("_node")).distinct(), level + 1
    all_nodes = reduce(DataFrame.unionByName, nodes)
    out_edges = reduce(DataFrame.unionByName, kept).select(grove.edges.columns) if kept else grove.edges.where("false")
    split = out_edges.select("_node", F.lit(True).alias("_split")).distinct()
    all_nodes = all_nodes.join(split, "_node", "left").withColumn("param", F.when(F.col("_split"), F.col("param"))).select(grove.nodes.columns)
    return Grove(cut(all_nodes), cut(out_edges), roots, grove.keys, grove.params, level, grove.terms)


def rules(grove: Grove, ordered: bool = False) -> DataFrame:
    """108: keys, path (an array of param and values), value, n and squares of every leaf.

    With ``ordered`` a step also has ``upto`` or ``above``, and no values, where a split has two children and a number parts
    the values of one from those of the other: such a step holds for values that were never seen, too.
    """
    step = "array<struct<param:string,values:array<string>>>" if not ordered else "array<struct<param:string,values:array<string>,upto:double,above:double>>"
    now = grove.roots.withColumn("path", F.array().cast(step))
    found = []
    for level in range(grove.depth + 1):
        arms = grove.edges.where(F.col("level") == level).groupBy("_node", "param", "child").agg(F.transform(F.sort_array(F.collect_list(F.struct("x", "v"))), lambda c: c["v"]).alias("values"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.bool_and(F.col("x").isNotNull()).alias("numbers"))
        parts = ["param", "values"]
        if ordered:
            whole = Window.partitionBy("_node")
            low, high = F.min("hi").over(whole), F.max("lo").over(whole)
            cuts = (F.count("*").over(whole) == 2) & F.min("numbers").over(whole) & (low < high) & (F.when(F.col("lo") == high, F.col("hi") > low).otherwise(F.col("hi") == low))
            arms = arms.withColumn("_cut", F.when(cuts, low)).withColumn("_cut", F.when(F.count("_cut").over(whole) == 2, F.col("_cut")))
            arms = arms.withColumns({"upto": F.when(F.col("hi") <= F.col("_cut"), F.col("_cut")), "above": F.when(F.col("hi") > F.col("_cut"), F.col("_cut")), "values": F.when(F.col("_cut").isNull(), F.col("values"))})
            parts += ["upto", "above"]
        met = now.join(arms, "_node", "left")
        found.append(met.where("child is null").select(*grove.keys, "_node", "path"))
        now = cut(met.where("child is not null").select(*grove.keys, F.col("child").alias("_node"), F.concat("path", F.array(F.struct(*parts))).cast(step).alias("path")))
    leaves = reduce(DataFrame.unionByName, found)
    return leaves.join(grove.nodes.select("_node", "value", "n", "squares"), "_node").drop("_node")


def complexity(grove: Grove) -> DataFrame:
    """107: nodes, leaves, depth and a score that counts leaf functions by their terms, for each key."""
    n = grove.nodes
    leaf = F.col("param").isNull()
    return n.groupBy(*grove.keys).agg(F.count("*").alias("nodes"), F.count_if(leaf).alias("leaves"), F.max("level").alias("depth"), F.sum(F.when(leaf & F.col("beta").isNotNull(), F.size("beta")).otherwise(1)).alias("score"))
