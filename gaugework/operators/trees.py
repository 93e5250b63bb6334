"""Tree models (inventory 91-109): multiway regression trees grown a level at a time, their rules,
pruning and compilation, and the boosted and binary trees of Spark's own library.

A tree is a small table on the driver: one ``Node`` each. Rows find their node a level at a time by
joins with it on (node, value), and a level costs one aggregation over all its nodes.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.observations import numeric
from gaugework.operators import fit as ls
from gaugework.operators.lineage import written
from gaugework.operators import stats


@dataclass(frozen=True)
class Node:
    """A leaf has ``value`` (and maybe ``beta`` for ``terms``); a split has ``param`` and ``children``.

    Children are keyed by tuples of values; a threshold split has the keys ``"<="`` and ``">"``.
    """

    value: float
    n: int = field(default=0, compare=False)
    param: str | None = None
    children: tuple = ()
    threshold: float | None = None
    terms: tuple = ()
    beta: tuple = ()


_NULL = "\x00null"
#: Means that differ by less than this share of their size and deviation differ by rounding alone.
NOISE = 1e-11


def _key(p: str) -> Column:
    return F.coalesce(F.col(p).cast("string"), F.lit(_NULL))


def _number(v: str):
    try:
        return float(v)
    except ValueError:
        return None


def stop_at(explicit: float | None, attr: str | None, max_std: dict[str, float] | None, std_lut: float | None) -> float:
    """97: the deviation at which a node is a leaf: given, else the attribute's own, else that within configurations, else 0."""
    for v in (explicit, (max_std or {}).get(attr), std_lut):
        if v is not None:
            return float(v)
    return 0.0


def grow(rows: DataFrame, params, value: str = "value", max_depth: int = 12, threshold: float | None = None, with_functions: bool = False, binary_only: bool = False, relevant: bool | str = True, ignore_scalar: bool = False, min_gain: float = 0.0, attr: str | None = None, max_std: dict[str, float] | None = None, least_information: float = 0.1) -> Node:
    """91-97: split each node by the parameter whose groups leave the least sum of squares.

    A parameter is no candidate in a node if it is unset in a row, has one value there, is a
    scalar of three or more values (over the whole name) while leaves may be functions, has
    over two values where only binary splits are wanted, or (``relevant``) does not matter by
    its deviations, or with "information" has less than ``least_information`` nats on the means in
    the node. A node is a leaf at the deviation that ``stop_at`` gives, at ``max_depth``, without
    candidates or without gain: means of a split's groups must differ by more than rounding does (``NOISE``), and ``min_gain`` may
    ask for a share of the node's squares. With ``ignore_scalar`` a node is also a leaf if its groups equal
    in all scalar parameters are within ``threshold``. Ties go to the first parameter.
    """
    params = sorted(params)
    kinds = {r["param"]: (r["type"], r["distinct"]) for r in stats.param_types(rows.withColumn("_all", F.lit("")), params, "_all").collect()}
    scalar = {p for p in params if kinds[p][0] == "SCALAR" and kinds[p][1] >= 3}
    base = rows.select(*params, F.col(value).cast("double").alias("_v")).where("_v is not null")
    config = base.groupBy(*params).agg(F.count("*").alias("_n"), F.avg("_v").alias("_mean"), (F.var_pop("_v") * F.count("*")).alias("_m2")).persist()
    first = config.agg(F.sum(F.col("_n") * F.col("_mean")) / F.sum("_n"), F.avg(F.sqrt(F.col("_m2") / F.col("_n")))).first()
    origin, threshold = first[0] or 0.0, stop_at(threshold, attr, max_std, first[1])
    config = config.withColumn("_d", F.col("_mean") - origin)
    n, s = F.sum("_n"), F.sum(F.col("_n") * F.col("_d"))
    squares = F.sum("_m2") + F.sum(F.col("_n") * F.col("_d") * F.col("_d")) - s * s / n
    splits: dict[str, tuple[str, list[str]]] = {}
    info: dict[str, tuple[int, float]] = {}
    open_nodes, depth = ["r"], 0
    placed = config.withColumn("_node", F.lit("r"))
    try:
        while open_nodes and depth <= max_depth:
            if depth:
                before, placed = placed, _descend(placed, splits, params, depth - 1, "inner").persist()
            each = F.array(*(F.struct(F.lit(i).alias("i"), _key(p).alias("v")) for i, p in enumerate(params)))
            long = placed.select("_node", "_n", "_m2", "_d", F.explode(F.array_append(each, F.struct(F.lit(-1).alias("i"), F.lit("").alias("v")))).alias("e"))
            groups = long.groupBy("_node", "e.i", "e.v").agg(n.alias("gn"), F.greatest(squares, F.lit(0.0)).alias("sq"), (s / n).alias("gd"))
            per = groups.groupBy("_node", "i").agg(F.sum("gn").alias("n"), F.sum("sq").alias("loss"), F.count("*").alias("k"), F.bool_or(F.col("v") == _NULL).alias("unset"), F.avg(F.sqrt(F.col("sq") / F.col("gn"))).alias("std"), F.first("gd").alias("gd"), (F.max("gd") - F.min("gd")).alias("gap"), F.collect_list("v").alias("values"))
            found: dict[str, dict[int, dict]] = {}
            for r in per.collect():
                found.setdefault(r["_node"], {})[r["i"]] = r.asDict()
            by = {}
            if relevant and params:
                dev = _node_information(placed, params, least_information) if relevant == "information" else _node_deviation(placed, params, n, squares)
                by = {(r["_node"], r["param"]): r["depends"] for r in dev.collect()}
            settled = set()
            if ignore_scalar and scalar:
                fixed = placed.groupBy("_node", *sorted(scalar)).agg(F.sqrt(F.greatest(squares, F.lit(0.0)) / n).alias("std"))
                settled = {r["_node"] for r in fixed.groupBy("_node").agg(F.max("std").alias("std")).where(F.col("std") <= threshold).collect()}
            going = []
            for node in open_nodes:
                mine = found.get(node)
                if mine is None:
                    continue
                total = mine[-1]
                info[node] = (int(total["n"]), origin + total["gd"])
                std = float(np.sqrt(max(total["loss"], 0.0) / total["n"]))
                if std <= threshold or depth == max_depth or node in settled:
                    continue
                best = (total["loss"] * (1 - min_gain) if min_gain > 0 else np.inf, None)
                for i, p in enumerate(params):
                    c = mine.get(i)
                    if c is None or c["unset"] or c["k"] < 2 or (with_functions and p in scalar) or (binary_only and c["k"] > 2) or (relevant and not by.get((node, p), True)):
                        continue
                    if c["gap"] <= NOISE * (abs(origin + total["gd"]) + std):
                        continue
                    if c["loss"] < best[0]:
                        best = (c["loss"], i)
                if best[1] is None:
                    continue
                values = sorted(mine[best[1]]["values"], key=lambda v: (_number(v) is None, _number(v) or 0.0, v))
                splits[node] = (params[best[1]], values)
                going += [f"{node}.{j}" for j in range(len(values))]
            if depth > 1:
                before.unpersist()
            open_nodes, depth = going, depth + 1
        tree = _build("r", splits, info)
        return _function_leaves(base, tree, splits, params, scalar) if with_functions and scalar else tree
    finally:
        placed.unpersist()
        config.unpersist()


def _node_deviation(placed: DataFrame, params, n, squares) -> DataFrame:
    """96: relevance of each parameter within each node, from configurations."""
    sets = [["_node", *(q for q in params if q != p)] for p in params]
    lut = placed.groupBy("_node").agg(F.avg(F.sqrt(F.col("_m2") / F.col("_n"))).alias("lut"))
    g = placed.groupingSets(sets, "_node", *params).agg(F.sqrt(F.greatest(squares, F.lit(0.0)) / n).alias("std"), *(F.grouping(p).alias(f"_{i}") for i, p in enumerate(params)))
    which = reduce(lambda out, ip: F.when(F.col(f"_{ip[0]}") == 1, ip[1]).otherwise(out), enumerate(params), F.lit(None).cast("string"))
    by = g.groupBy("_node", which.alias("param")).agg(F.avg("std").alias("by"))
    return by.join(lut, "_node").select("_node", "param", ((F.col("by") != 0) & (F.col("lut") / F.nullif(F.col("by"), F.lit(0.0)) < stats.RELEVANT)).alias("depends"))


def _node_information(placed: DataFrame, params, least: float, bins: int = 16) -> DataFrame:
    """96: relevance of each parameter within each node by its information on the configurations' means, in equal-count bins."""
    rows = stats.with_bins(placed.select("_node", "_d", *params), "_d", bins, "_node")
    long = rows.select("_node", "_bin", *(_key(p).alias(p) for p in params)).unpivot(["_node", "_bin"], list(params), "param", "value")
    return stats._information(long, ["_node", "param"], "value", "_bin").select("_node", "param", (F.col("information") >= least).alias("depends"))


def _descend(rows: DataFrame, splits, params, level: int, how: str) -> DataFrame:
    """Rows at the split nodes of a level moved on to their children, by joins on (node) and (node, value) with the tree's own small tables.

    Inner joins leave out the rows of other nodes, which are leaves; left ones keep them there.
    """
    here = {node: s for node, s in splits.items() if node.count(".") == level}
    spark = rows.sparkSession
    at = spark.createDataFrame([(node, params.index(p)) for node, (p, _) in here.items()], "_node string, _which int")
    to = spark.createDataFrame([(node, v, f"{node}.{j}") for node, (_, values) in here.items() for j, v in enumerate(values)], "_node string, _value string, _to string")
    found = rows.join(at, "_node", how).withColumn("_value", F.get(F.array(*(_key(p) for p in params)), "_which")).join(to, ["_node", "_value"], how)
    return found.withColumn("_node", F.coalesce("_to", "_node")).drop("_which", "_value", "_to")


def _build(node, splits, info) -> Node:
    n, mean = info[node]
    if node not in splits:
        return Node(mean, n)
    p, values = splits[node]
    return Node(mean, n, p, tuple(((v,), _build(f"{node}.{j}", splits, info)) for j, v in enumerate(values)))


def _function_leaves(base, tree, splits, params, scalar) -> Node:
    """93: linear functions of the scalar parameters in the leaves where these help, all leaves in one pass."""
    terms = tuple(ls.fol_terms(sorted(scalar)))
    rows = base.withColumn("_node", F.lit("r"))
    for level in range(1 + max((node.count(".") for node in splits), default=-1)):
        rows = _descend(rows, splits, params, level, "left")
    sums = {r["_node"]: r for r in ls.gram(rows, [ls.term(t) for t in terms], F.col("_v"), ["_node"])}
    spread = {r["_node"]: r for r in rows.groupBy("_node").agg(F.count_distinct(*sorted(scalar)).alias("c"), (F.var_pop("_v") * F.count("*")).alias("m2")).collect()}

    def walk(node, name):
        if node.param is not None:
            return replace(node, children=tuple((k, walk(c, f"{name}.{j}")) for j, (k, c) in enumerate(node.children)))
        r = sums.get(name)
        if r is None or spread[name]["c"] < 3:
            return node
        beta = ls.solve(r, len(terms))
        ssr = r["yy"] - 2 * sum(beta[i] * r[f"r{i}"] for i in range(len(terms))) + sum(beta[i] * beta[j] * r[f"g{min(i, j)}_{max(i, j)}"] for i in range(len(terms)) for j in range(len(terms)))
        return replace(node, terms=terms, beta=tuple(beta)) if ssr < ls.USEFUL * spread[name]["m2"] else node

    return walk(tree, "r")


def prune(node: Node, ordered: bool = False) -> Node:
    """98: equal sub-trees of a split become one; with ``ordered``, ``<=`` splits where numbers separate two of them."""
    if node.param is None:
        return node
    merged: list[list] = []
    for key, child in node.children:
        child = prune(child, ordered)
        same = next((m for m in merged if m[1] == child), None)
        if same:
            same[0] = (*same[0], *key)
            same[1] = replace(same[1], n=same[1].n + child.n)
        else:
            merged.append([key, child])
    if len(merged) == 1:
        return merged[0][1]
    if ordered and len(merged) == 2 and all(_number(v) is not None for k, _ in merged for v in k):
        (a, left), (b, right) = sorted(merged, key=lambda m: max(map(_number, m[0])))
        top = max(map(_number, a))
        if top < min(map(_number, b)):
            return replace(node, threshold=top, children=(("<=", left), (">", right)))
    return replace(node, children=tuple((k, c) for k, c in merged))


def _show(v: str) -> str:
    return "null" if v == _NULL else v


def flatten(node: Node, path: tuple = ()) -> list[tuple[tuple, float]]:
    """108: (path of (param, op, value), value) of every leaf."""
    if node.param is None:
        return [(path, node.value)]
    out = []
    for key, child in node.children:
        if node.threshold is not None:
            step = (node.param, key, node.threshold)
        else:
            vals = tuple(_number(v) if _number(v) is not None else _show(v) for v in key)
            step = (node.param, "==", vals[0]) if len(vals) == 1 else (node.param, "in", vals)
        out += flatten(child, (*path, step))
    return out


def compiled(node: Node, weighted: bool = False) -> Column:
    """110, 111: the model as one column.

    A value without child: between numeric children it is interpolated, beyond them the line
    through the outermost goes on; among others it gets the mean of the children.
    """
    if node.param is None:
        if node.beta:
            return F.coalesce(reduce(lambda a, b: a + b, [F.lit(float(b)) * ls.term(t) for t, b in zip(node.terms, node.beta, strict=True)]), F.lit(float(node.value)))
        return F.lit(float(node.value))
    if node.threshold is not None:
        (_, left), (_, right) = node.children
        x = numeric(node.param)
        return F.when(x <= node.threshold, compiled(left, weighted)).when(x > node.threshold, compiled(right, weighted)).otherwise(F.lit(float(node.value)))
    if all(c.param is None and not c.beta for _, c in node.children):
        return _constant_leaves(node, weighted)
    out = None
    for key, child in node.children:
        cond = _key(node.param).isin(*key)
        out = F.when(cond, compiled(child, weighted)) if out is None else out.when(cond, compiled(child, weighted))
    return out.otherwise(_unseen(node, weighted))


def _constant_leaves(node: Node, weighted: bool) -> Column:
    """A split into constants as two lookups, whatever the number of values."""
    pairs = [(v, float(c.value)) for k, c in node.children for v in k]
    seen = F.try_element_at(F.create_map(*(F.lit(x) for p in pairs for x in p)), _key(node.param))
    total = sum(c.n if weighted else 1 for _, c in node.children)
    mean = sum(c.value * (c.n if weighted else 1) for _, c in node.children) / total
    points = sorted((_number(v), y) for v, y in pairs if _number(v) is not None)
    if len(points) < len(pairs) or len(points) < 2:
        return F.coalesce(seen, F.lit(mean))
    x = numeric(node.param)
    at = F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in points))
    inside = (x > points[0][0]) & (x < points[-1][0])
    low = F.when(inside, F.array_max(F.filter(at, lambda p: p["x"] < x))).otherwise(at[0])
    high = F.when(inside, F.array_min(F.filter(at, lambda p: p["x"] > x))).otherwise(at[len(points) - 1])
    line = low["y"] + (high["y"] - low["y"]) * (x - low["x"]) / (high["x"] - low["x"])
    return F.coalesce(seen, line, F.lit(mean))


def _unseen(node: Node, weighted: bool) -> Column:
    numbers = sorted((_number(v), i) for i, (k, _) in enumerate(node.children) for v in k if _number(v) is not None)
    whole = all(_number(v) is not None for k, _ in node.children for v in k)
    if whole and len(numbers) >= 2:
        x = numeric(node.param)
        y = [compiled(c, weighted) for _, c in node.children]
        line = lambda a, b: y[a[1]] + (y[b[1]] - y[a[1]]) * (x - a[0]) / (b[0] - a[0])
        out = F.when((x < numbers[0][0]) | (x > numbers[-1][0]), line(numbers[0], numbers[-1]))
        for a, b in zip(numbers, numbers[1:], strict=False):
            out = out.when((x > a[0]) & (x < b[0]), line(a, b))
        return out.otherwise(_mean(node, weighted))
    return _mean(node, weighted)


def _mean(node: Node, weighted: bool) -> Column:
    w = [c.n if weighted else 1 for _, c in node.children]
    return reduce(lambda a, b: a + b, [compiled(c, weighted) * F.lit(k / sum(w)) for (_, c), k in zip(node.children, w, strict=True)])


def _tables(spark, node: Node, params, weighted: bool) -> tuple[list[DataFrame], DataFrame, tuple]:
    """The splits of each level, the leaves, and the terms that leaf functions share."""
    levels, leaves, terms = [], [], ()

    def walk(x: Node, name: str, level: int):
        nonlocal terms
        if x.param is None:
            terms = x.terms or terms
            leaves.append((name, float(x.value), [float(b) for b in x.beta] or None))
            return
        if len(levels) == level:
            levels.append([])
        total = sum(c.n if weighted else 1 for _, c in x.children)
        kids = [(v, _number(v) if x.threshold is None else None, f"{name}.{j}", (c.n if weighted else 1) / total / len(k if x.threshold is None else [k])) for j, (k, c) in enumerate(x.children) for v in (k if x.threshold is None else [k])]
        kids.sort(key=lambda c: (c[1] is None, c[1] or 0.0))
        levels[level].append((name, params.index(x.param), x.threshold, all(c[1] is not None for c in kids) and len(kids) > 1, kids))
        leaves.append((name + "!", float(x.value), None))
        for j, (_, c) in enumerate(x.children):
            walk(c, f"{name}.{j}", level + 1)

    walk(node, "r", 0)
    shape = "_node string, _which int, _cut double, _line boolean, _kids array<struct<v: string, x: double, to: string, w: double>>"
    return [spark.createDataFrame(level, shape) for level in levels], spark.createDataFrame(leaves, "_node string, _value double, _beta array<double>"), terms


def predict(rows: DataFrame, node: Node, params, weighted: bool = False) -> DataFrame:
    """110, 111: ``rows`` with ``predicted``, worked out for each different configuration, a level at a time by joins with the tree's small tables.

    Where a value has no child, a row goes on to several with weights: to the numeric neighbours by the line between
    them (beyond the outermost ones, the line through these), else to all children alike. So the plan grows with the
    depth of a tree and not with its nodes; ``compiled`` gives the same as one column, for small trees.
    """
    params = sorted(params)
    levels, leaves, terms = _tables(rows.sparkSession, node, params, weighted)
    used = sorted({*params, *(p for t in terms for p, _ in t)})
    now = rows.select(*used).distinct().select("*", F.lit("r").alias("_node"), F.lit(1.0).alias("_w"))
    one = lambda to, w: F.struct(to.alias("to"), w.alias("w"))
    for level in levels:
        v, x = F.get(F.array(*(_key(p) for p in params)), "_which"), F.get(F.array(*(numeric(p) for p in params)), "_which")
        now = now.join(level, "_node", "left").withColumns({"_v": v, "_x": x})
        now = now.withColumn("_same", F.filter("_kids", lambda c: c["v"] == F.col("_v")))
        last = F.get("_kids", F.size("_kids") - 1)
        first = F.get("_kids", F.lit(0))
        inside = (F.col("_x") > first["x"]) & (F.col("_x") < last["x"])
        low = F.when(inside, F.array_max(F.transform(F.filter("_kids", lambda c: c["x"] < F.col("_x")), lambda c: F.struct(c["x"], c["to"])))).otherwise(F.struct(first["x"], first["to"]))
        high = F.when(inside, F.array_min(F.transform(F.filter("_kids", lambda c: c["x"] > F.col("_x")), lambda c: F.struct(c["x"], c["to"])))).otherwise(F.struct(last["x"], last["to"]))
        part = (F.col("_x") - low["x"]) / (high["x"] - low["x"])
        cut = F.when(F.col("_x") <= F.col("_cut"), first["to"]).when(F.col("_x") > F.col("_cut"), last["to"]).otherwise(F.concat("_node", F.lit("!")))
        go = (
            F.when(F.col("_which").isNull(), F.array(one(F.col("_node"), F.lit(1.0))))
            .when(F.col("_cut").isNotNull(), F.array(one(cut, F.lit(1.0))))
            .when(F.size("_same") > 0, F.array(one(F.get("_same", F.lit(0))["to"], F.lit(1.0))))
            .when(F.col("_line") & F.col("_x").isNotNull(), F.array(one(low["to"], 1 - part), one(high["to"], part)))
            .otherwise(F.transform("_kids", lambda c: one(c["to"], c["w"])))
        )
        now = now.withColumn("_go", F.explode(go)).select(*used, F.col("_go.to").alias("_node"), (F.col("_w") * F.col("_go.w")).alias("_w"))
    value = F.col("_value")
    if terms:
        value = F.coalesce(reduce(lambda a, b: a + b, [F.get("_beta", F.lit(i)) * ls.term(t) for i, t in enumerate(terms)]), value)
    found = now.join(leaves, "_node").groupBy(*used).agg(F.sum(F.col("_w") * value).alias("predicted"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in used]
    return rows.alias("r").join(found.alias("p"), same).select("r.*", "predicted")


def complexity(node: Node) -> dict[str, int]:
    """107: nodes, leaves, depth, and a score that counts leaf functions by their terms."""
    if node.param is None:
        return {"nodes": 1, "leaves": 1, "depth": 0, "score": max(1, len(node.beta))}
    parts = [complexity(c) for _, c in node.children]
    return {"nodes": 1 + sum(p["nodes"] for p in parts), "leaves": sum(p["leaves"] for p in parts), "depth": 1 + max(p["depth"] for p in parts), "score": 1 + sum(p["score"] for p in parts)}


def to_json(node: Node) -> dict:
    """22: nested model JSON."""
    if node.param is None:
        return {"type": "analytic", "terms": [list(map(list, t)) for t in node.terms], "beta": list(node.beta), "value": node.value} if node.beta else {"type": "static", "value": node.value}
    if node.threshold is not None:
        return {"type": "scalarSplit", "paramName": node.param, "threshold": node.threshold, "value": node.value, "left": to_json(node.children[0][1]), "right": to_json(node.children[1][1])}
    return {"type": "split", "paramName": node.param, "value": node.value, "child": {json.dumps(list(k)): to_json(c) for k, c in node.children}}


def from_json(data: dict) -> Node:
    """22, back again."""
    match data["type"]:
        case "static":
            return Node(data["value"])
        case "analytic":
            return Node(data["value"], terms=tuple(tuple(map(tuple, t)) for t in data["terms"]), beta=tuple(data["beta"]))
        case "scalarSplit":
            return Node(data["value"], param=data["paramName"], threshold=data["threshold"], children=(("<=", from_json(data["left"])), (">", from_json(data["right"]))))
    return Node(data["value"], param=data["paramName"], children=tuple((tuple(json.loads(k)), from_json(c)) for k, c in data["child"].items()))


def node_table(spark, node: Node) -> tuple[DataFrame, DataFrame]:
    """24: nodes (id, label) and edges (source, target, label) of a tree."""
    nodes, edges = [], []

    def walk(x, name):
        nodes.append((name, x.param if x.param is not None else f"{x.value:.6g}"))
        for j, (k, c) in enumerate(x.children):
            edges.append((name, f"{name}.{j}", f"{k} {x.threshold:g}" if x.threshold is not None else ", ".join(map(_show, k))))
            walk(c, f"{name}.{j}")

    walk(node, "r")
    return spark.createDataFrame(nodes, "id string, label string"), spark.createDataFrame(edges, "source string, target string, label string")


def expression(node: Node) -> str:
    """109: the model as SQL text."""
    if node.param is None:
        if not node.beta:
            return repr(float(node.value))
        sql = {"linear": "{0}", "logarithmic": "ln({0})", "logarithmic1": "ln(1 + {0})", "exponential": "exp({0})", "square": "({0} * {0})", "inverse": "(1 / {0})", "sqrt": "sqrt({0})"}
        return " + ".join(" * ".join([repr(float(b)), *(sql[f].format(p) for p, f in t)]) for t, b in zip(node.terms, node.beta, strict=True))
    if node.threshold is not None:
        return f"CASE WHEN {node.param} <= {node.threshold!r} THEN {expression(node.children[0][1])} ELSE {expression(node.children[1][1])} END"
    quote = lambda v: f"{_number(v)!r}" if _number(v) is not None else f"'{v}'"
    arms = " ".join(f"WHEN {node.param} IN ({', '.join(map(quote, k))}) THEN {expression(c)}" for k, c in node.children)
    return f"CASE {arms} ELSE {float(node.value)!r} END"


def ensemble(models: list[Column], how: str = "sum", intercept: float = 0.0) -> Column:
    """105: intercept plus the sum or mean of sub-models."""
    total = reduce(lambda a, b: a + b, models)
    return F.lit(intercept) + (total / len(models) if how == "mean" else total)


def model_plan(dev: DataFrame, types: DataFrame) -> DataFrame:
    """99: for each (name, attr): tree if a relevant parameter is no scalar of three values, functions if all are, else static."""
    rel = stats.relevance(dev).join(types.select("name", "param", "type", "distinct"), ["name", "param"])
    n = rel.groupBy("name", "attr").agg(F.count_if("depends").alias("relevant"), F.count_if(F.col("depends") & (F.col("type") == "SCALAR") & (F.col("distinct") >= 3)).alias("scalars"))
    return n.select("name", "attr", "relevant", F.when(F.col("relevant") == 0, "static").when(F.col("relevant") == F.col("scalars"), "functions").otherwise("tree").alias("model"))


def features(df: DataFrame, numbers, categories=(), out: str = "features") -> DataFrame:
    """Feature vectors: numbers as they are, categories by index."""
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    for c in categories:
        df = StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep", stringOrderType="alphabetAsc").fit(df).transform(df)
    return VectorAssembler(inputCols=[*numbers, *(f"{c}_index" for c in categories)], outputCol=out, handleInvalid="skip").transform(df)


def library_tree(kind: str, train: DataFrame, label: str = "value", **options):
    """100, 101, 103, 104: cart, boosted or forest regressor; decart is cart on features without scalars."""
    from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor

    made = {"cart": DecisionTreeRegressor, "boosted": GBTRegressor, "forest": RandomForestRegressor}[kind]
    defaults = {"cart": {"maxDepth": 10, "maxBins": 128}, "boosted": {"maxIter": 20, "maxDepth": 5, "stepSize": 0.3, "subsamplingRate": 1.0}, "forest": {"numTrees": 20, "maxDepth": 8}}[kind]
    return made(labelCol=label, featuresCol="features", seed=1, **{**defaults, **options}).fit(train)


def weighted(rows: DataFrame, params, label: str = "value") -> DataFrame:
    """103: rows of ``features`` with equal ``params`` as one row of their mean label and ``weight``, the number of rows.

    With squared loss the mean and the weight of equal rows are all that a tree's splits and leaves depend on, in every round.
    """
    groups = rows.where(F.col(label).isNotNull()).groupBy(*params).agg(F.first("features").alias("features"), F.avg(label).alias(label), F.count("*").cast("double").alias("weight"))
    return written(groups)


def linear_tree(rows: DataFrame, params, value: str = "value", max_depth: int = 5, bins: int = 120, min_rows: int = 6, min_share: float = 0.1) -> Node:
    """102: top-down linear model tree. One pass a level: sums of products for each (node, feature, quantile bin);
    running sums over bins give both sides of every candidate cut. A cut is kept if the sides' squares are below the node's."""
    params = sorted(params)
    k = len(params) + 1
    terms = tuple(ls.fol_terms(params))
    base = rows.select(*(numeric(p).alias(p) for p in params), F.col(value).cast("double").alias("_v")).dropna().persist()
    edges = {p: sorted(set(base.select(F.percentile_approx(p, [i / bins for i in range(1, bins)], 10_000)).first()[0] or [])) for p in params}
    total = base.count()
    least = max(min_rows, int(min_share * total))
    cuts: dict[str, tuple[str, float]] = {}
    leaves: dict[str, tuple] = {}

    def moments(row):
        g = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                g[i, j] = g[j, i] = row[f"g{i}_{j}"]
        return row["n"], row["yy"], g, np.array([row[f"r{i}"] for i in range(k)])

    def loss(m):
        n, yy, g, r = m
        scale = np.sqrt(np.maximum(np.diag(g), 1e-300))
        beta = np.linalg.pinv(g / np.outer(scale, scale), rcond=1e-10, hermitian=True) @ (r / scale) / scale
        return max(yy - 2 * beta @ r + beta @ g @ beta, 0.0), beta

    def below(p):
        return lambda e: e < F.col(p)

    def place():
        out = F.lit("r")
        for node in sorted(cuts, key=len):
            p, t = cuts[node]
            out = F.when(out == node, F.when(F.col(p) <= t, node + "0").otherwise(node + "1")).otherwise(out)
        return out

    try:
        nodes = ["r"]
        for depth in range(max_depth + 1):
            if not nodes:
                break
            placed = base.withColumn("_node", place()).where(F.col("_node").isin(nodes))
            each = F.array(*(F.struct(F.lit(i).alias("f"), F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges[p])).cast("array<double>"), below(p))).alias("b")) for i, p in enumerate(params)))
            tagged = placed.withColumn("_e", F.explode(each)).withColumns({"_f": F.col("_e.f"), "_b": F.col("_e.b")})
            by: dict = {}
            for r in ls.gram(tagged, [ls.term(t) for t in terms], F.col("_v"), ["_node", "_f", "_b"]):
                by.setdefault(r["_node"], {}).setdefault(r["_f"], {})[r["_b"]] = moments(r)
            going = []
            add = lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True))
            for node, feats in by.items():
                whole = reduce(add, feats[0].values())
                own, beta = loss(whole)
                leaves[node] = (whole[0], whole[3][0] / whole[0], beta)
                best = (own, None)
                for f, bs in feats.items():
                    run = None
                    for b in sorted(bs)[:-1]:
                        run = bs[b] if run is None else add(run, bs[b])
                        rest = tuple(x - y for x, y in zip(whole, run, strict=True))
                        if depth < max_depth and run[0] >= least and rest[0] >= least:
                            both = loss(run)[0] + loss(rest)[0]
                            if both < best[0] * (1 - 1e-6) and b < len(edges[params[f]]):
                                best = (both, (params[f], float(edges[params[f]][b])))
                if best[1]:
                    cuts[node] = best[1]
                    going += [node + "0", node + "1"]
            nodes = going
    finally:
        base.unpersist()

    def build(node):
        n, mean, beta = leaves[node]
        if node not in cuts:
            return Node(float(mean), int(n), terms=terms, beta=tuple(map(float, beta)))
        p, t = cuts[node]
        return Node(float(mean), int(n), p, (("<=", build(node + "0")), (">", build(node + "1"))), t)

    return build("r")


def substate_power(sequence: DataFrame, models: DataFrame, keys, total: str = "duration") -> DataFrame:
    """106: mean power of predicted sub-state sequences; the last sub-state fills the rest of the total duration."""
    rows = sequence.join(models, "substate")
    last = F.max(F.struct("position", "power")).alias("last")
    agg = rows.groupBy(*keys).agg(F.sum(F.col("power") * F.col("part")).alias("pt"), F.sum("part").alias("t"), F.first(total).alias("total"), last)
    rest = F.greatest(F.col("total") - F.col("t"), F.lit(0.0))
    return agg.select(*keys, ((F.col("pt") + F.col("last.power") * rest) / (F.col("t") + rest)).alias("power"))
