"""Second-order histogram boosting with regularised leaves (inventory 103): a sum of binary trees for every key, all keys in
one chain of jobs.

With squared loss a row's gradient is its prediction less its value, and its second derivative is 1. Rows that lie in the same
bins share their prediction in every round, so they are reduced once to moments of their bins (``_n``, ``_mean``); a round reads
these and not the rows. A level of a round is one aggregate: gradients and counts by (key, node, parameter, bin). Running sums
over the bins of a parameter give both sides of every threshold, and a node keeps the one of most gain. A tree travels as one
row a key with a map of its splits (at most 2 ** depth - 1), which expressions walk; no row is joined for each level.

With G and H the sums of gradients and second derivatives, and T(G) = sign(G) max(|G| - alpha, 0), a leaf's weight is
-eta T(G) / (H + lambda) and the gain of a split is S(left) + S(right) - S(node), with S = T(G)^2 / (H + lambda). A split needs
a gain over ``gamma`` and ``min_child`` of H on both sides. Rows without a value of the parameter go to the side that gains
more (left on ties). Equal gains go to the first parameter by name, then the least threshold.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.observations import numeric
from gaugework.operators import stats
from gaugework.operators.lineage import written

_SPLIT = "struct<param:int,threshold:double,unset_left:boolean,left:double,right:double>"


@dataclass(frozen=True)
class Boosted:
    """``base``: keys and value. ``trees``: keys, round, weight (of the root), splits (node to struct of param, threshold,
    unset_left and the weights of both children); the root is node 1, the children of node n are 2n and 2n + 1."""

    base: DataFrame
    trees: DataFrame
    keys: tuple[str, ...]
    params: tuple[str, ...]
    depth: int

    def leaves(self) -> DataFrame:
        """Keys, round, node, weight of all leaves."""
        each = self.trees.select(*self.keys, "round", "weight", "splits", F.explode(F.concat(F.array(F.struct(F.lit(1).alias("n"), F.col("weight").alias("w"))), F.flatten(F.transform(
            F.map_entries("splits"), lambda e: F.array(F.struct((e["key"] * 2).alias("n"), e["value"]["left"].alias("w")), F.struct((e["key"] * 2 + 1).alias("n"), e["value"]["right"].alias("w"))))))).alias("x"))
        return each.where(~F.map_contains_key("splits", F.col("x.n"))).select(*self.keys, "round", F.col("x.n").alias("node"), F.col("x.w").alias("weight"))


def _edges(long: DataFrame, keys, bins: int) -> DataFrame:
    """Keys and ``_edges``, the values that thresholds are taken from, for each parameter: all values where there are at most
    ``bins``, else quantiles of the different values."""
    present = long.where("x is not null")
    counts = present.groupBy(*keys, "p", "x").agg(F.count("*").alias("_c"))
    size = counts.groupBy(*keys, "p").agg(F.count("*").alias("_k"))
    few = counts.alias("c").join(size.where(F.col("_k") <= bins).alias("s"), stats._same([*keys, "p"], "c", "s")).select("c.*")
    exact = few.groupBy(*keys, "p").agg(F.array_sort(F.collect_list("x")).alias("_e"))
    rough = counts.alias("c").join(size.where(F.col("_k") > bins).alias("s"), stats._same([*keys, "p"], "c", "s")).select("c.*")
    rough = rough.groupBy(*keys, "p").agg(F.array_sort(F.array_distinct(F.percentile_approx("x", [i / bins for i in range(bins)], 20 * bins))).alias("_e"))
    return exact.unionByName(rough).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("p", "_e"))).alias("_edges"))


def _walk(splits: str | Column, depth: int, left_of) -> Column:
    """The node that a row ends in; ``left_of`` says whether it goes to the left at a split."""
    splits = F.col(splits) if isinstance(splits, str) else splits

    def step(node, _):
        s = F.try_element_at(splits, node)
        return F.when(s.isNull(), node).when(left_of(s), node * 2).otherwise(node * 2 + 1)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), step) if depth else F.lit(1)


def _weight(splits: str, node: Column, root: str) -> Column:
    parent = F.try_element_at(F.col(splits), F.floor(node / 2).cast("int"))
    return F.when(node == 1, F.col(root)).when(node % 2 == 0, parent["left"]).otherwise(parent["right"])


def boost(long: DataFrame, params, keys=("name", "attr"), value: str = "value", rounds: int = 100, max_depth: int = 6, eta: float = 0.3, gamma: float = 0.0, alpha: float = 0.0, lam: float = 1.0, min_child: float = 1.0, bins: int = 256) -> Boosted:
    """The trees of every key of ``long`` (keys, numeric parameters, value); parameters that are no number count as unset.

    Rows without a value take no part. A key of one row, or whose rows have no differing parameter, has trees of a root alone.
    """
    keys, params = list(keys), sorted(params)
    x = F.array(*(numeric(p) for p in params)).cast("array<double>")
    rows = long.select(*keys, x.alias("_x"), F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    # One row for each different vector of parameters: edges and bins are worked out on these.
    exact = written(rows.groupBy(*keys, "_x").agg(F.count("*").alias("_n"), F.avg("_v").alias("_mean")))
    base = written(exact.groupBy(*keys).agg((F.sum(F.col("_n") * F.col("_mean")) / F.sum("_n")).alias("value")))
    each = exact.select(*keys, "_n", F.posexplode("_x").alias("p", "x"))
    edges = written(_edges(each, keys, bins))

    def bin_of(i):
        at = F.try_element_at(F.col("_edges"), F.lit(i))
        return F.when(F.get("_x", F.lit(i)).isNotNull(), F.size(F.filter(at, lambda e: e <= F.get("_x", F.lit(i))))).otherwise(-1)

    binned = exact.alias("d").join(edges.alias("e"), stats._same(keys, "d", "e") or F.lit(True), "left").select("d.*", "_edges")
    binned = binned.select(*keys, F.array(*(bin_of(i) for i in range(len(params)))).cast("array<int>").alias("_bin"), "_n", "_mean")
    n = F.sum("_n")
    binned = binned.groupBy(*keys, "_bin").agg((F.sum(F.col("_n") * F.col("_mean")) / n).alias("_mean"), n.alias("_n"))
    now = binned.alias("d").join(base.alias("b"), stats._same(keys, "d", "b") or F.lit(True)).select("d.*", F.col("b.value").alias("_pred"))
    now = written(now)

    def soft(g):
        return F.signum(g) * F.greatest(F.abs(g) - alpha, F.lit(0.0))

    def score(g, h):
        return soft(g) * soft(g) / (h + lam)

    def weight(g, h):
        return F.coalesce(F.try_divide(-eta * soft(g), h + lam), F.lit(0.0))

    def by_bin(splits):
        return lambda s: F.when(F.get("_bin", s["param"]) == -1, s["unset_left"]).otherwise(F.get("_bin", s["param"]) < s["bin"])

    trees = []
    for t in range(rounds):
        root = now.groupBy(*keys).agg(F.sum(F.col("_n") * (F.col("_pred") - F.col("_mean"))).alias("_g"), n.cast("double").alias("_h"))
        tree = written(root.select(*keys, weight(F.col("_g"), F.col("_h")).alias("weight"), F.lit(None).cast("map<int,struct<param:int,bin:int,unset_left:boolean,left:double,right:double>>").alias("splits")))
        for level in range(max_depth):
            placed = now.alias("d").join(tree.alias("t"), stats._same(keys, "d", "t") or F.lit(True)).select("d.*", "splits")
            placed = placed.withColumn("_node", _walk("splits", level, by_bin("splits"))).where(F.col("_node") >= 2**level)
            long_ = placed.select(*keys, "_node", (F.col("_n") * (F.col("_pred") - F.col("_mean"))).alias("_g"), "_n", F.posexplode("_bin").alias("p", "b"))
            hist = long_.groupBy(*keys, "_node", "p", "b").agg(F.sum("_g").alias("g"), F.sum("_n").cast("double").alias("h"))
            whole, upto = Window.partitionBy(*keys, "_node", "p"), Window.partitionBy(*keys, "_node", "p").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
            seen = F.col("b") >= 0

            def total(c, w, when):
                return F.coalesce(F.sum(F.when(when, F.col(c))).over(w), F.lit(0.0))

            sides = hist.select(*keys, "_node", "p", "b", total("g", whole, F.lit(True)).alias("G"), total("h", whole, F.lit(True)).alias("H"), total("g", whole, ~seen).alias("ug"), total("h", whole, ~seen).alias("uh"), total("g", upto, seen).alias("lg"), total("h", upto, seen).alias("lh"))
            both = sides.where(seen).select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("unset_left")).where("unset_left or uh > 0")
            both = both.withColumns({"lg": F.col("lg") + F.when(F.col("unset_left"), F.col("ug")).otherwise(0.0), "lh": F.col("lh") + F.when(F.col("unset_left"), F.col("uh")).otherwise(0.0)})
            both = both.withColumns({"rg": F.col("G") - F.col("lg"), "rh": F.col("H") - F.col("lh")}).where((F.col("lh") >= min_child) & (F.col("rh") >= min_child) & (F.col("lh") > 0) & (F.col("rh") > 0))
            both = both.withColumn("gain", score(F.col("lg"), F.col("lh")) + score(F.col("rg"), F.col("rh")) - score(F.col("G"), F.col("H"))).where(F.col("gain") > max(gamma, 1e-6))
            chosen = F.struct(F.col("p").alias("param"), F.col("b").alias("bin"), "unset_left", weight(F.col("lg"), F.col("lh")).alias("left"), weight(F.col("rg"), F.col("rh")).alias("right"))
            best = both.groupBy(*keys, "_node").agg(F.min(F.struct((-F.col("gain")).alias("gain"), "p", "b", (~F.col("unset_left")).alias("o"), chosen.alias("s")))["s"].alias("s"))
            grown = best.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("_node").alias("key"), F.col("s").alias("value")))).alias("more"))
            put = F.when(F.col("more").isNull(), F.col("splits")).when(F.col("splits").isNull(), F.col("more")).otherwise(F.map_concat("splits", "more"))
            tree = tree.alias("t").join(grown.alias("m"), stats._same(keys, "t", "m") or F.lit(True), "left").select(*(f"t.{k}" for k in keys), "weight", put.alias("splits"), F.col("more").isNotNull().alias("_grew"))
            tree = written(tree)
            if tree.where("_grew").isEmpty():
                break
        trees.append(tree.select(*keys, "weight", "splits", F.lit(t).alias("round")))
        if t + 1 < rounds:
            with_tree = now.alias("d").join(tree.alias("t"), stats._same(keys, "d", "t") or F.lit(True)).select("d.*", "weight", "splits").withColumn("_node", _walk("splits", max_depth, by_bin("splits")))
            now = written(with_tree.withColumn("_pred", F.col("_pred") + _weight("splits", F.col("_node"), "weight")).select(*keys, "_bin", "_mean", "_n", "_pred"))
    # Bins become thresholds, so that rows are placed by their values.
    whole = reduce(DataFrame.unionByName, trees) if trees else base.select(*keys, F.lit(0.0).alias("weight"), F.lit(None).cast("map<int,struct<param:int,bin:int,unset_left:boolean,left:double,right:double>>").alias("splits"), F.lit(0).alias("round")).limit(0)
    whole = whole.alias("t").join(edges.alias("e"), stats._same(keys, "t", "e") or F.lit(True), "left").select("t.*", "_edges")
    real = F.transform_values("splits", lambda _, s: F.struct(s["param"].alias("param"), F.when(s["bin"] > 0, F.get(F.element_at(F.col("_edges"), s["param"]), s["bin"] - 1)).otherwise(F.lit(float("-inf"))).alias("threshold"), s["unset_left"].alias("unset_left"), s["left"].alias("left"), s["right"].alias("right")))
    out = written(whole.select(*keys, "round", "weight", F.coalesce(real, F.map_from_arrays(F.array().cast("array<int>"), F.array().cast(f"array<{_SPLIT}>"))).alias("splits")))
    return Boosted(base, out, tuple(keys), tuple(params), max_depth)


def predict(rows: DataFrame, model: Boosted) -> DataFrame:
    """``rows`` with ``predicted``: their key's mean and the weights of their leaves; null for unknown keys.

    Each different vector of parameters meets each tree of its key once, as one row, and rows take its sum.
    """
    keys = list(model.keys)
    x = F.array(*(numeric(p) for p in model.params)).cast("array<double>")
    asked = rows.select(*keys, x.alias("_x")).distinct()
    met = asked.alias("d").join(model.trees.alias("t"), stats._same(keys, "d", "t") or F.lit(True)).select("d.*", "weight", "splits")

    def left_of(s):
        v = F.get("_x", s["param"])
        return F.when(v.isNull(), s["unset_left"]).otherwise(v < s["threshold"])

    met = met.withColumn("_node", _walk("splits", model.depth, left_of))
    sums = met.groupBy(*keys, "_x").agg(F.sum(_weight("splits", F.col("_node"), "weight")).alias("_s"))
    known = asked.alias("d").join(model.base.alias("b"), stats._same(keys, "d", "b") or F.lit(True)).select("d.*", F.col("b.value").alias("_base"))
    done = known.alias("d").join(sums.alias("s"), stats._same([*keys, "_x"], "d", "s"), "left").select("d.*", (F.col("_base") + F.coalesce("_s", F.lit(0.0))).alias("predicted"))
    return rows.withColumn("_x", x).alias("d").join(done.alias("p"), stats._same([*keys, "_x"], "d", "p"), "left").select("d.*", "predicted").drop("_x")
