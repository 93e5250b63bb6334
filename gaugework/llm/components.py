"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.store import discard, join_frequent_apart, settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node on an edge; component is the smallest node reachable.

    Each step aggregates a minimum for each node (partial sums first) and joins it back. Nodes that are on more than a
    ten-thousandth of the edges get theirs by a broadcast of bounded size, so that no large neighbourhood meets in one
    task. Steps end when every edge points from a node of one edge to one that has no smaller neighbour: all components
    are stars then. Rows with a null end are ignored; self-loops and repeats do no harm. ``edges`` should be a settled
    table or a union of some, as it is read for the first step and for the list of nodes.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = pairs.select("u").union(pairs.select("v")).distinct()
    now = settle(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        n, loose = _shape(now)
        if not loose:
            break
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("_count"))
        met = join_frequent_apart(both, low, ["u"], 2 * n)
        large = settle(met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_count"))
        hang = join_frequent_apart(large, small, ["u"], n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = settle(hang.union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        discard(now, large)
        now = new
    return nodes.join(now, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))


def _shape(now: DataFrame) -> tuple[int, int]:
    """The number of edges (u, v), v < u, and of nodes that keep them from being stars: those with several smaller
    neighbours, or with smaller and larger ones."""
    ends = F.array(F.struct(F.col("u").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("k"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    met = now.select(F.explode(ends).alias("e")).select("e.*").groupBy("k").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    row = met.agg(F.coalesce(F.sum("up"), F.lit(0)).alias("n"), F.count_if(F.expr("up > 1 or up = 1 and down = 1")).alias("loose")).first()
    return row["n"], row["loose"]
