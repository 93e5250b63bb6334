"""Guards of all sites and folds from one grove against guards of each fold by itself."""

from pyspark.sql import functions as F

from gaugework.operators import assess, behaviour


def test_fold_guards_are_those_of_the_other_folds(spark):
    rows = [(r, s, site, r % 4) for r in range(24) for s, site in enumerate(["open", *["loop"] * (r % 4), "close"])] + [(100, 0, "open", 9), (100, 1, "odd", 9)]
    calls = spark.createDataFrame(rows, "run long, seq int, site string, n long").cache()
    edges = behaviour.learn_edges(calls)
    runs = calls.select("run", "n").distinct()
    folds = assess.place_in_group(runs.withColumn("_all", F.lit(0)), ["_all"], "run").select("run", (F.col("place") % 3).cast("int").alias("fold")).cache()
    every = behaviour.learn_guards(behaviour.fold_edges(edges, folds, ["n"], 3), ["n"], ("fold",))
    got = {(r["fold"], r["source"]): r["rules"] for r in every.collect()}
    for fold in (0, 1, 2):
        others = edges.join(folds.where(F.col("fold") != fold), "run")
        own = {r["source"]: r["rules"] for r in behaviour.learn_guards(others, ["n"]).collect()}
        assert {s: rules for (f, s), rules in got.items() if f == fold} == own
    # 24 runs are told by the guards of the other folds; the odd run, whose sites no other has, is not.
    report = {r["part"]: r for r in behaviour.validated_accuracy(calls, ["n"], 3, limit=8, cut=8).collect()}
    assert report["training"]["runs"] == report["validation"]["runs"] == 25
    assert report["training"]["exact"] == 1.0 and report["validation"]["exact"] == 24 / 25


def test_unseen_numbers_follow_the_cut(spark):
    rows = [("s", "low", x) for x in (1, 2, 3)] + [("s", "high", x) for x in (7, 8)] + [("t", "only", 1)]
    edges = spark.createDataFrame(rows, "source string, target string, n long").withColumn("visit", F.lit(1))
    guards = behaviour.learn_guards(edges, ["n"])
    asked = spark.createDataFrame([("s", n, 1) for n in (-5, 3, 4, 9, None)] + [("t", 50, 1), ("u", 1, 1)], "site string, n long, visit int")
    got = {(r["site"], r["n"]): r["hits"] for r in behaviour.guarded(asked, guards, ["n"]).collect()}
    assert got == {("s", -5): ["low"], ("s", 3): ["low"], ("s", 4): ["high"], ("s", 9): ["high"], ("s", None): [], ("t", 50): ["only"], ("u", 1): []}
