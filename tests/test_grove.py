"""Keyed trees against trees grown one at a time."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.operators import grove, trees

PARAMS = ["colour", "level", "mode"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    out = []
    for name in ("a", "b", "c"):
        for attr in ("power", "time"):
            for _ in range(160):
                colour, level, mode = rng.choice(["red", "green", None] if name == "c" else ["red", "green"]), rng.choice([1, 2, 4, 8]), rng.choice(["x", "y", "z"])
                base = {"a": 5.0, "b": 10.0 + 3 * (mode == "x") * level, "c": 2.0 * level}[name]
                value = base + (4 if colour == "red" and mode != "y" else 0) + (level if attr == "time" and name != "a" else 0) + rng.gauss(0, 0.2)
                out.append((name, attr, colour, level, mode, value, rng.randrange(4)))
    return spark.createDataFrame(out, "name string, attr string, colour string, level int, mode string, value double, fold int").cache()


def single(rows, some=(("a", "time"), ("c", "power")), **options):
    return {(n, a): trees.grow(rows.where((F.col("name") == n) & (F.col("attr") == a)), PARAMS, attr=a, **options) for n, a in some}


def leaves_of(node):
    return sorted((tuple(sorted((p, tuple(sorted(map(str, v if isinstance(v, tuple) else (v,))))) for p, _, v in path)), round(value, 9)) for path, value in trees.flatten(node))


def show(v):
    try:
        return str(float(v))
    except ValueError:
        return "null" if v.startswith("\x00") else v


def grown_leaves(g):
    out = {}
    for r in grove.rules(g).collect():
        path = tuple(sorted((p, tuple(sorted(map(show, v)))) for p, v in r["path"]))
        out.setdefault((r["name"], r["attr"]), []).append((path, round(r["value"], 9)))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("options", [{}, {"relevant": False, "binary_only": True, "max_depth": 2, "max_std": {"time": 1.0}}, {"relevant": False, "ignore_scalar": True, "threshold": 1.0}, {"relevant": "information", "threshold": 0.1}])
def test_same_as_trees_one_at_a_time(rows, options):
    g = grove.grow(grove.moments(rows, PARAMS), PARAMS, **options)
    want = {k: leaves_of(t) for k, t in single(rows, **options).items()}
    got = grown_leaves(g)
    assert len(got) == 6 and {k: got[k] for k in want} == want


def test_prune_rules_and_complexity(rows):
    whole = rows.withColumn("value", F.round("value"))
    g = grove.prune(grove.grow(grove.moments(whole, PARAMS), PARAMS, relevant=False, threshold=0.5))
    want = {k: trees.prune(t) for k, t in single(whole, relevant=False, threshold=0.5).items()}
    found = grown_leaves(g)
    assert {k: found[k] for k in want} == {k: leaves_of(t) for k, t in want.items()}
    got = {(r["name"], r["attr"]): (r["leaves"], r["depth"]) for r in grove.complexity(g).collect()}
    assert {k: got[k] for k in want} == {k: (trees.complexity(t)["leaves"], trees.complexity(t)["depth"]) for k, t in want.items()}


@pytest.mark.parametrize("weighted", [False, True])
def test_predictions_of_seen_and_unseen_values(rows, spark, weighted):
    g = grove.grow(grove.moments(rows, PARAMS), PARAMS, relevant=False)
    asked = spark.createDataFrame([(n, a, c, l, m) for n in "abc" for a in ("power", "time") for c in ("red", "blue", None) for l in (0, 1, 3, 8, 20) for m in ("x", "q")] + [("zz", "power", "red", 1, "x")], "name string, attr string, colour string, level int, mode string")
    got = {tuple(r[:5]): r[5] for r in grove.predict(asked, g, weighted).collect()}
    assert len(got) == 180 and ("zz", "power", "red", 1, "x") not in got
    for (n, a), tree in single(rows, relevant=False).items():
        for r in trees.predict(asked.where((F.col("name") == n) & (F.col("attr") == a)), tree, PARAMS, weighted).collect():
            assert got[tuple(r[:5])] == pytest.approx(r[5], abs=1e-9)


def test_function_leaves(rows):
    config = grove.moments(rows, PARAMS)
    g = grove.with_functions(grove.grow(config, PARAMS, relevant=False, keep_scalar=True), rows, ["level"])
    got = {tuple(r[:6]): r["predicted"] for r in grove.predict(rows, g).collect()}
    for (n, a), tree in single(rows, relevant=False, with_functions=True).items():
        for r in trees.predict(rows.where((F.col("name") == n) & (F.col("attr") == a)), tree, PARAMS).collect():
            assert got[tuple(r[:6])] == pytest.approx(r["predicted"], abs=1e-6)


def test_folds_are_trained_by_complements(rows):
    keys = ("name", "attr", "fold")
    got = {tuple(r[:5]): r for r in grove.complements(grove.moments(rows, ["level", "mode"], keys), ["level", "mode"], ("name", "attr")).select("name", "attr", "fold", "level", "mode", "_n", "_mean", "_m2").collect()}
    data = rows.toPandas()
    for fold in range(4):
        for key, part in data[data.fold != fold].groupby(["name", "attr", "level", "mode"]):
            r = got.pop((key[0], key[1], fold, key[2], key[3]))
            assert r["_n"] == len(part) and r["_mean"] == pytest.approx(part.value.mean()) and r["_m2"] == pytest.approx(np.sum((part.value - part.value.mean()) ** 2), abs=1e-9)
    assert not got


def test_one_leaf_and_no_rows(rows, spark):
    one = grove.grow(grove.moments(rows.where("name = 'a'").withColumn("value", F.lit(3.0)), PARAMS), PARAMS)
    assert one.depth == 0 and {r["value"] for r in one.nodes.collect()} == {3.0}
    assert {r["predicted"] for r in grove.predict(rows, one).collect()} == {3.0}
    none = grove.grow(grove.moments(rows.where("false"), PARAMS), PARAMS)
    assert none.nodes.count() == 0 and grove.rules(grove.prune(none)).count() == 0
