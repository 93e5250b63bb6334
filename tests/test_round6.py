"""Findings of round 4: each test failed before."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.operators import assess, drift, modelstore, scan, stats


def test_many_cut_keys_hold_few_edges(spark, monkeypatch):
    """every cut key broadcast the 2,047 edges of its sketch, however few blocks it had."""
    df = spark.range(2000).select((F.col("id") % 200).alias("k"), F.floor(F.col("id") / 200).alias("o"))
    seen, settle = [], scan.cut
    monkeypatch.setattr(scan, "cut", lambda t: seen.append(settle(t)) or seen[-1])
    cut_up = scan.Scan.of(df, ["k"], "o", block=4)
    edges = [t.agg(F.sum(F.size("_e"))).first()[0] for t in seen if "_e" in t.columns]
    assert edges == [2 * 200]
    sizes = {r["count"] for r in cut_up.df.groupBy("k", "_b").count().collect()}
    assert cut_up.blocked and sizes <= {3, 4}
    # More edges meet the rows by a shuffle, with the same blocks.
    monkeypatch.setattr(scan, "EDGES", 0)
    apart = scan.Scan.of(df, ["k"], "o", block=4).df
    assert apart.exceptAll(cut_up.df).isEmpty() and apart.count() == 2000


def test_short_blocks_share_a_call(spark):
    """each block was a call of its own, which cost more than its path."""
    rows = [(k, e, x / 1e4) for k in range(40) for e, x in enumerate((k % 7 - 3, 2, k % 5 - 1, 4, 1, k % 3))]
    df = spark.createDataFrame([*rows, (None, 0, None), (None, 1, float("nan")), (None, 2, 3e-4), (2**60 + 1, None, 1e-4), (2**60 + 1, 5, 1e-4)], "signal long, event long, drift double")
    whole, parts = drift.compensate(df), drift.compensate(df, block=2)
    for found in (whole, parts):
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    was = [{(r["signal"], r["event"]): (r["drift"], r["taken"]) for r in found.collect()} for found in (whole, parts)]
    assert was[0].keys() == was[1].keys() and len(was[0]) == 244
    assert [was[0][None, e] for e in range(3)] == [(0.0, False), (0.0, False), (0.0, False)] and was[0][2**60 + 1, 5] == (1e-4, True)
    for k in range(40):
        cost = []
        for found in was:
            now, total = 0.0, 0.0
            for e in range(6):
                d, taken = found[k, e]
                now, total = d, total + (abs(d - now) if taken else drift.SKIP)
            cost.append(total)
        assert cost[0] == pytest.approx(cost[1], abs=1e-12)


def test_medians_and_deviations_come_from_bins(spark):
    """all values were counted and shuffled, though a median needs those near it."""
    rng = np.random.default_rng(7)
    groups = {("n", "a", None): rng.normal(0, 5, 801), ("n", "a", "x"): rng.lognormal(0, 3, 400), ("n", "b", "x"): 1e9 + rng.integers(0, 3, 60) / 8, ("m", "a", "y"): np.array([-1.0, 0.0, 2.0, np.inf]), ("m", "a", "z"): np.array([-0.5, 0.25]), ("l", "a", "z"): np.array([-np.inf, -2.0, 3.0])}
    rows = [(*k, float(v)) for k, vs in groups.items() for v in vs] + [("n", "a", "x", None), ("o", "a", "x", None)]
    df = spark.createDataFrame(rows, "name string, attr string, p string, value double")
    static, lut = stats.middles(df, ["name", "attr"], ["p"])
    found = {(r["name"], r["attr"], r["p"]): r for r in lut.collect()}
    assert found.keys() == {*groups, ("o", "a", "x")} and found["o", "a", "x"]["lut"] is None and found["n", "a", "x"]["n"] == 401
    for k, vs in groups.items():
        assert found[k]["lut"] == np.median(vs) and found[k]["dev"] == pytest.approx(np.abs(vs - np.median(vs)).sum(), rel=1e-9)
    for r in static.collect():
        vs = [v for k, v in groups.items() if k[:2] == (r["name"], r["attr"])]
        assert r["static"] == (np.median(np.concatenate(vs)) if vs else None)
    few = df.where("name = 'n'")
    one, all_ = ({(r["name"], r["attr"]): r for r in assess.quality_table(few, ["p"], wanted=w).collect()} for w in (("mae",), ("mae", "smape")))
    want = {(r["name"], r["attr"]): r["mae"] for r in assess.metrics(assess.predict_lut(few, ["p"]), ["name", "attr"], wanted=("mae",)).collect()}
    for k in want:
        assert one[k]["lut_mae"] == pytest.approx(want[k]) and all_[k]["lut_mae"] == pytest.approx(want[k]) and one[k]["static_mae"] == pytest.approx(all_[k]["static_mae"])


def test_rows_far_from_a_middle_are_not_shuffled(spark, monkeypatch):
    """of values that all differ, few are counted one by one."""
    df = spark.range(20_000).select(F.lit("n").alias("name"), F.lit("a").alias("attr"), (F.col("id") % 4).alias("p"), (F.col("id") + 1000.5).alias("value"))
    sizes, settle = [], stats.written
    monkeypatch.setattr(stats, "written", lambda t: sizes.append((out := settle(t)).count()) or out)
    static, _ = stats.middles(df, ["name", "attr"], ["p"])
    assert static.first()["static"] == 11_000.0 and max(sizes) < 2500


def test_errors_of_all_models_are_one_pass(spark, tmp_path, monkeypatch):
    """each model's errors read the rows again, and ensembles all of their members' too; of a key without tree, other models' count."""
    rows = [("a", "x", i % 3, float(i % 3 * 10 + i % 5)) for i in range(90)] + [("b", "x", 0, 4.0), ("b", "x", 1, 6.0)]
    df = spark.createDataFrame(rows, "name string, attr string, p int, value double")
    more = df.unionByName(spark.createDataFrame([("a", "x", 7, 3.0), ("c", "x", 0, 1.0)], df.schema))
    made = modelstore.learn(df, ["p"], ensembles={"both": {"lut": 1.0, "tree": 3.0}, "all": {"both": 1.0, "static": 1.0}}, relevant=False, threshold=0.0)
    calls, predict = [], modelstore.predict
    monkeypatch.setattr(modelstore, "predict", lambda rows, models, n, *a: calls.append(n) or predict(rows, models, n, *a))
    found = {(r["name"], r["model"]): r for r in modelstore.errors(made, more, ("count", "mae", "rmsd")).collect()}
    assert sorted(calls) == ["lut", "static", "tree"]
    want = {}
    for n in made.names:
        for r in assess.metrics(predict(more, made, n), made.keys, wanted=("count", "mae", "rmsd")).collect():
            want[r["name"], n] = r
    assert found.keys() == want.keys() and len(found) == 10
    for k, r in want.items():
        assert (found[k]["count"], found[k]["mae"], found[k]["rmsd"]) == (r["count"], pytest.approx(r["mae"]), pytest.approx(r["rmsd"]))
