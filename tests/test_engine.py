"""Synthetic cases with known outcome, invariants, and file formats."""

import json
import lzma
import struct
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.observations import Observations, from_maps
from gaugework.operators import assess, behaviour, drift, fit, lookup, shape, signals, stats, trees
from gaugework.sources import exports, logs
from gaugework.sources import signals as files


@pytest.fixture(scope="module")
def linear(spark):
    """y = x + noise depends on x and not on x modulo 5."""
    rng = np.random.default_rng(1312)
    rows = [(i, "TX", (i % 50) % 5, i % 50, float(i % 50 + rng.normal())) for i in range(400)]
    df = spark.createDataFrame(rows, "obs_id long, name string, p_mod5 int, p_linear int, power double")
    return Observations(df, ("p_mod5", "p_linear"), ("power",))


def test_relevance_and_best_template(linear):
    dev = {r.param: r for r in stats.relevance(stats.deviations(linear.long(), linear.params)).collect()}
    assert dev["p_linear"].depends and not dev["p_mod5"].depends
    assert dev["p_linear"].std_lut <= dev["p_linear"].std_static
    best = fit.select_template(fit.fit_slices(linear.long(), "p_linear", [])).first()
    assert best.template == "linear" and best.useful
    s = fit.fit_slices(linear.long(), "p_linear", [], templates=["linear"]).first()
    assert abs(s.b1 - 1) < 0.02 and abs(s.b0) < 0.5


def test_deviations_against_numpy(linear):
    pdf = linear.df.toPandas()
    dev = {r.param: r for r in stats.deviations(linear.long(), linear.params).collect()}
    assert np.isclose(dev["p_linear"].std_static, pdf.power.std(ddof=0))
    assert np.isclose(dev["p_linear"].std_lut, pdf.groupby(["p_mod5", "p_linear"]).power.std(ddof=0).mean())
    assert np.isclose(dev["p_linear"].std_by_param, pdf.groupby("p_mod5").power.std(ddof=0).mean())


def test_joint_fit_recovers_coefficients(spark):
    rng = np.random.default_rng(1312)
    rows = [("k", a, b, c, float(42 + 7 * a + 10 * np.log(b) - 0.5 * c * c + rng.normal())) for a in range(1, 11) for b in range(1, 11) for c in range(1, 11) for _ in range(4)]
    df = spark.createDataFrame(rows, "name string, a int, b int, c int, value double").withColumn("attr", F.lit("y"))
    terms = fit.powerset({"a": "linear", "b": "logarithmic", "c": "square"}, independent=True)
    assert np.allclose(fit.joint_fit(df, terms).first().beta, [42, 7, 10, -0.5], atol=0.3)
    product = fit.powerset({"a": "linear", "b": "logarithmic", "c": "square"})
    predicted = fit.predict_joint(df, fit.joint_fit(df, product), product)
    assert assess.metrics(predicted, ["name"]).first().mae < 0.85
    beta = fit.fit_formula(df, "regression_arg(0) + regression_arg(1) * parameter(a) + regression_arg(2) * log(parameter(b)) + regression_arg(3) * parameter(c) ** 2")
    assert np.allclose(beta, [42, 7, 10, -0.5], atol=0.3)
    with pytest.raises(ValueError):
        fit.formula("__import__('os').getcwd()", lambda i: F.lit(1.0))


def test_roofline_and_robust(spark):
    df = spark.createDataFrame([("k", "y", float(x), 3.0 + 2 * min(x, 12)) for x in range(1, 31)], "name string, attr string, x double, value double")
    r = fit.roofline(df).first()
    assert (round(r.b2), round(r.b1, 6), round(r.b0, 6)) == (12, 2.0, 3.0)
    far = df.select("name", "x", (2 * F.col("x") + F.when(F.col("x") == 7, 500).otherwise(0)).alias("value"))
    assert abs(fit.robust_line(far, ["name"], steps=40).first().b1 - 2) < 0.2


@pytest.mark.parametrize(
    ("y", "ordered", "want"),
    [
        ([1, 2, 3, 4, 5, 6], False, [((("p1", "==", 1.0), ("p2", "==", 1.0)), 1), ((("p1", "==", 1.0), ("p2", "==", 2.0)), 2), ((("p1", "==", 1.0), ("p2", "==", 3.0)), 3), ((("p1", "==", 2.0), ("p2", "==", 1.0)), 4), ((("p1", "==", 2.0), ("p2", "==", 2.0)), 5), ((("p1", "==", 2.0), ("p2", "==", 3.0)), 6)]),
        ([1, 2, 2, 4, 5, 5], False, [((("p1", "==", 1.0), ("p2", "==", 1.0)), 1), ((("p1", "==", 1.0), ("p2", "in", (2.0, 3.0))), 2), ((("p1", "==", 2.0), ("p2", "==", 1.0)), 4), ((("p1", "==", 2.0), ("p2", "in", (2.0, 3.0))), 5)]),
        ([1, 2, 2, 4, 5, 5], True, [((("p1", "<=", 1.0), ("p2", "<=", 1.0)), 1), ((("p1", "<=", 1.0), ("p2", ">", 1.0)), 2), ((("p1", ">", 1.0), ("p2", "<=", 1.0)), 4), ((("p1", ">", 1.0), ("p2", ">", 1.0)), 5)]),
    ],
)
def test_tree_paths(spark, y, ordered, want):
    df = spark.createDataFrame([(1 + i // 3, 1 + i % 3, float(v)) for i, v in enumerate(y)], "p1 int, p2 int, value double")
    tree = trees.prune(trees.grow(df, ["p1", "p2"], relevant=False), ordered)
    assert trees.flatten(tree) == [(p, pytest.approx(v)) for p, v in want]
    assert assess.metrics(df.withColumn("predicted", trees.compiled(tree)).withColumn("k", F.lit(1)), ["k"]).first().mae < 1e-9
    assert trees.from_json(json.loads(json.dumps(trees.to_json(tree)))) == tree
    assert df.withColumn("predicted", F.expr(trees.expression(tree))).where(F.abs(F.col("predicted") - F.col("value")) > 1e-9).isEmpty()


def test_unseen_values(spark):
    node = trees.Node(5.0, 4, "p", ((("1",), trees.Node(10.0, 1)), (("3",), trees.Node(30.0, 3))))
    got = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,), (5.0,)], "x double").select(F.col("x").cast("int").alias("p")).withColumn("y", trees.compiled(node)).collect()
    assert [r.y for r in got] == [0.0, 10.0, 20.0, 30.0, 50.0]
    enum = trees.Node(5.0, 4, "p", ((("a",), trees.Node(10.0, 1)), (("b",), trees.Node(30.0, 3))))
    df = spark.createDataFrame([("c",)], "p string")
    assert df.select(trees.compiled(enum)).first()[0] == 20.0 and df.select(trees.compiled(enum, weighted=True)).first()[0] == 25.0


def test_function_leaves_and_linear_tree(spark):
    rows = [(m, x, float(5 * x if m == "a" else 100 - 3 * x)) for m in "ab" for x in range(40)]
    df = spark.createDataFrame(rows, "m string, x int, value double").withColumn("k", F.lit(1))
    tree = trees.grow(df, ["m", "x"], with_functions=True, relevant=False)
    assert assess.metrics(df.withColumn("predicted", trees.compiled(tree)), ["k"]).first().mae < 1e-6
    flat = trees.grow(df.where("m = 'a'"), ["m", "x"], relevant=False, ignore_scalar=True, threshold=0.1)
    assert trees.complexity(flat)["leaves"] == 1
    bent = spark.createDataFrame([(x, float(abs(x - 50) * 2)) for x in range(100)], "x int, value double").withColumn("k", F.lit(1))
    lmt = trees.linear_tree(bent, ["x"], max_depth=3, bins=40)
    assert assess.metrics(bent.withColumn("predicted", trees.compiled(lmt)), ["k"]).first().mae < 2 and trees.complexity(lmt)["leaves"] >= 2


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([("z", 0.0, 0.0), ("z", 2.0, 1.0), ("c", 3.0, 3.0), ("c", 3.0, 3.0)], "k string, value double, predicted double")
    m = {r.k: r for r in assess.metrics(df, ["k"]).collect()}
    assert m["z"].mape is None and abs(m["z"].smape - 100 / 3) < 1e-9 and m["c"].rsq == 1.0


def test_folds_cover_all_rows(linear):
    k = 7
    folds = assess.k_folds(linear.df, k)
    assert folds.count() == 400 and [r["count"] for r in folds.groupBy("fold").count().orderBy("fold").collect()] == [58, 57, 57, 57, 57, 57, 57]
    conf = assess.config_folds(linear.df, ["p_linear"], k)
    assert conf.groupBy("p_linear").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty() and conf.count() == 400
    assert assess.config_folds(linear.df.withColumn("one", F.lit(1)), ["one"], 5).groupBy("fold").count().count() == 5


def test_unset_parameters(spark):
    df = spark.createDataFrame([(1, "n", None, 1.0), (2, "n", "5", 3.0), (3, "n", "7", 5.0)], "obs_id int, name string, p string, y double")
    obs = Observations(df, ("p",), ("y",))
    count = lambda text: shape.filter_parameters(obs, text).df.count()
    assert [count("p != 5"), count("p < 6"), count("p ∈ 5"), count("p = 7; p > 6")] == [2, 1, 1, 1]
    lut = stats.lut_model(obs.long(), ["p"])
    assert lookup.lut_lookup(obs.long(), lut, ["p"]).where("predicted is null").isEmpty()
    q = spark.createDataFrame([("n", "y", None)], "name string, attr string, p string")
    assert lookup.wildcard_lookup(q, lut, ["p"]).first().predicted == 3.0
    assert {r.value for r in stats.distinct_values(df, ["p"]).collect()} == {None, "5", "7"}


def test_tests_of_samples(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 5)] + [("b", float(v)) for v in (2, 4, 6, 8, 10)], "g string, v double")
    t = assess.t_test(df, "g", "v").first()
    assert abs(t.t + 1.8974) < 1e-3 and abs(t.p - 0.0943) < 1e-3
    k = assess.ks_distance(df, F.col("g") == "a", "v").first()
    assert abs(k.distance - 0.6) < 1e-9 and k.n_a == k.n_b == 5 and 0 <= assess.ks_p_value(k.distance, 5, 5) <= 1


def test_change_points_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        v = np.concatenate([rng.normal(m, 1, 6) for m in rng.integers(0, 30, 4)])
        cost = lambda a, b: np.abs(v[a:b] - np.median(v[a:b])).sum()  # noqa: B023, E731
        best = {0: (-9.0, [])}
        for t in range(3, len(v) + 1):
            cand = [(best[s][0] + cost(s, t) + 9.0, best[s][1] + [s] * (s > 0)) for s in best if t - s >= 3]
            if cand:
                best[t] = min(cand)
        assert signals.change_points(v, 9.0, 3) == best[len(v)][1]
        assert signals.changes_by_penalty(v, [4.0, 9.0, 400.0], 3)[1:] == [best[len(v)][1], []]
        assert np.allclose(signals.costs_to(v, 17), [cost(a, 17) for a in range(17)])
        n = len(best[len(v)][1])
        assert signals.fixed_change_points(v, n, 3) == best[len(v)][1] or n == 0


def test_drift_path():
    assert drift.path([[0.001], [0.0011, 0.2], [], [0.0012]], skip=1e-3) == [0.001, 0.0011, None, 0.0012]
    assert drift.path([[1e-4, 5e-3], [1.1e-4], [9e-3], [1.2e-4]], skip=270e-6) == [1e-4, 1.1e-4, None, 1.2e-4]


def test_guards_predict_traces(spark):
    rows = [(r, s, site, r % 3) for r in range(12) for s, site in enumerate(["open", *["loop"] * (r % 3), "close"])]
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    calls = spark.createDataFrame(rows, "run long, seq int, site string, n long")
    edges = behaviour.learn_edges(calls)
    guards = behaviour.learn_guards(edges, ["n"])
    got = behaviour.predict_traces(calls.select("run", "n").distinct(), guards, ["n"], limit=8, cut=4)
    assert behaviour.trace_accuracy(got, calls).first().exact == 1.0 and behaviour.nondeterministic(edges, ["n"]).isEmpty()


def test_log_files(spark, tmp_path):
    text = "noise\nx [::] TX | p=1 q= | power=2.5 d=3\n[::] RX @ f.cc:3 | | power=1\n"
    (tmp_path / "a.log").write_text(text)
    with lzma.open(tmp_path / "b.xz", "wt") as f:
        f.write(text)
    for lines in (logs.read_lines(spark, str(tmp_path / "a.log")), logs.read_xz(spark, str(tmp_path))):
        rows = logs.parse_lines(lines).orderBy("line_no").collect()
        assert [(r.name, r.place, r.param, r.attr) for r in rows] == [("TX", None, {"p": "1", "q": None}, {"power": 2.5, "d": 3.0}), ("RX", "f.cc:3", {}, {"power": 1.0})]
    bad = spark.createDataFrame([("[::] a | oops | x=1",)], "value string")
    assert logs.parse_lines(bad, strict=False).first().bad is not None
    with pytest.raises(Exception, match="bad pair"):
        logs.parse_lines(bad).collect()
    back = logs.parse_lines(logs.to_lines(from_maps(logs.parse_lines(logs.read_lines(spark, str(tmp_path / "a.log"))), ("p", "q"), ("power", "d")).df, ("p", "q"), ("power", "d")))
    assert {r.name: r.attr for r in back.collect()} == {"TX": {"power": 2.5, "d": 3.0}, "RX": {"power": 1.0}}
    trace = spark.createDataFrame([("f", i, v) for i, v in enumerate(["[>>] b | m=1", "[::] a @ x | k=1 | v=1", "[--] b | m=1", "[::] c @ y | | v=2", "[<<] b | m=1"])], "file string, line_no int, value string")
    rows, marks = logs.parse_trace(trace)
    assert [r["offset"] for r in marks.orderBy("line_no").collect()] == [0, 1, 2] and rows.count() == 2 and logs.disagreeing_runs(marks).isEmpty()


def test_json_forms(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"name": "n", "param": {"a": "1"}, "attribute": {"y": 2}}]))
    assert logs.json_observations(spark, str(tmp_path / "l.json")).first().asDict() == {"name": "n", "param": {"a": "1"}, "attr": {"y": 2.0}}
    (tmp_path / "c.json").write_text(json.dumps({"param_names": ["a", "b"], "by_name": {"n": {"param": [["1", None], ["2", "x"]], "attributes": ["y"], "y": [5, 6]}}}))
    got = logs.json_aggregate(spark, str(tmp_path / "c.json")).orderBy("obs_id").collect()
    assert [(r.param, r.attr) for r in got] == [({"a": "1", "b": None}, {"y": 5.0}), ({"a": "2", "b": "x"}, {"y": 6.0})]


def test_binary_files(spark, tmp_path):
    (tmp_path / "a.mim").write_bytes(struct.pack("<3I", 16 * 7, 16 * 8 + 8, 16 * 9))
    w = files.decode_words(files.words_of(files.binary_files(spark, str(tmp_path), "*.mim"))).orderBy("i").collect()
    assert [(r.charge, r.trigger) for r in w] == [(7, 0), (8, 1), (9, 0)]
    head = b"<dlog><tint>0.5</tint><sense_curr>1</sense_curr><sense_volt>1</sense_volt></dlog>\n" + b"\0" * 8
    (tmp_path / "a.dlog").write_bytes(head + struct.pack(">6f", 1, 3, 2, 3, 2e7, 3))
    d = files.decode_analyzer(files.binary_files(spark, str(tmp_path), "*.dlog")).orderBy("i").collect()
    assert [(r.t, r.power) for r in d] == [(0.0, 3.0), (0.5, 6.0), (1.0, 0.0)]
    trace = {"traces": [{"id": 1, "trace": [{"name": "go", "isa": "transition", "parameter": {"p": "[3, 4]"}, "offline_aggregates": {"duration": [1.0, 2.0]}}]}]}
    (tmp_path / "ptalog.json").write_text(json.dumps(trace))
    with tarfile.open(tmp_path / "x.tar", "w") as t:
        t.add(tmp_path / "ptalog.json", "ptalog.json")
        t.add(tmp_path / "a.mim", "a.mim")
    (tmp_path / "bad.tar").write_bytes(b"nothing")
    m = files.archive_members(files.binary_files(spark, str(tmp_path), "*.tar"))
    assert {(r.member, r.version, r.valid) for r in m.collect()} == {("ptalog.json", 1, True), ("a.mim", 1, True), (None, None, False)}
    obs = files.timing_observations(files.archive_traces(m)).orderBy("repetition").collect()
    assert [(r.param["p"], r.duration) for r in obs] == [("3", 1.0), ("4", 2.0)]


def test_exports(spark, linear, tmp_path):
    exports.write_raw_csv(linear, str(tmp_path / "raw"))
    assert spark.read.option("header", True).csv(str(tmp_path / "raw")).count() == 400
    assert exports.aggregated(linear, "power", 2).count() == 400
    table, fields = logs.profile_table(spark.createDataFrame([("f", i, v) for i, v in enumerate(["runs: 5 avg: 2.5", "=== Operator-wise ===", "op, start, first, avg, %, cum, mem, times, name", "CONV, 0, 1.0, 2.0, 30%, 30%, 4, 1, n1", "=== Summary ===", "CONV, 0, 1.0, 2.0, 30%, 30%, 4, 1, n1"])], "file string, line_no int, value string"))
    assert table.count() == 1 and table.first().percent == 30.0 and fields.first().runs == 5.0


def test_registered_queries_have_matching_columns(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_streamed_lines_give_batch_moments(spark, tmp_path):
    from gaugework.streaming import logs as stream

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.log").write_text(f"[::] TX | p={i} | power={i}\nnoise\n[::] TX | p | power=1\n")
    q = stream.running_moments(stream.stream_observations(stream.stream_lines(spark, str(tmp_path / "in"), 1))).writeStream.outputMode("complete").format("memory").queryName("moments").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    row = spark.sql("SELECT * FROM moments").first()
    assert (row.n, row["mean"]) == (3, 1.0)


def test_changes_of_signals(spark):
    """145-147, 149: rows for each signal and penalty as of each signal alone; sub-states from numpy."""
    rng = np.random.default_rng(8)
    data = {k: np.concatenate([rng.normal(m, 1, 12) for m in rng.integers(0, 60, 3)]) for k in range(6)}
    df = spark.createDataFrame([("a", k, i, float(x)) for k, v in data.items() for i, x in enumerate(v)], "name string, signal int, i int, value double")
    found = signals.detect_changes(df, range(1, 89), ["name", "signal"], min_distance=3)
    got = {(r.signal, r.penalty): r.changes for r in found.collect()}
    assert got == {(k, float(p)): signals.change_points(v, p, 3) for k, v in data.items() for p in range(1, 89)}
    chosen = signals.plateau_penalty(found, ["name", "signal"])
    want = {}
    for k in data:
        runs, n = [], [len(got[k, float(p)]) for p in range(1, 89)]
        for i, x in enumerate(n):
            if i and n[i - 1] == x:
                runs[-1][1] += 1
            else:
                runs.append([i, 1])
        start, length = max(runs, key=lambda r: r[1])
        want[k] = float(1 + start + (length - 1) // 2)
    assert {r.signal: r.penalty for r in chosen.collect()} == want
    usual = max(set(c := [len(got[k, want[k]]) for k in data]), key=lambda x: (c.count(x), -x))
    subs = signals.substates(df, found.join(chosen.select("name", "signal", "penalty"), ["name", "signal", "penalty"]), keys=["signal"])
    rows = {(r.signal, r.substate): (r.mean, r.duration) for r in subs.collect()}
    for k, v in data.items():
        cuts = got[k, want[k]]
        if len(cuts) == usual:
            for j, part in enumerate(np.split(v, cuts)):
                assert abs(rows[k, j][0] - part.mean()) < 1e-9 and rows[k, j][1] == len(part)
    t = df.where("signal = 0").select("signal", F.col("i").cast("double").alias("t"), "value")
    events = spark.createDataFrame([(0, 1, 11.0), (0, 2, 25.0)], "signal int, event int, t double")
    votes = {(r.event, r.drift): r.votes for r in signals.drift_candidates(t, events, [1.0, 10.0, 40.0], 8.0).collect()}
    brute = {}
    for e, at in ((1, 11), (2, 25)):
        lo = max(0, at - 8)
        for p in (1.0, 10.0, 40.0):
            for c in signals.change_points(data[0][lo : at + 9], p):
                brute[e, float(lo + c - at)] = brute.get((e, float(lo + c - at)), 0) + 1
    assert votes == brute


def test_percentiles(spark):
    """Exact percentiles of few groups, with ties, nulls, null keys and single rows, as numpy has them."""
    rng = np.random.default_rng(5)
    rows = [("a", float(x)) for x in rng.normal(size=3001)] + [("b", float(x)) for x in rng.integers(0, 4, 500)] + [("c", 7.0), ("d", None), (None, 1.0), (None, 2.0)]
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: (r.n, r.q) for r in stats.percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", shares).collect()}
    for k in ("a", "b", "c", None):
        v = [x for g, x in rows if g == k]
        assert got[k][0] == len(v) and np.allclose(got[k][1], np.quantile(v, shares), rtol=1e-12)
    assert "d" not in got
    static = {r.name: (r.static, r.n) for r in stats.static_model(spark.createDataFrame([(k, "x", v) for k, v in rows], "name string, attr string, value double")).collect()}
    assert static["d"] == (None, 1) and static["b"][1] == 500


def test_tree_thresholds_and_information(spark):
    """97: explicit, the attribute's own, within configurations, none. 69, 96: parameters without information are left out."""
    assert trees.stop_at(1, "a", {"a": 2}, 3) == 1 and trees.stop_at(None, "a", {"a": 2}, 3) == 2 and trees.stop_at(None, "b", {"a": 2}, 3) == 3 and trees.stop_at(None, None, None, None) == 0
    rng = np.random.default_rng(11)
    rows = [("n", str(i % 2), str(rng.integers(0, 3)), 100.0 * (i % 2) + float(rng.normal())) for i in range(600)]
    df = spark.createDataFrame(rows, "name string, p string, q string, value double")
    even = df.union(df.withColumn("value", F.col("value") + 40)).union(df.withColumn("value", F.col("value") - 40))
    assert trees.complexity(trees.grow(even, ["p", "q"], relevant=False, max_std={"value": 40.0}, attr="value"))["nodes"] == 3
    assert trees.complexity(trees.grow(df, ["p", "q"], relevant=False))["nodes"] < trees.complexity(trees.grow(df, ["p", "q"], relevant=False, threshold=0.0))["nodes"] + 1
    assert trees.complexity(trees.grow(df, ["p", "q"], relevant=False, threshold=0.0))["nodes"] > 3
    assert trees.grow(df, ["p", "q"], attr="value", max_std={"value": 1000.0}).param is None
    assert trees.complexity(trees.grow(df, ["p", "q"], relevant="information", threshold=0.0))["nodes"] >= 3
    picked = {r.param: (r.information, r.selected) for r in stats.informative_parameters(df, ["p", "q"], "value").collect()}
    assert picked["p"][1] and abs(picked["p"][0] - np.log(2)) < 0.02 and not picked["q"][1]
    ratios = {r.param: r.dependence for r in stats.correlation_dependence(df, ["p", "q"], ["value"]).collect()}
    assert ratios["p"] > 0.99 and ratios["q"] < 0.2


def test_places_without_one_task(spark):
    """119, 140: repetitions and new numbers from ranges."""
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(300)], "obs_id long, name string")
    rows = assess.monte_carlo(df, 4).collect()
    for rep in range(4):
        for name in "ab":
            mine = [r for r in rows if r.rep == rep and r.name == name]
            assert len(mine) == 150 and sum(r.train for r in mine) == 100
    assert len({tuple(sorted(r.obs_id for r in rows if r.rep == k and r.train)) for k in range(4)}) == 4
    a, b = (spark.createDataFrame([(t, s) for t in ids for s in range(2)], "trace_id long, seq int") for ids in ((5, 2, 9), (2, 7)))
    assert {(r.orig_id, r.trace_id) for r in signals.concat_traces(a, b).collect()} == {(2, 1), (5, 2), (9, 3), (2, 4), (7, 5)}


def test_prediction_by_joins(spark):
    """110, 111: as the compiled column, with unseen values of every kind, merged children and cuts."""
    rng = np.random.default_rng(3)
    train = [(i, str(rng.integers(0, 4)), "xyz"[rng.integers(0, 3)], float(rng.normal())) for i in range(80)]
    df = spark.createDataFrame(train, "obs_id long, p string, q string, value double")
    seen = spark.createDataFrame([(100 + i, p, q, 0.0) for i, (p, q) in enumerate((p, q) for p in ("0", "1.5", "-3", "9", None, "w", "2") for q in ("x", "v", None))], "obs_id long, p string, q string, value double")
    whole = trees.grow(df, ["p", "q"], relevant=False, threshold=0.0)
    leaf, node = trees.Node, trees.Node
    cut = node(5.0, 4, "p", (("<=", leaf(1.0, 1)), (">", node(3.0, 3, "q", ((("x", "y"), leaf(2.0, 2)), (("z",), leaf(7.0, 1)))))), 1.0)
    for tree in (whole, cut, trees.prune(whole, True), leaf(4.0)):
        for weighted in (False, True):
            rows = df.union(seen)
            want = {r.obs_id: r.v for r in rows.select("obs_id", trees.compiled(tree, weighted).alias("v")).collect()}
            got = {r.obs_id: r.predicted for r in trees.predict(rows, tree, ["p", "q"], weighted=weighted).collect()}
            assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want), [(k, got[k], want[k]) for k in want if abs(got[k] - want[k]) >= 1e-9]
    lines = spark.createDataFrame([(i, "ab"[i % 2], float(i // 2), 3.0 * (i // 2) + (i % 2)) for i in range(40)], "obs_id long, p string, x double, value double")
    tree = trees.grow(lines, ["p", "x"], with_functions=True, relevant=False, threshold=0.0)
    assert all(abs(r.predicted - r.value) < 1e-6 for r in trees.predict(lines, tree, ["p", "x"]).collect())
