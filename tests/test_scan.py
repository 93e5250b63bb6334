"""Segmented scans: one long signal over many blocks gives what plain windows give."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugework.operators import behaviour, scan, signals


@pytest.fixture(scope="module")
def long_signal(spark):
    rng = random.Random(3)
    rows = [("hot", i, rng.choice([0.0, 1.0, 60.0, 90.0, None])) for i in range(900)] + [(f"s{i % 7}", i, float(i % 13)) for i in range(60)] + [(None, i, 5.0) for i in range(20)]
    return spark.createDataFrame(rows, "signal string, i long, value double").cache()


def same(a, b):
    assert a.columns == b.columns
    key = lambda r: tuple((x is None, repr(x)) for x in r)
    show = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=key)
    left, right = show(a), show(b)
    assert left == right and left


def test_blocks_of_a_long_key(long_signal):
    s = scan.Scan.of(long_signal, ["signal"], "i", block=110)
    sizes = {(r["signal"], r["_b"]): r["count"] for r in s.df.groupBy("signal", "_b").count().collect()}
    hot = [n for (k, _), n in sizes.items() if k == "hot"]
    assert s.blocked and len(hot) == 9 and max(hot) < 200 and sum(sizes.values()) == long_signal.count()
    assert not scan.Scan.of(long_signal, ["signal"], "i", block=900).blocked


def test_same_as_windows(long_signal):
    w = Window.partitionBy("signal").orderBy("i")
    upto, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, 6)
    odd = F.when(F.col("value") > 50, F.col("i"))
    got = scan.Scan.of(long_signal, ["signal"], "i", block=110).shifted(1, was="value").shifted(-1, next="value").summed(total="value").known(last=odd).numbered("n").ahead(7, mean=F.avg("value"), held=F.count("value")).rows()
    want = long_signal.withColumns({"was": F.lag("value").over(w), "next": F.lead("value").over(w), "total": F.sum("value").over(upto), "last": F.last(odd, ignorenulls=True).over(upto), "n": F.count(F.lit(1)).over(upto), "mean": F.avg("value").over(ahead), "held": F.count("value").over(ahead)})
    same(got.select(want.columns), want)


def test_ahead_over_short_blocks(long_signal, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 50)
    w = Window.partitionBy("signal").orderBy("i").rowsBetween(0, 59)
    got = scan.Scan.of(long_signal, ["signal"], "i").ahead(60, mean=F.avg("value")).rows()
    same(got, long_signal.withColumn("mean", F.avg("value").over(w)))


def test_operators_over_blocks(long_signal, monkeypatch):
    """126, 127, 128, 132, 134: the same rows, whether a signal is one block or many."""
    full = long_signal.na.fill(7.0)
    made = lambda: [
        signals.running_mean(full, 10), signals.threshold_points(full, 20), signals.edges(full, F.col("value") > 50, after=3),
        signals.segment_table(signals.segments(full, F.col("value") > 50), 90.0), signals.islands(full, F.col("value") > 50), signals.sync_pulses(full, 50, 1, 9, wanted=12),
    ]
    want = [df.collect() for df in made()]
    monkeypatch.setattr(scan, "BLOCK", 75)
    key = lambda r: tuple((x is None, repr(x)) for x in r)
    for a, b in zip(made(), want, strict=True):
        assert sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b), key=key)


def test_runs_over_blocks(spark, monkeypatch):
    """153, 162, 170: a run of many calls."""
    rng = random.Random(4)
    rows = [("big", i, rng.choice("abc"), rng.choice([None, "k1", "k2"]), rng.choice([None, str(i)]), rng.choice(["state", "transition"])) for i in range(400)] + [(f"r{i % 5}", i, rng.choice("ab"), None, None, "state") for i in range(40)]
    calls = spark.createDataFrame(rows, "run string, seq long, site string, kernel string, returned string, isa string")
    trace = calls.withColumns({"trace_id": F.col("run"), "name": F.col("site"), "dwell": F.lit(2.0), "p": F.col("returned").cast("double")})
    power = trace.select("name", "p").distinct().withColumns({"power": F.lit(3.0) + F.coalesce("p", F.lit(0.0)), "mae": F.lit(0.5)})
    energy = power.withColumnRenamed("power", "energy")
    made = lambda: [
        behaviour.learn_edges(calls.drop("kernel")), behaviour.learn_edges(calls, kernel="kernel"), behaviour.price_traces(trace, power, energy, ["p"]),
        behaviour.propagate_returns(trace, "q"), behaviour.propagate_returns(trace, "p", back_to="a"),
    ]
    key = lambda r: tuple((x is None, repr(x)) for x in r)
    show = lambda df: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=key)
    want = [show(df) for df in made()]
    monkeypatch.setattr(scan, "BLOCK", 60)
    assert [show(df) for df in made()] == want
