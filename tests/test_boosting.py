"""Regularised boosting against a plain replay of its rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.operators import boosting


def replay(x, y, rounds, depth, eta, gamma, alpha, lam, least):
    """Predictions of ``x`` (NaN: unset) by trees grown one node at a time over all values as thresholds."""
    base = y.mean()
    pred = np.full(len(y), base)

    def soft(g):
        return np.sign(g) * max(abs(g) - alpha, 0.0)

    def score(g, h):
        return soft(g) ** 2 / (h + lam)

    def grow(at, g, level, out):
        total, n = g[at].sum(), at.sum()
        best = (max(gamma, 1e-6), None)
        if level < depth:
            for p in range(x.shape[1]):
                col = x[:, p]
                unset = at & np.isnan(col)
                for t in np.unique(col[at & ~np.isnan(col)]):
                    for go_left in (True, False) if unset.any() else (True,):
                        left = at & np.where(np.isnan(col), go_left, col < t)
                        h = left.sum()
                        if h == 0 or h == n or h < least or n - h < least:
                            continue
                        gain = score(g[left].sum(), h) + score(total - g[left].sum(), n - h) - score(total, n)
                        if gain > best[0] + 1e-9:
                            best = (gain, left)
        if best[1] is None:
            out[at] += -eta * soft(total) / (n + lam)
        else:
            grow(best[1], g, level + 1, out)
            grow(at & ~best[1], g, level + 1, out)

    for _ in range(rounds):
        out = np.zeros(len(y))
        grow(np.ones(len(y), bool), pred - y, 0, out)
        pred = pred + out
    return pred


def frame(spark, seed=1, n=160):
    rng = np.random.default_rng(seed)
    rows = []
    for key in ("a", "b", None):
        for i in range(n):
            u, v = float(rng.integers(0, 9)), float(rng.integers(0, 6))
            y = 3 * u - u * v + rng.normal() + (40 if key == "b" else 0)
            rows.append((key, len(rows), None if i % 11 == 0 else u, None if i % 7 == 3 else str(int(v)), y))
    return spark.createDataFrame(rows, "name string, id long, u double, v string, value double"), rows


@pytest.mark.parametrize("rules", [{}, {"alpha": 3.0, "lam": 0.5, "min_child": 6.0, "gamma": 5.0}])
def test_as_replayed(spark, rules):
    df, rows = frame(spark)
    model = boosting.boost(df, ["u", "v"], ["name"], rounds=3, max_depth=3, **rules)
    got = {r.id: r.predicted for r in boosting.predict(df, model).collect()}
    for key in ("a", "b", None):
        mine = [r for r in rows if r[0] == key]
        x = np.array([[np.nan if r[2] is None else r[2], np.nan if r[3] is None else float(r[3])] for r in mine])
        want = replay(x, np.array([r[4] for r in mine]), 3, 3, 0.3, rules.get("gamma", 0.0), rules.get("alpha", 0.0), rules.get("lam", 1.0), rules.get("min_child", 1.0))
        assert np.allclose([got[r[1]] for r in mine], want, atol=1e-8), key


def test_bins_and_leaves(spark):
    """With fewer bins than values the thresholds are quantiles; rounds still lessen the error, and leaves add up to predictions."""
    rng = np.random.default_rng(2)
    rows = [("k", float(x), float(np.sin(x) * 10)) for x in rng.uniform(0, 6, 600)]
    df = spark.createDataFrame(rows, "name string, x double, value double")
    model = boosting.boost(df, ["x"], ["name"], rounds=6, max_depth=3, bins=16)
    errors = boosting.predict(df, model).agg(F.avg(F.abs(F.col("value") - F.col("predicted")))).first()[0]
    static = float(np.abs(np.array([r[2] for r in rows]) - np.mean([r[2] for r in rows])).mean())
    assert errors < 0.4 * static
    assert model.trees.count() == 6 and model.leaves().groupBy("round").count().agg(F.max("count")).first()[0] <= 8


def test_bare_keys(spark):
    """One row, equal rows, no parameter that differs, values that are null, unknown keys, no rows."""
    rows = [("one", 1.0, 5.0), ("same", 2.0, 3.0), ("same", 2.0, 7.0), ("void", 1.0, None), ("unset", None, 1.0), ("unset", None, 2.0)]
    df = spark.createDataFrame(rows, "name string, x double, value double")
    model = boosting.boost(df, ["x"], ["name"], rounds=2, max_depth=2)
    asked = spark.createDataFrame([("one", 1.0), ("same", 9.0), ("void", 1.0), ("unset", 3.0), ("new", 1.0)], "name string, x double")
    got = {r.name: r.predicted for r in boosting.predict(asked, model).collect()}
    assert got == {"one": 5.0, "same": 5.0, "void": None, "unset": 1.5, "new": None}
    none = boosting.boost(df.limit(0), ["x"], ["name"], rounds=1, max_depth=1)
    assert boosting.predict(asked, none).where("predicted is not null").isEmpty()
