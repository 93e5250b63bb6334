"""Pruned change points against the plain programme."""

import time

import numpy as np
import pytest

from gaugework.operators import signals


def plain(values, penalties, least, jump):
    """The total of the best path at each penalty, by the whole programme."""
    n = len(values)
    ends = [*range(-(-least // jump) * jump, n - least + 1, jump), n]
    starts = [0, *ends[:-1]]
    out = []
    costs = {t: signals.costs_to(values, t) for t in ends}
    for pen in penalties:
        best = {0: -pen}
        for i, t in enumerate(ends):
            may = [s for s in starts[: i + 1] if s in best and (t - s >= least or s == 0)]
            best[t] = min(best[s] + costs[t][s] for s in may) + pen
        out.append(best[n])
    return out


def total(values, changes, pen):
    cuts = [0, *changes, len(values)]
    return sum(np.abs(values[a:b] - np.median(values[a:b])).sum() for a, b in zip(cuts, cuts[1:], strict=False)) + pen * len(changes)


def made(rng, n, kind):
    level = np.repeat(rng.normal(0, 10, n // 12 + 1), 12)[:n]
    return {"noise": rng.normal(size=n), "steps": level + rng.normal(size=n), "ties": np.round(level / 5) + rng.integers(0, 3, n), "flat": np.full(n, 3.0)}[kind]


@pytest.mark.parametrize("kind", ["noise", "steps", "ties", "flat"])
def test_deviations(kind):
    rng = np.random.default_rng(1)
    v = made(rng, 97, kind)
    d = signals.Deviations(v)
    for t in (1, 2, 50, 97):
        assert d.of(np.arange(t), t) == pytest.approx(signals.costs_to(v, t), abs=1e-8)


@pytest.mark.parametrize("kind", ["noise", "steps", "ties", "flat"])
@pytest.mark.parametrize(("least", "jump"), [(5, 1), (1, 1), (3, 2), (4, 7)])
def test_best_totals(kind, least, jump):
    rng = np.random.default_rng(least * 10 + jump)
    penalties = [0.3, 1, 2, 5, 20, 200]
    for n in (1, 2, 9, 10, 60, 131):
        v = made(rng, n, kind)
        for pen, found, want in zip(penalties, signals.changes_by_penalty(v, penalties, least, jump), plain(v, penalties, least, jump), strict=True):
            assert total(v, found, pen) == pytest.approx(want, abs=1e-6)
            assert all(c % jump == 0 for c in found) and all(b - a >= least for a, b in zip([0, *found], [*found, n], strict=False) if found)


def test_time_is_near_linear():
    rng = np.random.default_rng(2)
    took = []
    for n in (4_000, 16_000):
        v = np.repeat(rng.normal(0, 50, n // 40), 40) + rng.normal(size=n)
        began = time.process_time()
        found = signals.changes_by_penalty(v, [20.0])[0]
        took.append(time.process_time() - began)
        assert abs(len(found) - n // 40) < n // 200
    assert took[1] < 9 * took[0]


@pytest.mark.parametrize("kind", ["noise", "steps", "ties", "flat"])
@pytest.mark.parametrize(("least", "jump"), [(5, 1), (1, 1), (3, 2), (4, 7)])
def test_many_at_once_as_one_by_one(kind, least, jump):
    rng = np.random.default_rng(least * 10 + jump + 1)
    penalties = [0.3, 1, 2, 5, 20, 200]
    series = [made(rng, n, kind) for n in (60, 1, 2, 9, 10, 60, 0, 131, 7, 250, 33)]
    for v, runs in zip(series, signals.changes_of_many(series, penalties, least, jump), strict=True):
        assert [p for _, a, b in runs for p in range(a, b + 1)] == list(range(len(penalties)))
        want = signals.changes_by_penalty(v, penalties, least, jump) if len(v) else [[]] * len(penalties)
        for found, a, b in runs:
            for j in range(a, b + 1):
                assert total(v, found, penalties[j]) == pytest.approx(total(v, want[j], penalties[j]), abs=1e-6)
                assert all(c % jump == 0 for c in found) and all(y - x >= least for x, y in zip([0, *found], [*found, len(v)], strict=False) if found)


def test_short_signals_share_their_steps():
    """one by one, a short signal took as long as its calls of numpy."""
    rng = np.random.default_rng(3)
    series, penalties = [made(rng, n, "steps") for n in rng.integers(45, 100, 60)], [float(p) for p in range(1, 89)]
    began = time.process_time()
    alone = [signals.changes_by_penalty(v, penalties, 3) for v in series]
    middle = time.process_time()
    many = signals.changes_of_many(series, penalties, 3)
    assert time.process_time() - middle < (middle - began) / 3
    assert [[c for c, a, b in runs for _ in range(a, b + 1)] for runs in many] == alone


def test_totals_need_no_further_shuffle(spark):
    """a signal's samples were repeated for every penalty and shuffled."""
    rng = np.random.default_rng(4)
    rows = [(s, i, float(x)) for s, n in ((1, 40), (2, 2), (3, 75)) for i, x in enumerate(made(rng, n, "steps"))]
    df = spark.createDataFrame(rows, "signal long, i int, value double")
    found = signals.change_totals(signals.detect_runs(df, [1.0, 4.0, 30.0], min_distance=3))
    assert found._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1 and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["signal"], r["penalty"]): (r["total"], r["parts"]) for r in found.collect()}
    for s in (1, 2, 3):
        v = np.array([x for k, _, x in rows if k == s])
        for pen, c in zip([1.0, 4.0, 30.0], signals.changes_by_penalty(v, [1.0, 4.0, 30.0], 3), strict=True):
            assert got[s, pen] == (pytest.approx(total(v, c, pen)), len(c) + 1)
