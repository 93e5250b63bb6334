"""Drift paths of whole runs and of runs cut in blocks, against a programme over all pairs of candidates."""

import numpy as np

from gaugework.operators import drift


def least(candidates, skip):
    """The least cost: every candidate is reached from the start or from any candidate of an earlier event."""
    flat = [(i, x) for i, xs in enumerate(candidates) for x in xs]
    where, at = np.array([i for i, _ in flat], int), np.array([x for _, x in flat], float)
    cost = np.abs(at) + skip * where
    for k in range(len(flat)):
        before = where < where[k]
        if before.any():
            cost[k] = min(cost[k], (cost[before] + np.abs(at[before] - at[k]) + skip * (where[k] - where[before] - 1)).min())
    n = len(candidates)
    return min([skip * n, *(cost + skip * (n - 1 - where))])


def price(found, skip):
    now, total = 0.0, 0.0
    for x in found:
        total += skip if x is None else abs(x - now)
        now = now if x is None else x
    return total


def runs(rng, n):
    return [sorted(rng.normal(0, 5e-4, rng.integers(0, 4)).tolist()) for _ in range(n)]


def test_path_is_least():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 60, 400):
        c = runs(rng, n)
        for skip in (0.0, 1e-5, drift.SKIP, 1e-2):
            found = drift.path(c, skip)
            assert all(x is None or x in xs for x, xs in zip(found, c, strict=True))
            assert np.isclose(price(found, skip), least(c, skip), rtol=0, atol=1e-9), (n, skip)


def test_blocks_compose():
    """Any cut of a run gives a path of the same cost as the run in one piece."""
    rng = np.random.default_rng(4)
    for trial in range(12):
        c = runs(rng, 300) if trial else [[]] * 40 + runs(rng, 40)
        edges = [0, *sorted(rng.choice(np.arange(1, len(c)), 6, replace=False).tolist()), len(c)]
        parts = [c[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        at = drift.borders([(len(p), *drift.block_matrix(p)) for p in parts])
        found = [x for p, a, b in zip(parts, at, at[1:], strict=False) for x in drift.path(p, drift.SKIP, a, b)]
        assert np.isclose(price(found, drift.SKIP), price(drift.path(c), drift.SKIP), rtol=0, atol=1e-9)


def test_matrix_is_small():
    """Its size goes with the range of drifts over the price of a skip, not with the events."""
    rng = np.random.default_rng(5)
    sizes = [len(drift.block_matrix(runs(rng, n))[0]) for n in (200, 4000)]
    assert sizes[1] <= max(60, 2 * sizes[0])


def test_long_run_over_many_tasks(spark):
    """A run of 10,000 events in 20 blocks, beside a short one, one of a null key, and events without candidates."""
    rng = np.random.default_rng(6)
    long, short = runs(rng, 10_000), runs(rng, 30)
    rows = [(k, i, x) for k, c in ((1, long), (2, short), (None, [[1e-4], [], [1.5e-4]])) for i, xs in enumerate(c) for x in (xs or [None])]
    df = spark.createDataFrame(rows, "signal long, event long, drift double")
    got = drift.compensate(df, block=1000)
    by = {}
    for r in got.collect():
        by.setdefault(r.signal, []).append((r.event, r.drift, r.taken))
    for k, c in ((1, long), (2, short)):
        found = sorted(by[k])
        assert [e for e, _, _ in found] == list(range(len(c)))
        taken = [d if t else None for _, d, t in found]
        assert np.isclose(price(taken, drift.SKIP), price(drift.path(c), drift.SKIP), rtol=0, atol=1e-8)
        now = 0.0
        for _, d, t in found:
            assert t or d == now
            now = d
    assert sorted(by[None]) == [(0, 1e-4, True), (1, 1e-4, False), (2, 1.5e-4, True)]
    none = drift.compensate(spark.createDataFrame([], "signal long, event long, drift double"))
    assert none.columns == ["signal", "event", "drift", "taken"] and none.isEmpty()
