"""Lines with bounds on both coefficients against all points of a fine grid of the box's sides and its inside."""

import itertools

import numpy as np
import pytest

from gaugework.operators import fit


@pytest.mark.parametrize("bounds", [((None, None), (None, None)), ((0.0, None), (None, 1.0)), ((-1.0, 1.0), (-0.5, 0.5)), ((3.0, 3.0), (None, None)), ((None, 0.5), (2.0, None))])
def test_bounded_lines(spark, bounds):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(6):
        x = rng.uniform(-3, 5, 40)
        rows += [(k, float(a), float(b)) for a, b in zip(x, rng.normal(0, 3) + rng.normal(0, 2) * x + rng.normal(size=40), strict=True)]
    rows += [(9, 2.0, 1.0), (9, 2.0, 3.0)]
    got = {r["k"]: (r["b0"], r["b1"]) for r in fit.robust_line(spark.createDataFrame(rows, "k int, x double, value double"), ["k"], loss="linear", bounds=bounds).collect()}
    for k in range(6):
        x, y = (np.array(c) for c in zip(*((a, b) for j, a, b in rows if j == k), strict=True))
        loss = lambda a, b: float(((y - a - b * x) ** 2).sum())  # noqa: B023, E731
        slope = np.cov(x, y)[0, 1] / np.var(x, ddof=1)
        sides = []
        for (lo, hi), free in zip(bounds, (y.mean() - slope * x.mean(), slope), strict=True):
            grid = np.linspace(free - 6 if lo is None else lo, free + 6 if hi is None else hi, 401)
            sides.append([*grid, *([free] if (lo is None or free >= lo) and (hi is None or free <= hi) else [])])
        best = min(loss(a, b) for a, b in itertools.product(*sides))
        a, b = got[k]
        assert all((lo is None or v >= lo) and (hi is None or v <= hi) for v, (lo, hi) in zip((a, b), bounds, strict=True))
        assert loss(a, b) <= best + 1e-6


def test_losses_hold_off_outliers(spark):
    rows = [("k", float(i), 2.0 * i + 1 + (500.0 if i == 17 else 0.0)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, x double, value double")
    slopes = {loss: fit.robust_line(df, ["k"], loss=loss, steps=12).first()["b1"] for loss in fit.LOSSES}
    assert all(abs(b - 2.0) < abs(slopes["linear"] - 2.0) / 3 for loss, b in slopes.items() if loss != "linear")
