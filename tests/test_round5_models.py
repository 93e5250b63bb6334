"""Few keys do not send all rows to few tasks; losses and rounds read counts."""

import pytest
from pyspark.sql import functions as F

from gaugework.operators import fit, grove, trees


def rows(spark):
    return spark.createDataFrame([("ab"[i % 3 == 0], "y", i % 2, float(i % 10), float(3 * (i % 10) + i % 4)) for i in range(300)], "name string, attr string, p int, q double, value double")


def test_losses_share_their_points(spark):
    """every step of every loss read the rows again."""
    df, losses = rows(spark), list(fit.LOSSES)
    together = {(r["name"], r["loss"]): (r["b0"], r["b1"]) for r in fit.robust_lines(df, ["name"], losses, "q", scale=2.0, steps=3).collect()}
    assert len(together) == 2 * len(losses)
    for loss in ("linear", "huber"):
        for r in fit.robust_line(df, ["name"], "q", scale=2.0, steps=3, loss=loss).collect():
            assert together[r["name"], loss] == pytest.approx((r["b0"], r["b1"]))


def test_rows_meet_models_where_they_are(spark):
    """rows of few names met their model in as many tasks."""
    df = rows(spark)
    terms = fit.powerset({"q": "linear"})
    plan = fit.predict_joint(df, fit.joint_fit(df, terms), terms)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    grown = grove.with_functions(grove.grow(grove.moments(df, ["p", "q"]), ["p", "q"], relevant=False, threshold=0.0, keep_scalar=True), df, ["q"])
    plan = grove.predict(df, grown)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_boosting_reads_weighted_configurations(spark):
    """every round read all rows; equal ones are one row of their mean and weight, with the same trees."""
    made = trees.features(rows(spark), ["p", "q"])
    few = trees.weighted(made, ["p", "q"])
    assert few.count() == 10 and few.agg(F.sum("weight")).first()[0] == 300
    a, b = (trees.library_tree("boosted", t, maxIter=3, **o).transform(few).orderBy("p", "q").collect() for t, o in ((made, {}), (few, {"weightCol": "weight"})))
    assert [r["prediction"] for r in a] == pytest.approx([r["prediction"] for r in b])
