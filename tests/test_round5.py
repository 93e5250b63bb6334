"""Work that once grew with folds, copies or few keys."""

import pytest
from pyspark.sql import functions as F

from gaugework.operators import assess, stats


def observed(spark, n=400):
    rows = [(i, "ab"[i % 3 == 0], i % 2, float(i % 5), float(i % 7), "y") for i in range(n)]
    return spark.createDataFrame(rows, "obs_id long, name string, p int, q double, value double, attr string")


def test_weighted_metrics_are_those_of_repeated_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 3), ("a", 4.0, 4.0, 1), ("a", 0.0, 0.0, 2), ("b", 1e9 + 0.1, 1e9, 4), ("b", None, 1.0, 5)], "k string, value double, predicted double, n int")
    rows = df.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    one = {r["k"]: r for r in assess.metrics(df, ["k"], weight="n").collect()}
    for r in assess.metrics(rows, ["k"]).collect():
        for m in assess.METRICS:
            assert one[r["k"]][m] == (r[m] if r[m] is None else pytest.approx(r[m], rel=1e-9)), m


def test_quality_table_reads_counts(spark):
    """errors come from the counts of values and not from the rows again."""
    df = observed(spark)
    table = assess.quality_table(df, ["p", "q"])
    assert "LogicalRDD" not in table._jdf.queryExecution().optimizedPlan().toString()
    want = {r["name"]: r for r in assess.metrics(assess.predict_lut(df, ["p", "q"]), ["name"], wanted=("mae", "smape", "rsq")).collect()}
    for r in table.collect():
        assert [r[f"lut_{m}"] for m in ("mae", "smape", "rsq")] == pytest.approx([want[r["name"]][m] for m in ("mae", "smape", "rsq")])


def test_config_folds_place_rows_of_few_configurations_only(spark, monkeypatch):
    """F16: all rows were ranked, for names of less configurations than folds alone."""
    calls, place = [], assess.place_in_group
    monkeypatch.setattr(assess, "place_in_group", lambda df, *a: calls.append(df.count()) or place(df, *a))
    df = observed(spark)
    assert assess.config_folds(df, ["p", "q"], 5).groupBy("name", "p", "q").agg(F.count_distinct("fold").alias("f")).where("f > 1").isEmpty() and not calls
    few = df.withColumns({"p": F.when(F.col("name") == "a", 0).otherwise(F.col("p")), "q": F.when(F.col("name") == "a", 0.0).otherwise(F.col("q"))})
    folds = assess.config_folds(few, ["p", "q"], 5)
    assert calls == [few.where("name = 'a'").count()] and folds.where("fold is null").isEmpty()
    assert folds.where("name = 'a'").select("fold").distinct().count() == 5


def test_box_statistics_read_rows_once(spark):
    """whiskers counted all rows again."""
    found = stats.box_statistics(observed(spark))
    assert "LogicalRDD" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["name"]: (r["n"], r["low"], r["median"], r["high"]) for r in found.collect()} == {"a": (266, 0.0, 3.0, 6.0), "b": (134, 0.0, 3.0, 6.0)}
