"""Models on disk (inventory 22, 105): lookup tables, static values, keyed trees, ensembles and their errors.

A set of models is a folder in the shared store: a manifest (JSON) that says what the models are, and their tables as
Parquet, so that a model of any size is written and read by tasks. What is read back predicts what was written.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.operators import assess, grove, stats
from gaugework.operators.lineage import broadcast_if_small, written
from gaugework.operators.lookup import lut_lookup

FORMAT = 1


@dataclass(frozen=True)
class Models:
    """Static values, lookup table and trees for each key; ``ensembles`` are names of weighted sets of these and each other."""

    keys: tuple[str, ...]
    params: tuple[str, ...]
    static: DataFrame
    lut: DataFrame
    trees: grove.Grove | None = None
    ensembles: dict[str, dict[str, float]] = field(default_factory=dict)
    errors: DataFrame | None = None

    @property
    def names(self) -> list[str]:
        return ["static", "lut", *(["tree"] if self.trees is not None else []), *self.ensembles]


def learn(long: DataFrame, params, keys=("name", "attr"), ensembles=None, **options) -> Models:
    """All models of each key, and the errors of every one of them on what it was learned from. ``options`` are those of ``grove.grow``."""
    keys, params = tuple(keys), tuple(sorted(params))
    trees = grove.grow(grove.moments(long, params, keys), params, keys, **options)
    out = Models(keys, params, *(m.drop("dev") for m in stats.middles(long, keys, params)), trees, dict(ensembles or {}))
    return replace(out, errors=errors(out, long, configs=out.lut.select(*keys, *params)))


def predict(rows: DataFrame, models: Models, name: str = "lut", out: str = "predicted") -> DataFrame:
    """``rows`` with one model's prediction: of a configuration that a lookup table lacks, the static value; of an ensemble, the weighted mean of its members."""
    if name == "static":
        return rows.join(models.static.select(*models.keys, F.col("static").alias(out)), list(models.keys))
    if name == "lut":
        return lut_lookup(rows, models.lut, list(models.params), models.static, list(models.keys)).withColumnRenamed("predicted", out)
    if name == "tree" and models.trees is not None:
        return grove.predict(rows, models.trees, out=out)
    parts = models.ensembles[name]
    each = {member: f"_of_{name}_{i}" for i, member in enumerate(parts)}
    for member, column in each.items():
        rows = predict(rows, models, member, column)
    total = sum(parts.values())
    mean = sum((F.col(each[m]) * (w / total) for m, w in parts.items()), F.lit(0.0))
    return rows.withColumn(out, mean).drop(*each.values())


def errors(models: Models, long: DataFrame, wanted=("count", "mae", "smape", "rmsd", "rsq"), configs: DataFrame | None = None) -> DataFrame:
    """keys, model and its error metrics on ``long``, whose ``configs`` (keys and parameters) are found if not given.

    Models predict each configuration once; rows meet these predictions, and all models' errors are one pass. Percentiles of
    errors take the rows of each model.
    """
    if set(assess.METRICS[4:8]) & set(wanted):
        made = [assess.metrics(predict(long, models, n), models.keys, wanted=wanted).select(*models.keys, F.lit(n).alias("model"), *wanted) for n in models.names]
        return reduce(DataFrame.unionByName, made)
    by, names = [*models.keys, *models.params], [n for n in models.names if n not in models.ensembles]
    configs = written(long.select(*by).distinct()) if configs is None else configs
    each = written(reduce(DataFrame.unionByName, [predict(configs, models, n, "_p").select(*by, F.lit(n).alias("_t"), "_p") for n in names]))
    table = written(each.groupBy(*by).agg(*(F.max(F.when(F.col("_t") == n, F.col("_p"))).alias(f"_m{i}") for i, n in enumerate(names))))

    def of(name: str) -> Column:
        """As ``predict``: what lacks a member's prediction has none."""
        if name in names:
            return F.col(f"_m{names.index(name)}")
        parts = models.ensembles[name]
        return reduce(lambda a, b: a + b, [of(m) * (w / sum(parts.values())) for m, w in parts.items()], F.lit(0.0))

    tags = {f"_m{i}": n for i, n in enumerate(models.names)}
    table = table.select(*by, *(of(n).alias(t) for t, n in tags.items()))
    rows = long.select(*by, "value").alias("r").join(broadcast_if_small(table).alias("p"), stats._same(by, "r", "p")).select(*(f"r.{k}" for k in models.keys), "value", *tags)
    found = assess.wide_metrics(rows, models.keys, {t: t for t in tags}, wanted=tuple(dict.fromkeys(("count", *wanted))))
    long_form = F.explode(F.array(*(F.struct(F.lit(n).alias("model"), F.col(f"{t}_count").alias("_n"), *(F.col(f"{t}_{m}").alias(m) for m in wanted)) for t, n in tags.items())))
    return found.select(*models.keys, long_form.alias("_e")).where("_e._n > 0").select(*models.keys, "_e.model", *(f"_e.{m}" for m in wanted))


def save(models: Models, folder: str) -> None:
    """Write the tables first and the manifest last: a folder with a manifest is whole."""
    tables = {"static": models.static, "lut": models.lut, "errors": models.errors}
    if models.trees is not None:
        tables |= {f"tree_{n}": getattr(models.trees, n) for n in ("nodes", "edges", "roots")}
    tables = {n: t for n, t in tables.items() if t is not None}
    for n, t in tables.items():
        t.write.parquet(f"{folder}/{n}")
    said = {
        "format": FORMAT, "keys": models.keys, "params": models.params, "ensembles": models.ensembles, "tables": {n: t.schema.jsonValue() for n, t in tables.items()},
        "tree": None if models.trees is None else {"depth": models.trees.depth, "terms": models.trees.terms, "keys": models.trees.keys, "params": models.trees.params},
    }
    spark = models.static.sparkSession
    spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.text(f"{folder}/manifest")


def load(spark: SparkSession, folder: str) -> Models:
    """The models of a folder; an unknown format is an error."""
    from pyspark.sql.types import StructType

    said = json.loads(spark.read.text(f"{folder}/manifest").first()["value"])
    if said["format"] != FORMAT:
        raise ValueError(f"models of format {said['format']}")
    tables = {n: spark.read.schema(StructType.fromJson(shape)).parquet(f"{folder}/{n}") for n, shape in said["tables"].items()}
    t = said["tree"]
    trees = None
    if t is not None:
        terms = tuple(tuple(tuple(f) for f in term) for term in t["terms"])
        trees = grove.Grove(tables["tree_nodes"], tables["tree_edges"], tables["tree_roots"], tuple(t["keys"]), tuple(t["params"]), t["depth"], terms)
    return Models(tuple(said["keys"]), tuple(said["params"]), tables["static"], tables["lut"], trees, said["ensembles"], tables.get("errors"))
