"""Quality grades by ordinal cumulative-link regression on hashed texts.

One weight vector is shared by all grades: P(grade >= k) = sigmoid(w.x - threshold_k) with
thresholds in order. It is fitted on a bounded sample of graded documents (``SAMPLE`` rows);
every document gets the expected grade and the tail probability of the top grade.

Defined cases. Null and empty texts have only shape features and are graded like any other.
Documents without a grade, and grades without a document, do not train. If no grades, or only
one, are there, that grade (0 without any) is certain. Repeated rows are graded alike. Extra
columns pass through; of those named like a result, ``grade`` gives the result and ``keep_good``
the column that came.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm import features as ft
from gaugework.llm import texthash as th
from gaugework.llm.store import extended, set_aside, without

#: A document is kept if it reaches the top grade with this probability.
KEEP_AT = 0.5
#: Most graded documents that the weights are fitted on.
SAMPLE = 16_000
RESULTS = ("expected_grade", "p_top")


def ratings(labels: DataFrame) -> DataFrame:
    """doc_id and a grade: 0 toxic, 1 poor, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.cast("int").alias("y"))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(y: list[int], row: np.ndarray, feature: np.ndarray, prior: float = 2.0, steps: int = 300) -> dict:
    """Weights by feature and ascending thresholds, by full-gradient descent on the likelihood."""
    grades = sorted(set(y))
    if len(grades) < 2:
        return {"grades": grades or [0], "weights": np.zeros(ft.DIMS, np.float32), "cuts": np.zeros(0)}
    row, col, names = ft.frequent(row, feature)
    level, n, k = np.searchsorted(grades, y), len(y), len(grades) - 1

    def gradient(theta):
        w, cuts = theta[: len(names)], theta[len(names)] + np.concatenate(([0], np.cumsum(np.exp(theta[len(names) + 1 :]))))
        z = np.bincount(row, weights=w[col], minlength=n)
        tail = np.concatenate((np.ones((n, 1)), sigmoid(z[:, None] - cuts), np.zeros((n, 1))), axis=1)
        upper, lower = tail[np.arange(n), level], tail[np.arange(n), level + 1]
        p = np.maximum(upper - lower, 1e-9)
        up, lo = upper * (1 - upper) / p / n, lower * (1 - lower) / p / n
        dz = -(up - lo)
        dcut = np.bincount(level, weights=up, minlength=k + 1)[1:] - np.bincount(level + 1, weights=lo, minlength=k + 2)[1 : k + 1]
        rest = np.cumsum(dcut[::-1])[::-1]
        return np.concatenate((np.bincount(col, weights=dz[row], minlength=len(names)) + prior / n * w, [rest[0]], rest[1:] * np.exp(theta[len(names) + 1 :])))

    theta = ft.adam(gradient, np.zeros(len(names) + k), steps)
    weights = np.zeros(ft.DIMS, np.float32)
    weights[names] = theta[: len(names)]
    cuts = theta[len(names)] + np.concatenate(([0], np.cumsum(np.exp(theta[len(names) + 1 :]))))
    return {"grades": grades, "weights": weights, "cuts": cuts}


def _grade(model):
    def run(batches):
        m = model.value
        levels = np.array(m["grades"], float)
        for batch in batches:
            owner, feature = ft.text_features(batch.column("text"))
            z = np.bincount(owner, weights=m["weights"][feature], minlength=batch.num_rows)
            tail = sigmoid(z[:, None] - m["cuts"])
            expected = levels[0] + tail @ np.diff(levels)
            top = tail[:, -1] if len(m["cuts"]) else np.ones(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(expected), pa.array(top)], names=[*batch.schema.names, "expected_grade", "p_top"])

    return run


def grade(docs: DataFrame, graded: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with expected_grade and p_top. ``graded`` has doc_id and y, an integer grade."""
    docs = without(docs, RESULTS)
    model = docs.sparkSession.sparkContext.broadcast(fit(*ft.labelled_sample(docs, graded, sample)))
    return docs.mapInArrow(th.in_pieces(_grade(model)), extended(docs, "expected_grade double, p_top double"))


def grades_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    done = grade(docs.select("doc_id", "text"), ratings(labels))
    return done.select("doc_id", "expected_grade", "p_top", (F.col("p_top") >= KEEP_AT).alias("selected"))


def keep_good(docs: DataFrame, labels: DataFrame, at: float = KEEP_AT) -> DataFrame:
    """The documents that reach the top grade with probability ``at``."""
    docs, back = set_aside(docs, RESULTS)
    return grade(docs, ratings(labels)).where(F.col("p_top") >= at).select(back)
