"""Hashed text features, and bounded samples of labelled texts to fit small models on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm import texthash as th

BITS = 18
_BINS = 16
DIMS = (1 << BITS) + 4 * _BINS
#: Most labelled rows that a model is fitted on, and the fewest of these that a feature must occur in.
SAMPLE, LEAST = 8000, 8


def text_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs in order of texts: hashed words that occur, and binned shape features."""
    raw, offs = th.text_bytes(column)
    n_texts = len(offs) - 1
    _, _, doc, hashes = th.words(raw, offs, th.NOT_ALNUM)
    word = (hashes >> th.U(64 - BITS)).astype(np.int64)
    pair = np.unique((doc << 20) | word)
    n = np.bincount(doc, minlength=n_texts)
    distinct = np.bincount(pair >> 20, minlength=n_texts)
    again = np.bincount(doc[1:][(hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])], minlength=n_texts) if len(doc) else np.zeros(n_texts)
    marks = np.concatenate(([0], np.cumsum((raw < 0x30) & (raw > 0x20) | (raw > 0x7A) & (raw < 0x7F))))
    some, length = np.maximum(n, 1), np.maximum(np.diff(offs), 1)
    shape = (
        np.minimum(distinct / some * 15, 15),
        np.minimum(np.log2(some), 15),
        np.minimum(again / some * 40, 15),
        np.minimum((marks[offs[1:]] - marks[offs[:-1]]) / length * 150, 15),
    )
    extra = np.stack([(1 << BITS) + j * _BINS + s.astype(np.int64) for j, s in enumerate(shape)], axis=1)
    owner = np.concatenate((pair >> 20, np.repeat(np.arange(n_texts), len(shape))))
    feature = np.concatenate((pair & ((1 << 20) - 1), extra.reshape(-1)))
    order = np.argsort(owner, kind="stable")
    return owner[order], feature[order]


def _featurise(batches):
    for batch in batches:
        owner, feature = text_features(batch.column("text"))
        ends = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feature, pa.int32()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "t", "y")), lists], names=["doc_id", "t", "y", "features"])


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[list, np.ndarray, np.ndarray]:
    """(labels, row, feature) of at most ``most`` documents that have a label.

    ``labels`` has doc_id and y. The rows of smallest id hash are taken: a fixed-size sample that
    does not depend on the order of the input. Null labels or ids do not count.
    """
    some = labels.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y"))
    some = docs.select("doc_id").where("doc_id is not null").distinct().join(some, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # Texts become lists of numbers where they are read; only these lists, of ``most`` rows, are sorted and come to the driver.
    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), "text").join(F.broadcast(some), "doc_id").select("doc_id", "t", "y", "text")
    kinds = dict(rows.dtypes)
    rows = rows.mapInArrow(th.in_pieces(_featurise), f"doc_id {kinds['doc_id']}, t bigint, y {kinds['y']}, features array<int>")
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "t").limit(most).select("y", "features").toArrow()
    lists = got["features"].combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.array([], pa.list_(pa.int32()))
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    return got["y"].to_pylist(), np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy().astype(np.int64)


def frequent(row: np.ndarray, feature: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of features that occur in ``least`` rows, with features renumbered; and the features by number."""
    count = np.bincount(feature, minlength=DIMS)
    names = np.flatnonzero(count >= least)
    number = np.full(DIMS, -1)
    number[names] = np.arange(len(names))
    keep = number[feature] >= 0
    return row[keep], number[feature[keep]], names


def adam(gradient, theta: np.ndarray, steps: int = 300, rate: float = 0.05) -> np.ndarray:
    """Adam with a falling rate on a full gradient."""
    m = v = np.zeros_like(theta)
    for t in range(1, steps + 1):
        g = gradient(theta)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (1 - t / (steps + 1))
        theta = theta - step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta
