"""Mixing sources to target weights with soft memberships.

A softmax classifier fitted on a bounded sample of labelled documents (``features.SAMPLE`` rows)
gives every document its domain posteriors p_dk. Nonnegative document rates r_d are then fitted
so that the expected domain token totals sum_d r_d t_d p_dk meet the target totals: projected
gradient least squares from r = 1, in the metric of the token-weighted posterior moments, which
makes steps alike in all domains. An iteration is one distributed sum of as many numbers as
there are domains; a document's rate follows from its posteriors and the gradients so far, so
no state of the size of the corpus is carried along.

A domain without a target is to get no tokens from documents that most likely belong to it, but
soft posteriors give every document a little of it. So its target total is what the documents of
the other domains hold of it at their own targets: least squares then has no reason to take clean
documents out, and the rest follows the targets.

Defined cases. Null and empty texts have no tokens and rate 1. A domain with a target but
hardly any tokens is met as well as least squares can. Labels without a document, and null
labels, do not train; with fewer than two domains that one is certain. Without any labelled
document there is no domain and all rates are 1. Repeated rows have equal rates. Extra columns
pass through; one named like a result is replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm import features as ft
from gaugework.llm import texthash as th
from gaugework.llm.store import extended, settle, without

#: Least squares stops once the largest residual, as a share of all tokens, is below this or hardly falls, or after so many steps.
TOLERANCE, STEPS = 1e-4, 40
#: Damping of the metric, as a share of the mean moment: domains of hardly any tokens do not drive the rates of all others.
DAMPING = 0.02
#: Domains of the corpus query and their target shares of tokens.
TARGETS = {"prose-en": 0.4, "prose-de": 0.2, "prose-es": 0.2, "prose-fr": 0.2, "poor": 0.0, "toxic": 0.0}
RESULTS = ("n_tokens", "posteriors", "rate", "domain", "n_copies")


def domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and domain of the labelled documents: toxic, poor, or prose of a language."""
    named = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").otherwise(F.concat(F.lit("prose-"), F.col("lang")))
    return labels.join(docs.select("doc_id", "lang"), "doc_id").select("doc_id", named.alias("y"))


def fit(y: list[str], row: np.ndarray, feature: np.ndarray, prior: float = 2.0, steps: int = 150) -> tuple[list[str], np.ndarray]:
    """Domain names and softmax weights, features by domains."""
    names = sorted(set(y))
    weights = np.zeros((ft.DIMS, max(1, len(names))), np.float32)
    if len(names) < 2:
        return names, weights
    row, col, kept = ft.frequent(row, feature)
    n, k = len(y), len(names)
    truth = np.eye(k)[[names.index(v) for v in y]]

    def sums(index, values, size):
        return np.stack([np.bincount(index, weights=values[:, j], minlength=size) for j in range(values.shape[1])], axis=1)

    def gradient(theta):
        w = theta.reshape(len(kept), k)
        z = sums(row, w[col], n)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return (sums(col, ((p - truth) / n)[row], len(kept)) + prior / n * w).reshape(-1)

    weights[kept] = ft.adam(gradient, np.zeros(len(kept) * k), steps).reshape(-1, k)
    return names, weights


def _posteriors(model, columns: list[str]):
    def run(batches):
        names, weights = model.value
        for batch in batches:
            column = batch.column("text")
            owner, feature = ft.text_features(column)
            z = np.stack([np.bincount(owner, weights=weights[feature, j], minlength=batch.num_rows) for j in range(weights.shape[1])], axis=1)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            raw, offs = th.text_bytes(column)
            doc = th.words(raw, offs, th.BLANK)[2]
            p = p if names else p[:, :0]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * p.shape[1], pa.int32()), pa.array(p.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(np.bincount(doc, minlength=batch.num_rows)), lists], names=[*columns, "n_tokens", "posteriors"])

    return run


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def rates(p: np.ndarray, gradients: list[np.ndarray]) -> np.ndarray:
    """Rates after the steps taken so far, each projected on the nonnegative numbers."""
    r = np.ones(len(p))
    for g in gradients:
        r = np.maximum(0.0, r - p @ g)
    return r


def _totals(k: int, gradients: list[np.ndarray]):
    """Expected tokens of each domain, and the moments sum t p p' of the documents whose rate is free."""

    def run(batches):
        total, moment = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            p, t = _matrix(batch.column("posteriors"), k), batch.column("n_tokens").to_numpy().astype(float)
            r = rates(p, gradients)
            total += (r * t) @ p
            moment += (p * (t * (r > 0))[:, None]).T @ p
        yield pa.RecordBatch.from_pydict({"i": np.arange(k * (k + 1)), "v": np.concatenate((total, moment.reshape(-1)))})

    return run


def solve(soft: DataFrame, target: np.ndarray) -> list[np.ndarray]:
    """The gradients of each step; ``soft`` (settled) has n_tokens and posteriors."""
    k, steps = len(target), []
    best, kept = np.inf, 0
    for _ in range(STEPS):
        sums = soft.select("n_tokens", "posteriors").mapInArrow(_totals(k, steps), "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(k * (k + 1))
        for r in sums:
            flat[r["i"]] = r["v"]
        total, moment = flat[:k], flat[k:].reshape(k, k)
        if not target.sum():
            break
        miss = (total - target) / target.sum()
        size = float(np.abs(miss).max())
        if size < best - TOLERANCE:
            best, kept = size, len(steps)
        if size < TOLERANCE or len(steps) - kept >= 5:
            break
        moment /= target.sum()
        steps.append(np.linalg.solve(moment + (DAMPING * np.trace(moment) / k + 1e-12) * np.eye(k), miss))
    return steps[:kept]


def _apply(k: int, gradients: list[np.ndarray]):
    def run(batches):
        for batch in batches:
            r = rates(_matrix(batch.column("posteriors"), k), gradients) if k else np.ones(batch.num_rows)
            r = np.where(batch.column("n_tokens").to_numpy() > 0, r, 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r)], names=[*batch.schema.names, "rate"])

    return run


def _by_domain(k: int):
    """Expected tokens of each domain (column) in the documents that each domain (row) is most likely of; and all tokens, last."""

    def run(batches):
        held, tokens = np.zeros((k, k)), 0.0
        for batch in batches:
            p, t = _matrix(batch.column("posteriors"), k), batch.column("n_tokens").to_numpy().astype(float)
            if len(p):
                held += (np.eye(k)[p.argmax(axis=1)] * t[:, None]).T @ p
                tokens += t.sum()
        yield pa.RecordBatch.from_pydict({"i": np.arange(k * k + 1), "v": np.append(held.reshape(-1), tokens)})

    return run


def target_totals(soft: DataFrame, names: list[str], targets: dict[str, float]) -> np.ndarray:
    """Target tokens of each domain. Those with a target get their shares of ``whole``; the others get what the documents
    of these hold of them once they are scaled to their targets; and all of it sums to all tokens."""
    k = len(names)
    share = np.array([targets.get(n, 0.0) for n in names])
    share = share / max(share.sum(), 1e-300)
    got = np.zeros(k * k + 1)
    for r in soft.select("n_tokens", "posteriors").mapInArrow(_by_domain(k), "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        got[r["i"]] = r["v"]
    held = got[:-1].reshape(k, k)
    own = np.diag(held)
    scale = np.where(own > 0, share / np.where(own > 0, own, 1.0), 0.0)
    spill = np.where(share > 0, 0.0, scale @ held)
    whole = got[-1] / (1 + spill.sum())
    return whole * (share + spill)


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], sample: int = ft.SAMPLE, texts: bool = False) -> DataFrame:
    """``docs`` (without text unless ``texts``), with n_tokens, posteriors (of the domains in order of name), domain and rate.

    ``labelled`` has doc_id and y, a domain name. Targets are shares of all tokens.
    """
    docs = without(docs, RESULTS)
    names, weights = fit(*ft.labelled_sample(docs, labelled, sample))
    model = docs.sparkSession.sparkContext.broadcast((names, weights))
    out = docs if texts else docs.drop("text")
    soft = settle(docs.mapInArrow(th.in_pieces(_posteriors(model, out.columns)), extended(out, "n_tokens bigint, posteriors array<double>")))
    gradients = solve(soft, target_totals(soft, names, targets)) if names else []
    done = soft.mapInArrow(_apply(len(names), gradients), extended(soft, "rate double"))
    named = F.array(*(F.lit(n) for n in names)) if names else F.array().cast("array<string>")
    return done.withColumn("domain", F.get(named, (F.array_position("posteriors", F.array_max("posteriors")) - 1).cast("int")))


def copies():
    """Whole copies that a rate stands for: its floor, and one more with the remaining probability, by id hash."""
    even = F.pmod(F.xxhash64(F.lit("copies"), F.col("doc_id")), F.lit(1_000_003)) / 1_000_003
    return (F.floor("rate") + (even < F.col("rate") - F.floor("rate")).cast("long")).alias("n_copies")


def mixture(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with its domain, rate and copies."""
    done = mix(docs.select("doc_id", "source", "text"), domains(docs, labels), TARGETS)
    return done.select("doc_id", "source", "domain", "n_tokens", "posteriors", "rate", copies())


def keep_rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents of positive rate, with all their columns, the text as it comes in among them."""
    done = mix(docs, domains(docs, labels), TARGETS, texts=True).where("rate > 0")
    return done.select(*without(docs, RESULTS).columns, "domain", "n_tokens", "posteriors", "rate", copies())
