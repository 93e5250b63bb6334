"""Language identification by rank-order profiles.

A profile is a language's most frequent letter n-grams (one to three letters, words padded with
a blank) in order. A text is given the language whose profile its own order is least out of
place with. Profiles count all n-grams of all training texts.

Defined cases. A text that is null or has no letter is ``und`` with score 0. Equal distances go
to the smaller language name. A null lang does not train; a null doc_id is not held out and does
not train. Without any training text every text is ``und``. Repeated rows count as often as they
occur. Extra columns pass through; one named like a result is replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm import texthash as th
from gaugework.llm.store import extended, without

#: N-grams in a profile.
PROFILE = 300
GAP = 1
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTER[0]


def letter_grams(text: str | None) -> np.ndarray:
    """Every n-gram of a text, packed 21 bits a letter; empty if there is no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    line = np.concatenate(([GAP], np.where(_letters()[points], points, GAP), [GAP]))
    line = line[np.append(True, (line[1:] != GAP) | (line[:-1] != GAP))]
    if len(line) < 3:
        return np.zeros(0, np.int64)
    two = (line[:-1] << 21) | line[1:]
    three = ((two[:-1] << 21) | line[2:])[line[1:-1] != GAP]
    return np.concatenate((line[line != GAP], two, three))


def _count(batches):
    """Counts of n-grams by language over a whole task."""
    held: dict[str, list] = {}
    size: dict[str, int] = {}

    def merged(parts):
        g = np.concatenate([x for x, _ in parts])
        keys, at = np.unique(g, return_inverse=True)
        return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            g = letter_grams(text)
            held.setdefault(lang, []).append((g, np.ones(len(g))))
            size[lang] = size.get(lang, 0) + len(g)
            if size[lang] > 2_000_000:
                held[lang] = [merged(held[lang])]
                size[lang] = 0
    for lang, parts in held.items():
        keys, n = merged(parts)
        yield pa.RecordBatch.from_pydict({"lang": [lang] * len(keys), "gram": keys, "n": n}, schema=pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())]))


def profiles(labelled: DataFrame, size: int = PROFILE) -> DataFrame:
    """lang, gram, rank (from 0) of the ``size`` most frequent n-grams of each language."""
    counts = labelled.where("lang is not null").select("lang", "text").mapInArrow(th.in_pieces(_count), "lang string, gram bigint, n bigint")
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return total.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size).select("lang", "gram", "rank")


def _predict(model, size: int):
    def run(batches):
        langs, grams, ranks = model.value
        for batch in batches:
            out, score = [], []
            for text in batch.column("text").to_pylist():
                g = letter_grams(text)
                if not len(g) or not langs:
                    out.append("und")
                    score.append(0.0)
                    continue
                keys, n = np.unique(g, return_counts=True)
                top = keys[np.argsort(-n, kind="stable")[:size]]
                at = np.minimum(np.searchsorted(grams, top), len(grams) - 1)
                place = np.where((grams[at] == top)[:, None], ranks[at], -1)
                away = np.where(place < 0, size, np.abs(place - np.arange(len(top))[:, None])).sum(axis=0)
                best = int(np.argmin(away))
                out.append(langs[best])
                score.append(1.0 - float(away[best]) / (size * len(top)))
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: DataFrame, size: int = PROFILE) -> DataFrame:
    """``docs`` without text, with lang_pred and score. A model has ``size`` rows for each language."""
    rows = model.collect()
    langs = sorted({r["lang"] for r in rows})
    grams = np.array(sorted({r["gram"] for r in rows}), np.int64)
    ranks = np.full((len(grams), max(1, len(langs))), -1, np.int64)
    where = {g: i for i, g in enumerate(grams.tolist())}
    for r in rows:
        ranks[where[r["gram"]], langs.index(r["lang"])] = r["rank"]
    held = docs.sparkSession.sparkContext.broadcast((langs, grams, ranks))
    docs = without(docs, ("lang_pred", "score"))
    return docs.mapInArrow(th.in_pieces(_predict(held, size)), extended(docs.drop("text"), "lang_pred string, score double"))


def language_digest(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """Every document's predicted language, learned from the documents whose id hash is not 0 modulo 5."""
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    marked = docs.select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = profiles(marked.where("doc_id is not null and not held_out"), size)
    return identify(marked.select("doc_id", "held_out", "text"), model, size)
