"""Every stage of the pipeline against brute force on what the stage before it kept."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from gaugework.llm import features, grading
from tests.llm.test_corpus_ops import DOCS, WORDS, brute_classes, brute_contamination

TOXIC = ["awful", "rotten", "vile"]


def brute_lines(texts):
    key = lambda x: x.strip(" \t\n\x0b\f\r").lower()
    held = {}
    for d, t in texts.items():
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                held.setdefault(key(x), set()).add(d)
    gone = lambda d, x: len(h := held.get(key(x), ())) >= 5 and d != max(h)
    return {d: "\n".join(x for x in t.split("\n") if not gone(d, x)) for d, t in texts.items()}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(8)
    footer = "A footer line that many of these documents carry along."
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(14))) for i in range(3)]
    rows, labels = [], []
    for i in range(500):
        w = [rng.choice(WORDS) for _ in range(50)]
        if i % 4 == 0:
            w[3], w[30] = rng.choice(TOXIC), rng.choice(TOXIC)
        if i % 25 == 1:
            w[20:20] = items[i % 3][1].split()
        if i % 10 == 3 and i > 20:
            w = rows[i - 10][1].split("\n")[0].split()
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w) + f"\n{footer}" * (i % 6 == 0), ["en", "de"][i % 2], "s", 1))
        labels.append((i, 1, int(i % 4 == 0)))
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def test_stages(spark, tables):
    path, items = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality_classifier", "line_dedup", "jaccard_join", "decontamination", "mixing"]
    labels = spark.read.parquet(f"{path}/labels.parquet")

    good = stage["quality_classifier"](spark, docs, path)
    model = grading.fit(*features.labelled_sample(docs, grading.ratings(labels), grading.SAMPLE))
    rows = {r.doc_id: tuple(r) for r in docs.collect()}
    want = {}
    for d, r in rows.items():
        _, f = features.text_features(pa.array([r[1]]))
        if grading.sigmoid(model["weights"][f].sum() - model["cuts"][-1]) >= grading.KEEP_AT:
            want[d] = r
    got = {r.doc_id: tuple(r) for r in good.collect()}
    assert got == want and good.columns == docs.columns
    assert np.mean([d in got for d in rows if d % 4]) > 0.95 and np.mean([d in got for d in rows if d % 4 == 0]) < 0.1

    lined = stage["line_dedup"](spark, good, path)
    want = brute_lines({d: r[1] for d, r in got.items()})
    assert {r.doc_id: r.text for r in lined.collect()} == want and lined.columns == docs.columns
    changed = [d for d in want if want[d] != got[d][1]]
    assert len(changed) > 5 and all(r.n_chars == len(r.text) for r in lined.collect() if r.doc_id in changed)

    near = stage["jaccard_join"](spark, lined, path)
    classes = brute_classes([(r.doc_id, r.text) for r in lined.collect()])
    assert sorted(r.doc_id for r in near.collect()) == sorted(d for d, (_, c) in classes.items() if c == d)
    assert any(c != d for d, (_, c) in classes.items()) and near.columns == docs.columns

    clean = stage["decontamination"](spark, near, path)
    hits = {k[0] for k in brute_contamination([(r.doc_id, r.text) for r in near.collect()], items) if k[5]}
    assert hits and {r.doc_id for r in clean.collect()} == {r.doc_id for r in near.collect()} - hits

    mixed = stage["mixing"](spark, clean, path).collect()
    total, have = sum(r.n_tokens for r in mixed), sum(r.rate * r.n_tokens * np.array(r.posteriors) for r in mixed)
    share = dict(zip(sorted({r.domain for r in mixed}), have / total, strict=False))
    assert all(r.rate > 0 and abs(r.n_copies - r.rate) < 1 for r in mixed)
    assert abs(share["prose-en"] / share["prose-de"] - 2) < 0.1
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean.collect()}


def test_run_gives_the_last_stage(spark, tables):
    got = corpus_pipeline.run(spark, tables[0])
    assert got.count() > 100 and {"doc_id", "rate", "n_copies"} <= set(got.columns)


def test_run_gives_the_cleaned_texts(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables[0])
        good = docs if name == "quality_classifier" else good
    came, before = ({r.doc_id: tuple(r) for r in d.collect()} for d in (docs, good))
    out = corpus_pipeline.run(spark, tables[0])
    assert out.columns[: len(docs.columns)] == docs.columns
    got = {r.doc_id: tuple(r)[: len(docs.columns)] for r in out.collect()}
    assert got and all(came[d] == r for d, r in got.items())
    assert sum(r[1] != before[d][1] for d, r in got.items()) > 5
