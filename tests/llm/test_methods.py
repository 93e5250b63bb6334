"""Methods against plain replays of them, and cases that all operators share: clashing names, long texts, ties, frequent keys."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugework.llm import ann, chat, decontaminate, features, grading, jaccard_join, language, line_dedup, mixing, repeats, store, warc
from gaugework.llm.components import components
from tests.llm.test_corpus_ops import DOCS, WORDS, brute_classes, brute_contamination, brute_repeats

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(14)
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(WORDS[60 * (i % 2) : 60 * (i % 2) + 80]) for _ in range(rng.randint(5, 60))]
        if i % 3 == 0:
            w += ["vile", "rotten"]
        elif i % 6 == 1:
            w = ["spam" if j % 2 else v for j, v in enumerate(w)]
        rows.append((i, " ".join(w), ["en", "de"][i % 2], "s", 1))
        labels.append((i, int(i % 6 != 1), int(i % 3 == 0)))
    rows += [(600, None, "en", "s", 0), (601, "", "en", "s", 0), (5, rows[5][1], "de", "s", 1)]
    return rows, labels, spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)


# --- op1 ---------------------------------------------------------------------------------------------------------------


def recall(found, x, k=10):
    hits, n = 0, 0
    for q, got in found.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(set(got) & set(np.lexsort((np.arange(len(x)), d))[:k].tolist()))
        n += k
    return hits / n


@pytest.mark.parametrize("kind", ["even", "clusters"])
def test_ann_by_its_codes_alone(spark, kind):
    """The codes choose 2 % of the table; nothing else is measured exactly."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 32))
    if kind == "clusters":
        x = rng.normal(size=(60, 32))[rng.integers(0, 60, 6000)] + 0.3 * x
    rows = store.settle(ann.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")))
    found = {}
    for r in ann.search(rows, rows.where("vec_id % 100 = 0"), rerank=120, close=False).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert len(found) == 60 and recall(found, x) >= 0.9
    worse = {}
    for r in ann.search(rows, rows.where("vec_id % 100 = 0"), rerank=10, close=False).collect():
        worse.setdefault(r.query_id, []).append(r.vec_id)
    assert 0.3 < recall(worse, x) <= recall(found, x)


def test_ann_unequal_lengths(spark):
    rows = [(i, [float(i), 1.0, 2.0]) for i in range(30)] + [(100, [1.0, 2.0]), (200, [1.0] * 4), (300, [0.5])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10).collect()
    assert {r.query_id for r in got} == {0, 10, 20} and max(r.vec_id for r in got) < 30
    two = ann.usable(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert [r.vec_id for r in two] == [1]


# --- op2 ---------------------------------------------------------------------------------------------------------------


def test_mixing_against_a_plain_replay(labelled):
    """Posteriors text by text, and projected gradients on all rows at once."""
    _, _, docs, labels = labelled
    got = mixing.mix(docs, mixing.domains(docs, labels), mixing.TARGETS, texts=True).collect()
    names, weights = mixing.fit(*features.labelled_sample(docs, mixing.domains(docs, labels)))
    assert names == ["poor", "prose-de", "prose-en", "toxic"]
    p, t = [], []
    for r in got:
        owner, f = features.text_features(pa.array([r.text], pa.string()))
        z = [sum(float(weights[i, j]) for i in f) for j in range(len(names))]
        e = [np.exp(v - max(z)) for v in z]
        p.append([v / sum(e) for v in e])
        t.append(len((r.text or "").split()))
    p, t = np.array(p), np.array(t, float)
    assert np.allclose(p, [r.posteriors for r in got], atol=1e-6) and t.tolist() == [r.n_tokens for r in got]
    assert [names[i] for i in p.argmax(1)] == [r.domain for r in got]
    # 0.2 de and 0.4 en: documents of each are scaled to their targets, and hold as much of poor and toxic then.
    share, spill = [0.0, 1 / 3, 2 / 3, 0.0], [0.0] * 4
    for j in (1, 2):
        mine = [i for i in range(len(p)) if p[i].argmax() == j]
        for k in (0, 3):
            spill[k] += share[j] * sum(t[i] * p[i, k] for i in mine) / sum(t[i] * p[i, j] for i in mine)
    target = (np.array(share) + spill) * t.sum() / (1 + sum(spill))
    r, best, keep, since = np.ones(len(p)), np.inf, None, 0
    for _ in range(mixing.STEPS):
        miss = ((r * t) @ p - target) / target.sum()
        if np.abs(miss).max() < best - mixing.TOLERANCE:
            best, keep, since = np.abs(miss).max(), r.copy(), 0
        else:
            since += 1
        if np.abs(miss).max() < mixing.TOLERANCE or since >= 5:
            break
        m = (p * (t * (r > 0))[:, None]).T @ p / target.sum()
        r = np.maximum(0.0, r - p @ np.linalg.solve(m + (mixing.DAMPING * np.trace(m) / 4 + 1e-12) * np.eye(4), miss))
    keep[t == 0] = 1.0
    assert np.allclose([x.rate for x in got], keep, atol=1e-4)
    share = (keep * t) @ p / (keep * t).sum()
    assert abs(share[2] / share[1] - 2) < 0.05


def test_mixing_keeps_clean_documents(labelled):
    rows, labels, docs, label_df = labelled
    got = mixing.keep_rated(docs, label_df)
    kept = {r.doc_id: r.rate for r in got.collect()}
    clean = {d for d, q, t in labels if q and not t}
    toxic = {d for d, _, t in labels if t}
    assert clean <= set(kept) and min(kept[d] for d in clean) > 0.05
    assert np.mean([kept.get(d, 0.0) for d in toxic]) < 0.1 * np.mean([kept[d] for d in clean])
    assert len([r for r in got.collect() if r.doc_id == 5]) == 2


# --- op3 ---------------------------------------------------------------------------------------------------------------


def brute_language(rows, size):
    import zlib

    def grams(text):
        line = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        out = Counter()
        for w in line.split():
            w = f" {w} "
            out.update(w[1:-1])
            out.update(w[i : i + 2] for i in range(len(w) - 1))
            out.update(w[i : i + 3] for i in range(len(w) - 2))
        return out

    code = lambda g: sum(0 if False else (1 if c == " " else ord(c)) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    order = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], code(x[0])))][:size]
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 5 == 0 for d, *_ in rows}
    total = {}
    for d, t, lang, *_ in rows:
        if lang is not None and d is not None and not held[d]:
            total.setdefault(lang, Counter()).update(grams(t))
    profile = {k: {g: i for i, g in enumerate(order(c))} for k, c in total.items()}
    out = Counter()
    for d, t, *_ in rows:
        mine = order(grams(t))
        if not mine or not profile:
            out[(d, held[d], "und", 0.0)] += 1
            continue
        away = {k: sum(abs(p[g] - i) if g in p else size for i, g in enumerate(mine)) for k, p in profile.items()}
        best = min(sorted(away), key=lambda k: away[k])
        out[(d, held[d], best, round(1 - away[best] / (size * len(mine)), 9))] += 1
    return out


@pytest.mark.parametrize("size", [300, 12])
def test_language_against_brute_force(spark, size):
    text = {"en": "the quick brown fox and the lazy dog are here", "de": "der schnelle Fuchs über faule Hunde, ß", "es": "el zorro rápido y el perro perezoso"}
    rng = random.Random(20)
    rows = [(i, " ".join(rng.choice(text[k].split()) for _ in range(rng.randint(1, 9))), k, "s", 1) for i in range(90) for k in [rng.choice(list(text))]]
    # Equal distances: a twin language learned from the same texts; repeated rows; texts without letters.
    rows += [(i + 1000, t, "zz-" + k, "s", 1) for i, (_, t, k, *_) in enumerate(rows)] + [rows[3], (500, None, "en", "s", 1), (501, "1 2", "en", "s", 1), (502, "", None, "s", 1), (None, "Hunde", "de", "s", 1)]
    got = Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in language.language_digest(spark.createDataFrame(rows, DOCS), size).collect())
    assert got == brute_language(rows, size)


# --- op6 ---------------------------------------------------------------------------------------------------------------


def test_grading_is_the_likelihoods_optimum(labelled):
    """No small change of a weight or threshold raises the penalised likelihood, and all grades follow from these weights."""
    _, _, docs, labels = labelled
    y, row, feature = features.labelled_sample(docs, grading.ratings(labels), grading.SAMPLE)
    model = grading.fit(y, row, feature, steps=3000)
    texts = [np.unique(feature[row == i]) for i in range(len(y))]

    def objective(w, cuts):
        total = 0.0
        for f, g in zip(texts, y, strict=True):
            tail = [1.0, *(1 / (1 + np.exp(c - w[f].sum())) for c in cuts), 0.0]
            k = model["grades"].index(g)
            total -= np.log(max(tail[k] - tail[k + 1], 1e-9))
        return total / len(y) + 0.5 * 2.0 / len(y) * float((w.astype(float) ** 2).sum())

    w, cuts = model["weights"].astype(float), model["cuts"]
    best = objective(w, cuts)
    rng = np.random.default_rng(1)
    used = np.flatnonzero(w)
    for j in rng.choice(used, 12, replace=False):
        for step in (-0.05, 0.05):
            v = w.copy()
            v[j] += step
            assert objective(v, cuts) > best - 1e-6
    for j in range(len(cuts)):
        for step in (-0.05, 0.05):
            assert objective(w, cuts + step * (np.arange(len(cuts)) == j)) > best - 1e-6
    assert np.all(np.diff(cuts) > 0) and cuts.shape == (2,)
    got = {(r.doc_id, r.text): r for r in grading.grade(docs, grading.ratings(labels)).collect()}
    same = grading.fit(*features.labelled_sample(docs, grading.ratings(labels), grading.SAMPLE))
    for (_, t), r in list(got.items())[::17]:
        z = float(same["weights"][features.text_features(pa.array([t], pa.string()))[1]].astype(float).sum())
        tail = [1 / (1 + np.exp(c - z)) for c in same["cuts"]]
        assert abs(r.p_top - tail[1]) < 1e-6 and abs(r.expected_grade - sum(tail)) < 1e-6


# --- op9 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [380, 400, 401, 640])
def test_repeats_of_planted_passages(spark, size):
    """A passage of 400 bytes or more goes from every document that holds it, a shorter one (of over 50 words, too) stays."""
    rng = random.Random(size)
    passage = " ".join(rng.choice(WORDS) for _ in range(200))[:size]
    assert len(passage) == size and len(passage.split()) > 50
    fill = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = [(i, fill(rng.randint(0, 900)) + passage + fill(rng.randint(0, 900)) if i % 2 else fill(1200)) for i in range(24)]
    got = repeats.repeats_digest(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(tuple(r) for r in got.collect()) == brute_repeats(rows, 400)
    removed = {r.doc_id: r.n_removed for r in got.collect()}
    assert all(removed[i] >= size if i % 2 and size >= 400 else removed[i] == 0 for i in range(24))


# --- all ---------------------------------------------------------------------------------------------------------------


def test_frequent_keys_take_the_other_way(spark, monkeypatch):
    """Frequent nodes and lines, with every threshold so low that both ways are taken."""
    monkeypatch.setattr(store, "FEW", 5)
    edges = [(0, i) for i in range(1, 90)] + [(i, i + 500) for i in range(1, 40)] + [(2000, 2001), (2001, 2002)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: 0 if n < 2000 else 2000 for e in edges for n in e}
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    often, seldom = "a line that very many documents hold, again and again", "a line that just enough documents hold, no more of them"
    rows = [(i, f"own {i}\n{often}" + f"\n{seldom}" * (i < 5)) for i in range(60)]
    done = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.line_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert done == {i: (2 + (i < 5), (i != 59) + (i < 4)) for i in range(60)}


def test_clashing_names(spark, labelled):
    """Extra columns named like results or like what an operator uses inside; stages hand on all of them as they came."""
    _, _, docs, labels = labelled
    names = ["expected_grade", "P_TOP", "n_tokens", "posteriors", "rate", "domain", "n_copies", "n_words", "n_hit", "items", "_row", "_proposed", "rid", "row", "_rid", "_cuts", "n_bytes", "spans", "kept", "_id", "_lines", "_drop", "_kept", "_pos", "y", "t", "features", "component", "lang_pred", "score", "gid", "comp", "h1"]
    wide = docs.select("*", *(F.concat(F.lit(f"{n}:"), F.col("doc_id")).alias(n) for n in names))
    whole = Counter(tuple(r) for r in wide.collect())
    bench = spark.createDataFrame([(1, "no such words here at all")], "item_id long, text string")
    for stage in (lambda d: grading.keep_good(d, labels, 0.0), line_dedup.drop_shared_lines, jaccard_join.keep_one_of_each, lambda d: decontaminate.drop_contaminated(d, bench)):
        out = stage(wide)
        assert out.columns == wide.columns and not Counter(tuple(r) for r in out.collect()) - whole and out.count() > 550
    out = mixing.keep_rated(wide, labels)
    assert len(set(c.lower() for c in out.columns)) == len(out.columns) and dict(out.dtypes)["rate"] == "double" and out.where("_row = concat('_row:', doc_id)").count() == out.count()
    graded = grading.grade(wide, grading.ratings(labels))
    assert dict(graded.dtypes)["p_top"] == "double" and graded.where("_row = concat('_row:', doc_id)").count() == 603
    cut = repeats.remove_repeats(wide)
    assert dict(cut.dtypes)["n_bytes"] == "bigint" and cut.where("row = concat('row:', doc_id)").count() == 603
    for most in (0, 500_000):
        found = decontaminate.find_contamination(wide, bench, most)
        assert dict(found.dtypes)["n_hit"] == "bigint" and found.where("rid = concat('rid:', doc_id)").count() == 603
    assert line_dedup.dedup_lines(wide.drop("_drop")).count() == 603 and jaccard_join.jaccard_classes(wide).count() == 603
    assert language.identify(wide, language.profiles(wide)).where("gid = concat('gid:', doc_id)").count() == 603
    turns = spark.createDataFrame([(1, 0, "user", "hi", 3, "x"), (1, 1, "bot", "yo", 4, "y")], "conv_id long, turn long, role string, text string, n long, keep string")
    assert [r.conv_id for r in chat.format_chats(turns).collect()] == [1]
    pages = spark.createDataFrame([(1, "u", "x" * 2000, "a", 1), (2, "u", "x" * 2000, "b", 2)], "page_id long, url string, html string, tag string, size int")
    assert {(r.page_id, r.record_type) for r in warc.round_trip(pages).collect()} == {(1, "revisit"), (2, "response")}


def test_long_texts(spark, monkeypatch):
    """Texts of many times the bytes that are worked on at once, beside short ones, give what they give alone."""
    monkeypatch.setattr(features.th, "PIECE", 1000)
    rng = random.Random(31)
    long = " ".join(rng.choice(WORDS) for _ in range(120_000))
    near = " ".join("other" if i % 40 == 0 else w for i, w in enumerate(long.split()))
    rows = [(1, long, "en", "s", 1), (2, near, "en", "s", 1), (3, "short one", "en", "s", 1), (4, None, "en", "s", 1), (5, "\n".join([long[:500_000]] * 2), "en", "s", 1), (6, "x" * 1_000_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    items = [(1, long[400_000:400_200]), (2, "short one")]
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination_digest(docs, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == brute_contamination(rows, items)
    classes = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(docs).collect()}
    assert classes == brute_classes(rows)
    assert Counter(tuple(r) for r in repeats.repeats_digest(docs.where("doc_id in (1, 3, 4, 5)")).collect()) == brute_repeats([r for r in rows if r[0] in (1, 3, 4, 5)], 400)
    assert {r.doc_id: r.n_lines for r in line_dedup.line_digest(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 1}
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], LABELS)
    assert grading.grades_digest(docs, labels).count() == 6 and {r.doc_id: r.n_tokens for r in mixing.mixture(docs, labels).collect()}[1] == 120_000
    assert {r.doc_id: r.lang_pred for r in language.language_digest(docs).collect()}[4] == "und"
