"""Operators against brute force on small inputs, and their defined cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.llm import ann, chat, decontaminate, grading, jaccard_join, language, line_dedup, mixing, repeats, store, warc
from gaugework.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows, base = [], [" ".join(rng.choice(WORDS) for _ in range(120)) for _ in range(4)]
    passage = " ".join(rng.choice(WORDS) for _ in range(70))
    line = "This line is shared by many documents, as footers are."
    for i in range(60):
        words = base[i % 4].split() if i % 3 else [rng.choice(WORDS) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 12) if i % 3 else 0):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        text = " ".join(words)
        text += f"\n{passage}" * (i % 7 == 0) + f"\n{'  ' * (i % 2)}{line.upper() if i % 2 else line}" * (i % 2 + 1) * (i % 5 == 0)
        rows.append((i, text, "en", "a", len(text)))
    rows += [(60, None, None, None, None), (61, "", "en", "a", 0), (62, base[0], "en", "b", 1), (63, base[0], "en", "b", 1), (64, "two words", "en", "b", 9), (65, "two  WORDS", "en", "b", 9), (66, " \t ", "en", "b", 3), (67, "x" * 5000, "en", "b", 5000)]
    rows += [rows[5], (None, "no id here but some words to count", "en", "c", 9)]
    return rows, spark.createDataFrame(rows, DOCS)


def brute_classes(rows, percent=80):
    sets = {}
    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").lower())
        sets.setdefault(d, set()).update([" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))] if w else [])
    ids = [d for d in sets if d is not None]
    comp = {d: d for d in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                inter = len(sets[a] & sets[b])
                if a != b and inter and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter) and comp[a] < comp[b]:
                    comp[b] = comp[a]
                    changed = True
    return {d: (len(sets[d]), comp[d]) for d in ids}


def test_jaccard_classes(corpus):
    rows, df = corpus
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(df).collect()}
    assert {k: v for k, v in got.items() if k is not None} == brute_classes(rows)
    assert got[None][1] is None
    kept = jaccard_join.keep_one_of_each(df)
    assert kept.columns == df.columns
    want = sorted(d for d, (_, c) in brute_classes(rows).items() if c == d)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want


def test_jaccard_large_groups(spark):
    """A hot group of near copies, and of copies, with a text that only some of them link."""
    rng = random.Random(9)
    base = [rng.choice(WORDS) for _ in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        if i % 3:
            w[rng.randrange(80)] = f"own{i}"
        rows.append((i, " ".join(w), "en", "a", 1))
    half = list(base)
    half[40:44] = ["q1", "q2", "q3", "q4"]
    rows.append((500, " ".join(half), "en", "a", 1))
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(df).collect()}
    assert got == brute_classes(rows)


def test_jaccard_shuffled_matrix(corpus, monkeypatch):
    rows, df = corpus
    monkeypatch.setattr(jaccard_join, "MAX_SHARED", 0)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(df).collect() if r.doc_id is not None}
    assert got == brute_classes(rows)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == root


def test_line_dedup(corpus):
    rows, df = corpus
    strip = " \t\n\x0b\f\r"
    holders = {}
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            k = x.strip(strip).lower()
            if len(k) >= 40 and d is not None:
                holders.setdefault(k, set()).add(d)
    want = Counter()
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        gone = [len(h := holders.get(x.strip(strip).lower(), ())) >= 5 and d is not None and d != max(h) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        want[(d, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in line_dedup.line_digest(df).collect()) == want
    assert sum(k[2] for k in want) > 5
    assert line_dedup.drop_shared_lines(df.withColumn("_pos", F.lit(1))).columns == [*df.columns, "_pos"]


def brute_repeats(rows, length):
    count = Counter(b[i : i + length] for _, t, *_ in rows for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    out = Counter()
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[(d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())] += 1
    return out


@pytest.mark.parametrize("length", [400, 60])
def test_repeats(corpus, length):
    rows, df = corpus
    want = brute_repeats(rows, length)
    assert sum(k[2] for k in want) > 1000
    assert Counter(tuple(r) for r in repeats.repeats_digest(df, length).collect()) == want


def test_repeats_across_segments(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    rng = random.Random(3)
    base = "".join(rng.choice("abcdé ") for _ in range(5000))
    rows = [(1, base), (2, "q" * 300 + base[1000:2500] + "zz"), (3, "ab" * 2000), (4, base[:450])]
    got = Counter(tuple(r) for r in repeats.repeats_digest(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())
    assert got == brute_repeats(rows, 400)


def brute_contamination(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = []
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        wins += [(i, tuple(w[j : j + n])) for j in range(len(w) - n + 1) if n]
    out = Counter()
    for d, t, *_ in rows:
        w, hit, held = words(t), set(), set()
        for i, win in wins:
            for j in range(len(w) - len(win) + 1):
                if tuple(w[j : j + len(win)]) == win:
                    hit |= set(range(j, j + len(win)))
                    held.add(str(i))
        out[(d, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit))] += 1
    return out


@pytest.mark.parametrize("most", [500_000, 0])
def test_decontamination(spark, corpus, most):
    rows, df = corpus
    items = [(1, rows[1][1][20:200]), (2, "two words"), (3, None), (4, "..."), (10, rows[7][1]), (11, rows[7][1]), (12, "Some, WORDS to count")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(df.select("doc_id", "text"), bench, most)
    got = Counter((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0) for r in found.collect())
    want = brute_contamination(rows, items)
    assert got == want and sum(k[5] for k in want) > 5
    assert decontaminate.drop_contaminated(df, bench).columns == df.columns


def test_language(spark):
    texts = {"en": "the quick brown fox and the lazy dog are here with them", "de": "der schnelle braune Fuchs und der faule Hund sind hier mit ihnen", "fr": "le renard brun rapide et le chien paresseux sont ici avec eux"}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.sample(t.split(), 8)), lang, "s", 1) for i, (lang, t) in enumerate(list(texts.items()) * 20)]
    rows += [(100, None, "en", "s", 0), (101, "12 34", "en", "s", 0), (102, "the dog", None, "s", 0), (None, "der Hund", "de", "s", 0)]
    got = language.language_digest(spark.createDataFrame(rows, DOCS)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[100].lang_pred == by[101].lang_pred == "und" and by[102].lang_pred == "en"
    assert by[None].held_out is False and by[None].lang_pred == "de"
    held = [r for r in got if r.held_out and r.doc_id < 60]
    assert held and all(r.lang_pred == rows[r.doc_id][2] for r in held) and all(0 <= r.score <= 1 for r in got)
    none = language.language_digest(spark.createDataFrame(rows[:5], DOCS).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(1800):
        w = [rng.choice(WORDS) for _ in range(60)]
        kind = i % 3
        if kind == 0:
            w[5], w[20] = rng.choice(["awful", "rotten", "vile"]), rng.choice(["awful", "rotten", "vile"])
        if kind == 1:
            w = [w[j // 10] for j in range(60)]
        rows.append((i, " ".join(w), ["en", "de"][i % 2], "a", 1))
        if i % 5:
            labels.append((i, 0 if kind == 1 else 1, 1 if kind == 0 else 0))
    rows += [(None, None, None, None, None), (2000, "", "en", "a", 0)]
    labels += [(None, 1, 0), (5000, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_grading_held_out(graded):
    docs, labels = graded
    got = {r.doc_id: r for r in grading.grades_digest(docs, labels).collect()}
    held = [i for i in range(1800) if i % 5 == 0]
    assert np.mean([got[i].selected == (i % 3 == 2) for i in held]) > 0.9
    assert np.mean([got[i].expected_grade for i in held if i % 3 == 0]) < np.mean([got[i].expected_grade for i in held if i % 3 == 1])
    empty = grading.grades_digest(docs, labels.limit(0)).collect()
    assert all(r.selected for r in empty) and len(empty) == 1802


def test_mixing_meets_targets(graded):
    docs, labels = graded
    targets = {"prose-en": 0.5, "prose-de": 0.3, "poor": 0.15, "toxic": 0.05}
    got = mixing.mix(docs, mixing.domains(docs, labels), targets).collect()
    names = sorted(targets)
    total = sum(r.n_tokens for r in got)
    have = sum(r.rate * r.n_tokens * np.array(r.posteriors) for r in got) / total
    assert np.abs(have - [targets[n] for n in names]).max() < 2e-3
    assert all(r.rate >= 0 for r in got) and len(got) == 1802
    assert mixing.mix(docs, mixing.domains(docs, labels).limit(0), targets).where("rate <> 1").count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 2, "user", None), (4, 0, "user", "hi"), (4, 1, "assistant", "yo"), (4, 2, "user", None), (5, 0, "user", "hi"), (5, 1, "assistant", "yo"), (5, 2, "user", ""), (6, 1, None, "x"), (6, 1, None, "x"), (None, 0, "user", "z")]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id for r in got), key=lambda x: (x is None, x or 0)) == [3, 5, 6, None]
    assert next(r.rendered for r in got if r.conv_id == 5) == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\n<|im_end|>\n"


def test_chat_in_several_ranges(spark):
    """A conversation over several ranges, a prefix of it, and repeated turns: hashes and texts as in one range."""
    rows = [(1, i, "user", f"w{i * i % 53}") for i in range(3000)]
    rows += [(2, *r[1:]) for r in rows[:2000]] + [(3, 0, "user", "x")] * 700 + [(4, 0, "user", "x")] * 699 + [(None, None, "a", "z")] * 900 + [(k, 0, "user", f"q{k % 40}") for k in range(10, 300)]
    random.Random(1).shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert chat.prefixes(turns)[1].count() >= 4
        got = {r.conv_id: r for r in chat.format_chats(turns).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(got) == {None, 1, 3, *range(10, 50)}
    assert got[1].rendered == "".join(f"<|im_start|>user\nw{i * i % 53}<|im_end|>\n" for i in range(3000))
    assert (got[3].n_turns, got[None].n_turns, got[None].rendered) == (700, 900, "<|im_start|>a\nz<|im_end|>\n" * 900)


def test_warc_round_trip(spark, tmp_path):
    big, rows = "é" * 600 + "\r\n\r\nWARC/1.1\r\n", []
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, "small"), (4, "http://a/4", "small"), (5, "http://a/5\nx", None), (None, "http://a/n", big), (7, "u", big), (7, "u", big), (8, "v", "y" * 400_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    index = warc.write_archives(pages, folder)
    back = warc.read_archives(spark, folder).collect()
    assert len(back) == len(rows) == index.count()
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in back)
    assert kinds == Counter({(1, "revisit", 7): 1, (2, "revisit", 7): 1, (3, "response", None): 1, (4, "response", None): 1, (5, "response", None): 1, (None, "revisit", 7): 1, (7, "response", None): 1, (7, "revisit", 7): 1, (8, "response", None): 1})
    for r in back:
        html = dict((p, h) for p, _, h in rows)[r.page_id] or ""
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == hashlib.sha1(html.encode()).hexdigest()
        assert r.payload is None or bytes(r.payload) == html.encode()
    at = index.where("record_id = '<urn:page:8>'").first()
    head, payload = warc.read_record(folder, at.archive, at.frame, at.frame_offset)
    assert head["WARC-Record-ID"] == "<urn:page:8>" and payload == b"y" * 400_000


def test_ann_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[:50] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [None] * 16), (None, x[0].tolist()), (5400, [])]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 3000, 100))
    y, hits = x.astype(float), 0
    for q, found in got.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(3000), d))[:10]
        assert [f[0] for f in sorted(found)] == list(range(1, 11)) and all(abs(d[v] - s) < 1e-12 for _, v, s in found)
        hits += len({f[1] for f in found} & set(best.tolist()))
    assert hits >= 0.95 * 300 and [f[1] for f in sorted(got[0])] == list(range(1, 11))


def test_ann_near_copies_beyond_the_shortlist(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 32))
    x /= np.sqrt((x * x).sum(1))[:, None]
    x[::2] = x[0] + rng.normal(size=(2000, 32)) * 1e-4
    got = {}
    vectors = ann.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    vectors = store.settle(vectors)
    for r in ann.search(vectors, vectors.where("vec_id % 100 = 0"), sample=100).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert 2000 > ann.RERANK and sorted(got) == list(range(0, 4000, 100))
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert [v for _, v in sorted(found)] == np.argsort(d)[:10].tolist()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    frames = [line_dedup.line_digest(docs), jaccard_join.jaccard_classes(docs), repeats.repeats_digest(docs), decontaminate.contamination_digest(docs, bench), language.language_digest(docs), grading.grades_digest(docs, labels), mixing.mixture(docs, labels)]
    frames += [ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")), chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")), warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string"))]
    assert [f.count() for f in frames] == [0] * len(frames)
