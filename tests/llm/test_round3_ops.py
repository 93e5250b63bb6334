"""Merkle manifest, hard negatives and URL filters against brute force, and their defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.llm import hardneg, merkle, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_leaf(row, bad=False):
    doc_id, text, lang, source, n = row[:5]
    if bad and text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return h(*(enc(v) for v in (doc_id, source, lang, n, text)))


def brute_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def brute_manifest(rows):
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append(r)
    keys = sorted(langs, key=lambda k: (k is not None, (k or "").encode()))
    for k in keys:
        langs[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
    trees = {k: brute_tree([brute_leaf(r) for r in langs[k]]) for k in keys}
    top = brute_tree([trees[k][-1][0] for k in keys])
    out = Counter()
    for j, k in enumerate(keys):
        for i, r in enumerate(langs[k]):
            now, siblings = brute_leaf(r, True), []
            for levels, at in ((trees[k], i), (top, j)):
                for nodes in levels[:-1]:
                    run, slot = nodes[at // 8 * 8 : at // 8 * 8 + 8], at % 8
                    siblings += run[:slot] + run[slot + 1 :]
                    now, at = h(*run[:slot], now, *run[slot + 1 :]), at // 8
            out[(r[0], brute_leaf(r), trees[k][-1][0], top[-1][0], h(*siblings), now, now == top[-1][0])] += 1
    return out


def manifest_rows():
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["A", "bé", "C d\n"]) for _ in range(rng.randint(0, 9))), rng.choice(["en", "en", "en", "de", "ü", ""]), "s", i) for i in range(-40, 560)]
    rows += [(9, None, None, None, None), (None, "No Id", "en", "s", 1), (None, "No Id", "en", "s", 1), (None, "Other", None, None, 3), (700, "X" * 200_000, "xx", "s", 5)]
    return rows + [rows[3]] * 20 + [(rows[4][0], "Other Text", rows[4][2], "s", 2)]


def got_manifest(df):
    return Counter(tuple(r) for r in merkle.manifest_digest(df).collect())


def test_manifest(spark):
    rows = manifest_rows()
    got = got_manifest(spark.createDataFrame(rows, DOCS).repartition(5))
    assert got == brute_manifest(rows)
    assert {True, False} == {k[-1] for k in got}


def test_manifest_below_the_broadcast(spark, monkeypatch):
    rows = manifest_rows()
    df = spark.createDataFrame(rows, DOCS)
    want = brute_manifest(rows)
    for room in (0, 3):
        monkeypatch.setattr(merkle, "BROADCAST_RUNS", room)
        assert got_manifest(df) == want


def test_manifest_climbs_past_the_row_limit(spark):
    rows = [(i, "T", "en", "s", 1) for i in range(300)]
    was = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "40")
    try:
        assert got_manifest(spark.createDataFrame(rows, DOCS)) == brute_manifest(rows)
        assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "40"
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", was)


@pytest.mark.parametrize("rows", [[(5, "Ab", "en", "s", 1)], [(5, "Ab", None, None, 1), (6, "Ab", "en", "s", 1)], [(i, "A", "en", "s", 1) for i in range(9)], [(i, "A", f"l{i:02}", "s", 1) for i in range(70)]])
def test_manifest_small_trees(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    want = brute_manifest(rows)
    assert got_manifest(df) == want
    named = df.withColumns({c: F.lit(1) for c in ("tree", "n", "run", "kids", "leaf", "_p", "_i", "_n", "hash")})
    assert got_manifest(named) == want


def test_manifest_empty(spark):
    out = merkle.manifest_digest(spark.createDataFrame([], DOCS))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert out.collect() == []


VECTORS = "vec_id long, embedding array<float>, label int"


def brute_negatives(rows):
    usable = []
    for vec_id, v, label in rows:
        if vec_id is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((vec_id, [min(max(math.floor(256 * float(np.float32(x))), -hardneg.LARGEST), hardneg.LARGEST) for x in v], label))
    out = Counter()
    for anchor, av, al in usable:
        if anchor % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, v, strict=False)), i, lab) for i, v, lab in usable)
        for ps, pid, _ in [s for s in scored if s[2] == al and s[1] != anchor][:5]:
            fit = [s for s in scored if s[2] != al and 80 * -ps <= 100 * -s[0] <= 100 * -ps]
            for rank, (ns, nid, _) in enumerate(fit[:5], 1):
                out[(anchor, pid, rank, nid, -ps, -ns)] += 1
    return out


def vector_rows(n=1500, wide=8, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, wide))
    rows = [(i, (centres[rng.integers(12)] + 0.4 * rng.normal(size=wide)).astype(np.float32).tolist(), int(rng.integers(4))) for i in range(n)]
    copies = [(n + i, rows[7][1], int(i % 4)) for i in range(n // 3)]
    odd = [(None, rows[0][1], 1), (5000, None, 1), (5100, rows[0][1], None), (5200, [1.0, float("nan")] + [0.0] * (wide - 2), 1), (5300, [None] * wide, 1), (5400, [float("inf")] * wide, 2), (5500, [0.0] * wide, 1), (5501, [0.0] * wide, 2), (5600, [0.5, 0.5], 1), (5700, [], 1), (5800, [3e38] * wide, 1), (5801, [3e38] * wide, 2), (5802, [3e38] * wide, 1)]
    return rows + copies + odd


def got_negatives(df):
    return Counter(tuple(r) for r in hardneg.mine(df, lambda i: i % 100 == 0).collect())


def test_hard_negatives(spark):
    rows = vector_rows()
    want = brute_negatives(rows)
    assert len(want) > 100
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    assert got_negatives(df) == want
    assert got_negatives(df.withColumns({c: F.lit("x") for c in ("id", "v", "a", "cluster", "scores", "slice", "rank")})) == want


def test_hard_negatives_in_small_blocks(spark, monkeypatch):
    rows = vector_rows(700, 5, 6)
    df = spark.createDataFrame(rows + [rows[100], rows[3]], VECTORS)
    want = brute_negatives(rows + [rows[100], rows[3]])
    found = hardneg.mine(df, lambda i: i % 100 == 0)
    assert Counter(tuple(r) for r in found.collect()) == want


def test_walks_end_early():
    """On clustered vectors a member walks a small part of its list, and finds what all scores would give."""
    rng = np.random.default_rng(8)
    centres = 400 * rng.normal(size=(40, 32))
    v = np.floor(centres[rng.integers(40, size=20_000)] + 20 * rng.normal(size=(20_000, 32))).astype(np.int32)
    held = hardneg.Slice(np.arange(20_000), np.zeros(20_000, np.int64), v)
    walked = []
    scores = held.scores
    held.scores = lambda m, at: walked.append(len(m) * len(at)) or scores(m, at)
    members = v[:200][np.argsort(hardneg.axes(v[:200].astype(float), 40) @ v[:200].T.astype(float), axis=0)[-1] == 0]
    n = len(members)
    low, high = np.full(n, np.iinfo(np.int64).min), np.full(n, np.iinfo(np.int64).max)
    j, s, i = held.walk(members, 5, np.zeros(n, np.int64), True, np.full(n, -1), high, low, np.arange(n), np.linalg.norm(members.astype(float), axis=1))
    every = members.astype(np.int64) @ v.T.astype(np.int64)
    for m in range(n):
        best = np.lexsort((np.arange(20_000), -every[m]))[:5]
        assert s[j == m].tolist() == every[m][best].tolist() and i[j == m].tolist() == best.tolist()
    assert sum(walked) < 0.25 * n * 20_000


@pytest.mark.parametrize("rows", [[], [(100, [1.0], 1)], [(1, [1.0], 1), (2, [1.0], 2)], [(100, [1.0], 1), (1, [1.0], 1), (2, [1.0], 2)], [(100, [-1.0], 1), (1, [1.0], 1), (2, [1.0], 2)]])
def test_hard_negatives_small(spark, rows):
    assert got_negatives(spark.createDataFrame(rows, VECTORS)) == brute_negatives(rows)


RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fit, key=len) if fit else None


def brute_judge(rows):
    parsed = [(p, *brute_url(u)) for p, u, *_ in rows]
    at = {(host, path): "" for _, host, path, _ in parsed}
    depth = 0
    esc = lambda s: "".join(f"%{ord(c):02X}" if c in "%*{|}" else c for c in s)
    while any(len(path.split("/")) - 1 > depth for _, path in at):
        nodes = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
        for _, host, path, rule in parsed:
            segs = path.split("/")[1:]
            if len(segs) > depth:
                c = nodes[host, at[host, path]][segs[depth]]
                c[0] += 1
                c[1] += rule is not None and RULES[rule] == "block"
                c[2] += rule is not None and RULES[rule] == "allow"
        labels = {}
        for key, kids in nodes.items():
            total = sum(c[0] for c in kids.values())
            kept = sorted((c[1] / c[0], c[2] / c[0], s.encode(), s, c) for s, c in kids.items() if c[0] >= 5 and c[0] * 64 >= total)
            groups = []
            for _, _, _, s, c in kept:
                x = 0.0
                if groups:
                    b = groups[-1][-1][1]
                    for u, v in ((b[1], c[1]), (b[2], c[2]), (b[0] - b[1] - b[2], c[0] - c[1] - c[2])):
                        x += (u * c[0] - v * b[0]) ** 2 / (b[0] * c[0] * (u + v)) if u + v else 0.0
                if groups and x <= 5.991:
                    groups[-1].append((s, c))
                else:
                    groups.append([(s, c)])
            for g in groups:
                names = sorted((esc(s) for s, _ in g), key=lambda s: s.encode())
                for s, _ in g:
                    labels[*key, s] = names[0] if len(names) == 1 else "{" + "|".join(names) + "}"
        for host, path in list(at):
            segs = path.split("/")[1:]
            if len(segs) > depth:
                at[host, path] += "/" + labels.get((host, at[host, path], segs[depth]), "*")
        depth += 1
    bad, good = Counter(), Counter()
    for _, host, path, rule in parsed:
        if rule:
            (bad if RULES[rule] == "block" else good)[host, at[host, path]] += 1
    out = Counter()
    for p, host, path, rule in parsed:
        t = at[host, path]
        purity = (bad[host, t] + 1) / (bad[host, t] + good[host, t] + 4)
        out[(p, host, path, rule, RULES[rule] if rule else "block" if purity > 0.5 else "allow", t, purity)] += 1
    return out


def url_rows():
    rng = random.Random(12)
    urls = [None, "", "no scheme", "http://", "HTTPS://User@EXAMPLE.net:80/en/", "http://example.net", "http://net/x", "http://x.net?a://b/c", "ftp://org/fr/", "http://a.org/fr", "http://é.org/fr/é", "://a.com#x", "http://a.net/en/%7B*{|}"]
    urls += ["http://b.example.com/" + "/".join(["deep"] * 40)] * 6 + ["http://b.example.com/" + "/x" * 3000]
    for host, n in (("hot.example.com", 500), ("a.example.org", 80), ("news.example.net", 120), ("few.example.com", 4), ("mix.example.com", 60)):
        for i in range(n):
            urls.append(f"http://{host}/{rng.choice(['en', 'de', 'de', 'fr', '*a'])}/{rng.choice(['post', 'tag', str(i)])}/{rng.randint(0, 9)}{rng.choice(['', '?q=1', '#f', '/'])}")
    urls += ["http://small.example.com/de/1", "http://small.example.com/de/2", "http://small.example.com/de/3", "http://small.example.com/de/4", "http://small.example.com/en/1"]
    return [(i, u) for i, u in enumerate(urls)] + [(None, "http://a.com/x"), (3, "http://a.com/x"), (3, "http://a.com/x")]


def test_url_filters(spark):
    rows = url_rows()
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    want = brute_judge(rows)
    assert Counter(tuple(r) for r in urlfilter.judge(df).collect()) == want
    assert any(k[3] is None and k[4] == "block" for k in want) and any("|" in k[5] for k in want)
    named = df.withColumns({c: F.lit(1) for c in ("host", "path", "n", "k", "g", "rule", "_count", "template", "html")})
    assert Counter(tuple(r) for r in urlfilter.judge(named).collect()) == want


def test_url_filters_empty(spark):
    out = urlfilter.judge(spark.createDataFrame([], "page_id long, url string, html string"))
    assert out.columns == ["page_id", "host", "path", "rule", "verdict", "template", "purity"] and out.collect() == []


def test_url_filters_without_python(spark):
    plan = urlfilter.judge(spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
