"""Exact n-gram Jaccard join through a token-group matrix, and the classes its links form.

1. Every document becomes its set of hashed five-word shingles. Documents of equal sets form a
   class, which one representative stands for.
2. Similar representatives are partitioned into groups: those that share a band of three MinHash
   values are compared with the smallest of them, and verified links are joined to classes.
   Documents whose most frequent band is held by ``FAMILY`` or more are grouped by it, linked or
   not; other classes are groups; all are cut to about ``GROUP`` documents at most.
3. The matrix holds each group's shingle union. A global order, rarest first, comes from a count
   sketch of fixed size over all documents; a pair at or above the threshold must share one of
   the first ``n - ceil(t n) + 1`` shingles of either side, so those entries of the matrix alone
   propose group pairs (a group with itself, too), and only entries that two classes share. The
   number of entries that two groups share, with the sizes of their documents, bounds the overlap
   of any two of them; pairs of groups below the bound go before any text is read. Documents of
   one class need no look.
4. For a proposed pair each document of one side is bounded by its overlap with the other's union
   and only qualifying groups are opened, document by document, with the exact test.

No pairs are made within a class of copies: links to its representative join them, and nothing
is capped, so no link between different texts is lost.

The matrix holds what a group's union can be found by, its documents' rarest shingles; the whole
union is made where a group is opened, from the texts sent there: as hashes it would be larger
than the texts. Its bound saves the exact test there.

Defined cases. A text without words (or null) has an empty set and links with nothing. Rows
sharing a doc_id are one node of the link graph. A null doc_id links with nothing and has a
null component. Extra columns pass through, whatever their names; none of them is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm import texthash as th
from gaugework.llm.components import components
from gaugework.llm.store import broadcast_if_small, discard, join_frequent_apart, settle

SHINGLE, PERCENT = 5, 80
#: Documents in a group, about, and query groups that one task opens a group for.
GROUP, QUERIES = 64, 16
#: Members of a star that meet the text of its pivot in one place, about.
STAR = 256
#: Documents that hold a band from which on they are grouped by it.
FAMILY = 16
#: Shared matrix entries that a broadcast may hold (16 MB); beyond, a join finds them.
MAX_SHARED = 2_000_000
#: Cells of the count sketch (4 MB) and the slices in which tasks hand it on.
CELLS, SLICES = 1 << 20, 64
#: Bands of three of the MinHash values.
BANDS = ((0, 1, 2), (3, 4, 5), (6, 7, 8), (9, 10, 11), (0, 4, 8), (1, 5, 9))
_ODD = np.random.default_rng(12).integers(1, 1 << 63, 12, dtype=np.uint64) | th.U(1)


def _bands(s: np.ndarray) -> list[int]:
    low = np.array([th.mix(s * o).min() for o in _ODD], np.uint64)
    return th.signed(th.mix(np.array([(low[list(b)] * _ODD[:3]).sum() for b in BANDS], np.uint64))).tolist()


def need(n: int, percent: int) -> int:
    """Least overlap with anything that a set of ``n`` must have."""
    return -(-percent * n // 100)


def _profile(shingle: int):
    """Per text: set size, a 128-bit signature of the set, MinHash bands; per task: its sketch."""

    def run(batches):
        sketch = np.zeros(CELLS, np.int64)
        for batch in batches:
            rows, held = {"doc_id": [], "n": [], "s1": [], "s2": [], "mh": []}, []
            for doc_id, s in zip(batch.column("doc_id").to_pylist(), th.shingle_sets(batch.column("text"), shingle), strict=True):
                rows["doc_id"].append(doc_id)
                rows["n"].append(len(s))
                rows["s1"].append(th.signed(th.mix(s).sum(keepdims=True))[0] if len(s) else 0)
                rows["s2"].append(th.signed(th.mix(s ^ _ODD[0]).sum(keepdims=True))[0] if len(s) else 0)
                rows["mh"].append(_bands(s) if len(s) else [])
                if len(s):
                    held.append(s)
            if held:
                sketch += np.bincount((np.concatenate(held) >> th.U(44)).astype(np.int64), minlength=CELLS)
            yield pa.RecordBatch.from_pydict(rows | {"slice": [None] * len(rows["n"]), "cells": [None] * len(rows["n"])}, schema=_PROFILE)
        if sketch.any():
            parts = sketch.astype(np.uint32).reshape(SLICES, -1)
            none = [None] * SLICES
            yield pa.RecordBatch.from_pydict({"doc_id": none, "n": none, "s1": none, "s2": none, "mh": none, "slice": list(range(SLICES)), "cells": [p.tobytes() for p in parts]}, schema=_PROFILE)

    return run


_PROFILE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("mh", pa.list_(pa.int64())), ("slice", pa.int32()), ("cells", pa.binary())])
_PROFILE_SQL = "doc_id bigint, n bigint, s1 bigint, s2 bigint, mh array<bigint>, slice int, cells binary"


def _add_slices(batches):
    """Sums of the sketch slices in a partition; a slice is 64 KB, so few are held at once."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, b in zip(batch.column("slice").to_pylist(), batch.column("cells"), strict=True):
            part = np.frombuffer(b.as_buffer(), np.uint32).astype(np.uint64)
            total[k] = total[k] + part if k in total else part
    yield pa.RecordBatch.from_pydict({"slice": list(total), "cells": [np.minimum(v, 2**32 - 1).astype(np.uint32).tobytes() for v in total.values()]}, schema=pa.schema([("slice", pa.int32()), ("cells", pa.binary())]))


def _sketch(profile: DataFrame) -> np.ndarray:
    """The whole count sketch: ``CELLS`` numbers whatever the input."""
    parts = profile.where("slice is not null").select("slice", "cells").mapInArrow(_add_slices, "slice int, cells binary")
    rows = parts.repartition(SLICES, "slice").mapInArrow(_add_slices, "slice int, cells binary").collect()
    out = np.zeros((SLICES, CELLS // SLICES), np.uint32)
    for r in rows:
        out[r["slice"]] = np.frombuffer(r["cells"], np.uint32)
    return out.reshape(-1)


def _prefixes(shingle: int, percent: int, counts, wanted=None):
    """The matrix entries a text is found by: its rarest shingles, ties by hash; only ``wanted`` ones if given."""

    def run(batches):
        df = counts.value
        only = None if wanted is None else wanted.value
        for batch in batches:
            sizes, out, full, left = [], [], [], []
            for s in th.shingle_sets(batch.column("text"), shingle):
                p = len(s) - need(len(s), percent) + 1 if len(s) else 0
                token, behind = s, np.zeros(len(s), np.int64)
                if p:
                    rarity = df[(s >> th.U(44)).astype(np.int64)]
                    token = s[np.argsort(rarity, kind="stable")[:p]]
                    behind = len(s) - 1 - np.arange(p)
                    if only is not None:
                        at = np.minimum(np.searchsorted(only, token), len(only) - 1)
                        token, behind = token[only[at] == token], behind[only[at] == token]
                out.append(token)
                left.append(behind)
                sizes.append(len(token))
                full.append(len(s))
            row = np.repeat(np.arange(len(sizes)), sizes)
            token = np.concatenate(out) if out else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(th.signed(token)), *(batch.column(c).take(pa.array(row)) for c in ("gid", "comp", "solo")), pa.array(np.array(full, np.int64)[row]), pa.array(np.concatenate(left) if left else np.zeros(0, np.int64))],
                names=["token", "gid", "comp", "solo", "n", "behind"],
            )

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (small + large - both)


def _verify(shingle: int, percent: int):
    """Keep the pairs (a, b) whose texts reach the threshold."""

    def run(batches):
        last = (None, None)
        for batch in batches:
            keep = []
            b_ids = batch.column("b").to_pylist()
            texts = batch.column("b_text")
            for i, (mine, b) in enumerate(zip(th.shingle_sets(batch.column("a_text"), shingle), b_ids, strict=True)):
                if last[0] != b:
                    last = (b, next(th.shingle_sets(texts.slice(i, 1), shingle)))
                if _linked(mine, last[1], percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    return run


def _open(shingle: int, percent: int):
    """Links between the queries sent to a group and the group's documents of other classes, where the union's bound allows any."""

    def run(queries: pa.Table, members: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if members.num_rows and queries.num_rows:
            ids, comps = (members.column(c).to_numpy() for c in ("doc_id", "comp"))
            sets = list(th.shingle_sets(members.column("text"), shingle))
            sizes = np.array([len(m) for m in sets])
            # A doc_id may have texts without words beside others.
            ids, comps, sets, sizes = ids[sizes > 0], comps[sizes > 0], [m for m in sets if len(m)], sizes[sizes > 0]
        if members.num_rows and queries.num_rows and len(sets):
            union = np.unique(np.concatenate(sets))
            place = np.searchsorted(union, np.concatenate(sets))
            begin = np.cumsum(sizes) - sizes
            for q, comp, s in zip(queries.column("q").to_pylist(), queries.column("q_comp").to_pylist(), th.shingle_sets(queries.column("q_text"), shingle), strict=True):
                at = np.minimum(np.searchsorted(union, s), len(union) - 1)
                hit = at[union[at] == s]
                if len(hit) < need(len(s), percent):
                    continue
                inside = np.zeros(len(union), np.int64)
                inside[hit] = 1
                both = np.add.reduceat(inside[place], begin)
                good = (comps != comp) & (100 * both >= percent * (sizes + len(s) - both))
                found += [(q, d) for d in ids[good].tolist()]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return run


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the ids of a settled table, one row for each id."""
    return docs.join(broadcast_if_small(ids), "doc_id").select("doc_id", "text")


def jaccard_classes(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) for each row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = settle(docs.mapInArrow(th.in_pieces(_profile(shingle)), _PROFILE_SQL))
    rows = profile.where("slice is null").select("doc_id", "n", "s1", "s2", "mh")
    counts = spark.sparkContext.broadcast(_sketch(profile))
    alive = rows.where("n > 0 and doc_id is not null")

    classes = settle(alive.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("mh").alias("mh")))
    total = profile.count()
    copied = classes.where("copies > 1").select("s1", "s2", "n", "rep", F.col("copies").alias("_count"))
    copies = settle(join_frequent_apart(alive.select("s1", "s2", "n", "doc_id"), copied, ["s1", "s2", "n"], total).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))

    # Groups of similar representatives: stars around the smallest holder of each MinHash band.
    hashed = classes.select("rep", F.posexplode("mh").alias("k", "h"))
    pivots = settle(hashed.groupBy("k", "h").agg(F.min("rep").alias("b"), F.count("*").alias("_count")).where("_count > 1"))
    stars = settle(join_frequent_apart(hashed, pivots, ["k", "h"], len(BANDS) * total).where("rep <> b").select(F.col("rep").alias("a"), "b").distinct())
    ids = settle(stars.select(F.col("a").alias("doc_id")).union(stars.select("b")).distinct())
    texts = settle(_texts(docs, ids))
    # A pivot of many members comes once for every STAR of them, so that its text is no key of one task.
    arms = stars.groupBy("b").agg(F.ceil(F.count("*") / STAR).cast("int").alias("arms"), F.count("*").alias("_count"))
    dealt = join_frequent_apart(stars, settle(arms), ["b"], stars.count()).select("a", "b", F.pmod(F.xxhash64("a"), F.col("arms")).cast("int").alias("arm"))
    centres = texts.join(arms.select(F.col("b").alias("doc_id"), "arms"), "doc_id").select(F.col("doc_id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("arms") - 1)).alias("arm"), F.col("text").alias("b_text"))
    near = (
        dealt.join(centres, ["b", "arm"])
        .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), "a")
        .select("a", "b", "a_text", "b_text")
    )
    near = settle(near.mapInArrow(th.in_pieces(_verify(shingle, percent), "a_text"), "a bigint, b bigint").distinct())
    linked = settle(components(near))

    # Groups; copies (not the representatives) stay out of the matrix.
    cut = lambda key, held: F.xxhash64(*key, F.pmod(F.xxhash64("doc_id"), F.ceil(held * 2 / GROUP)))
    held = pivots.where(F.col("_count") >= FAMILY).select("k", "h", F.col("_count").alias("held"), "_count")
    family = join_frequent_apart(hashed, held, ["k", "h"], len(BANDS) * total).groupBy("rep").agg(F.max(F.struct("held", "k", "h")).alias("f")).select(F.col("rep").alias("doc_id"), "f.*")
    sizes = linked.groupBy("component").agg(F.count("*").alias("c"))
    grouped = linked.join(sizes, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("comp"), "c").join(family, "doc_id", "full_outer")
    gid = F.when(F.col("held").isNotNull(), cut(("k", "h"), F.col("held"))).when(F.col("c") > GROUP, cut(("comp",), F.col("c"))).otherwise(F.col("comp"))
    grouped = grouped.select("doc_id", F.coalesce("comp", "doc_id").alias("comp"), gid.alias("gid"))
    # A doc_id of several texts is no single document, either.
    several = alive.groupBy("doc_id").agg(F.count_distinct("s1", "s2", "n").alias("c")).where("c > 1")
    several = several.join(grouped, "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("comp"), F.col("doc_id").alias("gid"))
    known = settle(grouped.unionByName(several).withColumn("out", F.lit(False)).unionByName(copies.select(F.col("a").alias("doc_id"), F.lit(None).cast("long").alias("comp"), F.lit(None).cast("long").alias("gid"), F.lit(True).alias("out")).distinct()))
    placed = (
        docs.where("doc_id is not null")
        .join(broadcast_if_small(known), "doc_id", "left")
        .where("out is null or not out")
        .select("doc_id", "text", F.coalesce("comp", "doc_id").alias("comp"), F.col("gid").isNull().alias("solo"), F.coalesce("gid", "doc_id").alias("gid"))
    )

    matrix_sql = "token bigint, gid bigint, comp bigint, solo boolean, n bigint, behind bigint"
    matrix = placed.select("gid", "comp", "solo", "text").mapInArrow(th.in_pieces(_prefixes(shingle, percent, counts)), matrix_sql)
    shared = matrix.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    shared = settle(shared)
    n_shared = shared.limit(MAX_SHARED + 1).count()
    if not n_shared:
        entries = spark.createDataFrame([], matrix_sql)
    elif n_shared <= MAX_SHARED:
        wanted = spark.sparkContext.broadcast(np.sort(shared.toArrow()["token"].to_numpy().view(np.uint64)))
        entries = placed.select("gid", "comp", "solo", "text").mapInArrow(th.in_pieces(_prefixes(shingle, percent, counts, wanted)), matrix_sql)
    else:
        entries = matrix.join(shared, "token")
    entries = settle(entries.groupBy("token", "gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("behind").alias("behind"), F.bool_and("solo").alias("solo")))
    sizes = entries.groupBy("gid").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    # The groups of a frequent token are dealt over several tasks, one for every STAR of them; pairs whose documents with
    # this token differ too much in size are not made.
    spread = entries.groupBy("token").agg(F.ceil(F.count("*") / STAR).cast("int").alias("arms"), F.count("*").alias("_count"))
    spread = join_frequent_apart(entries, settle(spread), ["token"], entries.count())
    here, there = spread.withColumn("arm", F.pmod(F.xxhash64("gid"), F.col("arms")).cast("int")), spread.withColumn("arm", F.explode(F.sequence(F.lit(0), F.col("arms") - 1)))
    other = "x.gid <= y.gid and not (x.lo = x.hi and x.lo = y.lo and x.lo = y.hi)"
    fit = f"100 * x.most >= {percent} * y.least and 100 * y.most >= {percent} * x.least"
    met = (
        here.alias("x")
        .join(there.alias("y"), F.expr(f"x.token = y.token and x.arm = y.arm and {other} and {fit}"))
        .groupBy(F.col("x.gid").alias("x"), F.col("y.gid").alias("y"))
        .agg(F.count("*").alias("c"), F.min("x.behind").alias("bx"), F.min("y.behind").alias("by"), F.bool_and(F.col("x.solo") & F.col("y.solo")).alias("solo"), F.max("x.most").alias("nx"), F.max("y.most").alias("ny"))
    )
    # Documents that share c prefix entries share no more than those and what is behind the last of them. For groups
    # of several documents only their sizes are known: with m <= n, m >= t n the overlap is less than c + t n + 1.
    t = percent / 100
    nx, ny = F.col("nx"), F.col("ny")
    one_each = met.where(F.col("solo") & (nx >= t * ny) & (ny >= t * nx) & (F.col("c") + F.least("bx", "by") + 1e-6 >= t / (1 + t) * (nx + ny))).select("x", "y")
    more = met.where("not solo").select("x", "y", "c")
    more = more.join(sizes.select(F.col("gid").alias("x"), F.col("least").alias("x0"), F.col("most").alias("x1")), "x")
    more = more.join(sizes.select(F.col("gid").alias("y"), F.col("least").alias("y0"), F.col("most").alias("y1")), "y")
    small, large = F.least("x0", "y0"), F.greatest("x1", "y1")
    fits = (F.col("x1") >= t * F.col("y0")) & (F.col("y1") >= t * F.col("x0"))
    more = more.where(fits & ((large * t >= small) | (F.col("c") + t * large + 1 >= t / (1 + t) * (small + large)))).select("x", "y")
    pairs = settle(one_each.union(more))

    involved = pairs.select(F.col("x").alias("gid")).union(pairs.select("y")).distinct()
    placed_ids = known.where("not out").select("doc_id", "gid", "comp")
    members = placed_ids.join(involved, "gid")
    alone = involved.join(placed_ids.select("gid").distinct(), "gid", "left_anti").select(F.col("gid").alias("doc_id"), "gid", F.col("gid").alias("comp"))
    members = settle(members.select("doc_id", "gid", "comp").union(alone).distinct())
    texts = settle(docs.join(broadcast_if_small(members), "doc_id"))
    load = settle(pairs.groupBy("y").agg(F.count("*").alias("c"), F.count("*").alias("_count")))
    part = F.ceil(F.col("c") / QUERIES)
    salted = settle(join_frequent_apart(pairs, load, ["y"], pairs.count()).select("x", "y", part.alias("parts"), F.pmod(F.xxhash64("x"), part).alias("salt")))
    asked = salted.select(F.col("x").alias("gid"), "y", "salt").join(texts.select("gid", F.col("doc_id").alias("q"), F.col("comp").alias("q_comp"), F.col("text").alias("q_text")), "gid").select("y", "salt", "q", "q_comp", "q_text")
    opened = salted.select(F.col("y").alias("gid"), "parts").distinct().join(texts, "gid").select("gid", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), "doc_id", "comp", "text")
    links = asked.groupBy("y", "salt").cogroup(opened.groupBy("gid", "salt")).applyInArrow(_open(shingle, percent), "a bigint, b bigint")

    final = settle(components(settle(links.distinct()).union(near).union(copies)))
    return (
        rows.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    )


def keep_one_of_each(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """The row of the smallest doc_id of each class. Rows that repeat that id are the same document and come once: the
    one of smallest text, then of smallest JSON."""
    gone = settle(jaccard_classes(docs, percent, shingle).where("component_id <> doc_id").select("doc_id").distinct())
    kept = docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(docs.columns)
    twice = settle(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"))
    if twice.isEmpty():
        return kept
    row = F.struct(*docs.columns)
    once = kept.join(twice, "doc_id", "left_semi").select(F.col("doc_id").alias("_id"), F.struct("text", F.to_json(row).alias("j")).alias("o"), row.alias("r"))
    once = once.groupBy("_id").agg(F.min_by("r", "o").alias("r")).select("r.*")
    return kept.join(twice, "doc_id", "left_anti").select(docs.columns).union(once.select(docs.columns))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT x, y FROM inter JOIN size p ON x = p.doc_id JOIN size q ON y = q.doc_id WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION
  SELECT reach.doc_id, both_ways.y FROM reach JOIN both_ways ON reach.r = both_ways.x)
SELECT d.doc_id, coalesce(size.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN size USING (doc_id) JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id) m ON d.doc_id = m.doc_id
"""
