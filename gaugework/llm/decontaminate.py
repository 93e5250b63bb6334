"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ten words (one shorter run if it has fewer). The shingles of
a window are its three-word runs; over the whole corpus the count of each shingle that occurs
in the benchmark is taken, and a window is indexed under its rarest shingle alone: containment
of the whole window needs that one, so a prefix of length one is enough. A document position
that holds an indexed shingle proposes a window at one place (positional bound), which must lie
within the document (length bound) and is then verified word by word.

The benchmark index is broadcast only if it has at most ``MAX_INDEX`` windows; beyond that the
shingles of documents are shuffled to the index and the proposed windows back to the documents.

Defined cases. Null texts, and texts without words, have no words and no hits; items without
words have no window. Repeated items or documents each get their own result; null ids stay null
(a null item_id counts as an item and is listed as an empty string). Extra columns pass through;
of those named like a result, ``find_contamination`` gives the result and ``drop_contaminated``
the column that came.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm import texthash as th
from gaugework.llm.store import extended, set_aside, settle, without

WINDOW, SHINGLE = 10, 3
RESULTS = ("n_words", "n_hit", "items")
#: Windows of ten words of about 100 bytes: some 200 MB at most.
MAX_INDEX = 500_000


def _words(batch):
    raw, offs = th.text_bytes(batch.column("text"))
    return (th._LOWER[raw], *th.words(raw, offs, th.NOT_ALNUM))


def _windows(batches):
    """item_id, window (words joined by a space) and the shingle hashes of each window."""
    for batch in batches:
        raw, starts, ends, doc, hashes = _words(batch)
        data = raw.tobytes()
        rows = {"item_id": [], "words": [], "n": [], "shingles": []}
        ids = batch.column("item_id").to_pylist()
        for i in range(batch.num_rows):
            lo, hi = np.searchsorted(doc, [i, i + 1])
            n = int(hi - lo)
            size = min(WINDOW, n)
            if not n:
                continue
            parts = [data[s:e] for s, e in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)]
            short = th.signed(th.grams(hashes[lo:hi], min(SHINGLE, size))).tolist()
            for j in range(n - size + 1):
                rows["item_id"].append(ids[i])
                rows["words"].append(b" ".join(parts[j : j + size]))
                rows["n"].append(size)
                rows["shingles"].append(short[j : j + size - min(SHINGLE, size) + 1])
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("item_id", batch.schema.field("item_id").type), ("words", pa.binary()), ("n", pa.int32()), ("shingles", pa.list_(pa.int64()))]))


def benchmark_windows(items: DataFrame) -> DataFrame:
    kind = dict(items.dtypes)["item_id"]
    return items.select("item_id", "text").mapInArrow(_windows, f"item_id {kind}, words binary, n int, shingles array<bigint>")


def _shingle_counts(known: np.ndarray):
    """Occurrences in the texts of each hash of ``known`` (sorted)."""

    def run(batches):
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            _, _, _, doc, hashes = _words(batch)
            for n in range(1, SHINGLE + 1):
                if len(hashes) >= n:
                    full = th.grams(hashes, n)[doc[: len(doc) - n + 1] == doc[n - 1 :]]
                    at = np.minimum(np.searchsorted(known, full), len(known) - 1)
                    total += np.bincount(at[known[at] == full], minlength=len(known))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"shingle": th.signed(known[seen]), "n": total[seen]})

    return run


def _prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Each distinct window with its rarest shingle, that one's offset in it, and the items that hold it."""
    w = windows.groupBy("words", "n", "shingles").agg(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("items"))
    each = w.select("words", F.posexplode("shingles").alias("offset", "shingle"))
    ranked = each.join(counts.withColumnRenamed("n", "df"), "shingle", "left")
    first = ranked.groupBy("words").agg(F.min(F.struct(F.coalesce("df", F.lit(0)), "shingle", "offset")).alias("p"))
    return w.join(first, "words").select("words", "n", "items", F.col("p.shingle").alias("shingle"), F.col("p.offset").alias("offset"))


def _verify(raw, starts, ends, doc, lo, hi, start, n, words) -> bool:
    if start < lo or start + n > hi:
        return False
    return words == b" ".join(raw[s:e] for s, e in zip(starts[start : start + n].tolist(), ends[start : start + n].tolist(), strict=True))


def _cover(n_words: int, found) -> int:
    edge = np.zeros(n_words + 1, np.int64)
    for start, n in found:
        edge[start] += 1
        edge[start + n] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


_OUT = "n_words long, n_hit long, items array<string>"


def _scan(index):
    """The documents of each batch against a broadcast index: sorted shingles and, for each, its windows."""

    def run(batches):
        keys, windows = index.value
        for batch in batches:
            low, starts, ends, doc, hashes = _words(batch)
            raw = low.tobytes()
            lo = np.searchsorted(doc, np.arange(batch.num_rows))
            hi = np.searchsorted(doc, np.arange(batch.num_rows), side="right")
            found, items = defaultdict(list), defaultdict(set)
            for n in range(1, SHINGLE + 1):
                if not len(keys) or len(hashes) < n:
                    continue
                full = th.grams(hashes, n)
                at = np.minimum(np.searchsorted(keys, full), len(keys) - 1)
                for p in np.flatnonzero(keys[at] == full).tolist():
                    d = int(doc[p])
                    for words, size, offset, held in windows[int(full[p])]:
                        if min(SHINGLE, size) == n and _verify(raw, starts, ends, doc, lo[d], hi[d], p - offset, size, words):
                            found[d].append((p - offset - int(lo[d]), size))
                            items[d].update(held)
            out = {
                "n_words": hi - lo,
                "n_hit": [_cover(int(hi[d] - lo[d]), found[d]) if d in found else 0 for d in range(batch.num_rows)],
                "items": pa.array([sorted(items.get(d, ())) for d in range(batch.num_rows)], pa.list_(pa.string())),
            }
            kept = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(out["n_words"], pa.int64()), pa.array(out["n_hit"], pa.int64()), out["items"]],
                names=[*batch.schema.names, "n_words", "n_hit", "items"],
            )

    return run


def _positions(batches):
    """Every shingle of every document: row key, word position, hash and its length."""
    for batch in batches:
        _, _, _, doc, hashes = _words(batch)
        lo = np.searchsorted(doc, np.arange(batch.num_rows))
        for n in range(1, SHINGLE + 1):
            if len(hashes) < n:
                continue
            at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row").take(pa.array(doc[at])), pa.array(at - lo[doc[at]]), pa.array(th.signed(th.grams(hashes, n)[at])), pa.array(np.full(len(at), n, np.int32))],
                names=["_row", "pos", "shingle", "k"],
            )


def _check(batches):
    """Documents with the windows proposed for them."""
    for batch in batches:
        low, starts, ends, doc, _ = _words(batch)
        raw = low.tobytes()
        lo = np.searchsorted(doc, np.arange(batch.num_rows))
        hi = np.searchsorted(doc, np.arange(batch.num_rows), side="right")
        hits, items = [], []
        for d, proposed in enumerate(batch.column("_proposed").to_pylist()):
            good = [x for x in proposed or () if _verify(raw, starts, ends, doc, lo[d], hi[d], int(lo[d]) + x["start"], x["n"], x["words"])]
            hits.append(_cover(int(hi[d] - lo[d]), [(x["start"], x["n"]) for x in good]))
            items.append(sorted({i for x in good for i in x["items"]}))
        names = [c for c in batch.schema.names if c not in ("_row", "_proposed")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in names), pa.array(hi - lo, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string()))],
            names=[*names, "n_words", "n_hit", "items"],
        )


def find_contamination(docs: DataFrame, items: DataFrame, max_index: int = MAX_INDEX) -> DataFrame:
    """``docs`` with n_words, n_hit and items (sorted ids, as strings, of the items with a window in the text)."""
    spark = docs.sparkSession
    docs = without(docs, RESULTS)
    windows = settle(benchmark_windows(items))
    size = windows.limit(max_index + 1).count()
    shape = extended(docs, _OUT)
    texts = docs.select(F.col("text"))
    if size <= max_index:
        # At most ``max_index`` windows: their shingle hashes and words come to the driver as Arrow columns.
        own = windows.select(F.explode("shingles").alias("s")).distinct().toArrow()["s"].to_numpy()
        known = np.sort(own.astype(np.int64).view(np.uint64))
        if len(known):
            counts = texts.mapInArrow(th.in_pieces(_shingle_counts(known)), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
        else:
            counts = spark.createDataFrame([], "shingle bigint, n bigint")
        index = defaultdict(list)
        for batch in _prefixes(windows, counts).toArrow().to_batches():
            for r in batch.to_pylist():
                index[r["shingle"] & (2**64 - 1)].append((bytes(r["words"]), r["n"], r["offset"], tuple(r["items"])))
        held = spark.sparkContext.broadcast((np.array(sorted(index), np.uint64), dict(index)))
        return docs.mapInArrow(th.in_pieces(_scan(held)), shape)
    row = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_row")
    keys = docs.select(row, "text").dropDuplicates(["_row"])
    spots = keys.mapInArrow(th.in_pieces(_positions), "_row bigint, pos bigint, shingle bigint, k int")
    counts = spots.groupBy("shingle").agg(F.count("*").alias("n"))
    index = settle(_prefixes(windows, counts)).withColumn("k", F.least("n", F.lit(SHINGLE)))
    proposed = (
        spots.join(index, ["shingle", "k"])
        .where("pos >= offset")
        .groupBy("_row")
        .agg(F.collect_list(F.struct((F.col("pos") - F.col("offset")).alias("start"), "n", "words", "items")).alias("_proposed"))
    )
    put_by = {c: f"_in_{c}" for c in docs.columns if c.lower() in ("_row", "_proposed")}
    keyed = docs.withColumnsRenamed(put_by).withColumn("_row", row)
    found = keyed.join(proposed, "_row", "left").mapInArrow(th.in_pieces(_check), extended(docs.withColumnsRenamed(put_by), _OUT))
    return found.withColumnsRenamed({v: k for k, v in put_by.items()})


def contamination_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = find_contamination(docs.select("doc_id", "text"), items)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no benchmark window occurs."""
    docs, back = set_aside(docs, RESULTS)
    return find_contamination(docs, items).where("n_hit = 0").select(back)


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
spot AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, n, i, item_id FROM spot JOIN win USING (n, s)),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)
"""
