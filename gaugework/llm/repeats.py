"""Repeated byte strings, by a depth-limited most-significant-digit sort of suffixes.

A suffix matters only to its first 400 bytes, and two suffixes that agree that far also agree on
where the smallest hashed 32-byte string within them lies. So suffixes are first keyed by that
string (the first digit), which stands for all suffixes around it: an *anchor* with the range of
distances at which suffixes before it start. A pass orders the entries by their digit and splits
equal ones by the whole stretch that their suffixes cover:

* a digit that occurs once ends: none of its suffixes repeats;
* a stretch that occurs twice or more is done: all of its suffixes repeat;
* a digit with several stretches goes on to the next pass, one entry for each stretch, with its
  range of distances cut in blocks and the bytes common to a block's suffixes as longer digit.

In the last pass a block is one suffix and its digit all 400 bytes, so that equal groups are
exactly the repeated windows. Each pass is an aggregation by (digit, stretch) with combining in
the tasks that read, so frequent passages meet as counts and not as rows. Digits and stretches are
compared by 64-bit hashes.

Defined cases. Null and empty texts have no bytes. Rows that repeat a document are further
places where its strings start. A null doc_id is kept. Extra columns pass through; one named like
a result is replaced by it.

Of a textbook radix sort two things differ: the digits are hashes of stretches of bytes and the
first one is taken at the anchor, not at the suffix's own start, so that a suffix is an entry of its
own only where its surroundings repeat; and equal digits meet by grouping, since only equality, not
the order of the groups, decides what repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm import texthash as th
from gaugework.llm.store import extended, join_frequent_apart, settle, without

LENGTH, GRAM = 400, 32
#: Block widths of the passes; the first is a whole range of distances.
WIDTHS = (48, 6, 1)
#: Texts are worked on in segments of this many suffixes.
SEGMENT = 1 << 19
RESULTS = ("n_bytes", "n_removed", "spans", "kept", "kept_sha256")
_UNIT = "a bigint, lo int, hi int"
_OUT = pa.schema([("rid", pa.int64()), ("row", pa.int64()), ("a", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("digit", pa.int64()), ("stretch", pa.int64())])
_OUT_SQL = f"rid bigint, row bigint, {_UNIT}, digit bigint, stretch bigint"


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` values, by block-wise prefix and suffix minima."""
    n = len(v)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def _anchors(text: np.ndarray, length: int, gram: int):
    """(anchor, lo, hi, first digit, stretch): lo..hi are the distances from suffix to anchor."""
    for begin in range(0, len(text) - length + 1, SEGMENT):
        part = text[begin : begin + SEGMENT + length - 1]
        win = th.Windows(part)
        at = np.arange(len(part) - gram + 1)
        h = win.of(at, at + gram)
        low = _sliding_min((h & th.U(0xFFFFFFFFFF000000)) | at.astype(np.uint64), length - gram + 1)
        anchor = (low & th.U(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        last = np.append(first[1:], len(anchor)) - 1
        a = anchor[first]
        lo, hi = a - last, a - first
        stretch = th.mix(win.of(a - hi, a - lo + length) + (lo * 1024 + hi).astype(np.uint64))
        yield a + begin, lo, hi, h[a], stretch


def _first_pass(length: int, gram: int):
    def run(batches):
        for batch in batches:
            raw, offs = th.text_bytes(batch.column("text"))
            rid, row = batch.column("rid").to_numpy(), batch.column("row").to_numpy()
            for i in range(batch.num_rows):
                text = raw[offs[i] : offs[i + 1]]
                for a, lo, hi, digit, stretch in _anchors(text, length, gram) if len(text) >= length else ():
                    n = len(a)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, rid[i])), pa.array(np.full(n, row[i])), pa.array(a), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(th.signed(digit)), pa.array(th.signed(stretch))],
                        schema=_OUT,
                    )

    return run


def _merged(run, rows: int = 20_000):
    """Output batches of some size instead of one for each text."""

    def out(batches):
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return out


def _next_pass(width: int, length: int):
    """Entries cut into blocks of distances k*width .. (k+1)*width-1."""

    def run(batches):
        for batch in batches:
            raw, offs = th.text_bytes(batch.column("text"))
            rid, row = batch.column("rid").to_numpy(), batch.column("row").to_numpy()
            for i, units in enumerate(batch.column("units").to_pylist()):
                a0, lo0, hi0 = (np.array([u[k] for u in units], np.int64) for k in ("a", "lo", "hi"))
                first, last = lo0 // width, hi0 // width
                per = last - first + 1
                a, k = np.repeat(a0, per), np.repeat(first, per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
                b0, b1 = k * width, (k + 1) * width - 1
                lo, hi = np.maximum(np.repeat(lo0, per), b0), np.minimum(np.repeat(hi0, per), b1)
                text = raw[offs[i] : offs[i + 1]]
                base = int((a - hi).min())
                win = th.Windows(text[base : int((a - lo).max()) + length])
                digit = th.mix(win.of(a - b0 - base, a - b1 + length - base) + k.astype(np.uint64)) if width > 1 else None
                # The bytes that all suffixes of a block share may start behind the text's first entry, never before it.
                stretch = th.mix(win.of(a - hi - base, a - lo + length - base) + (lo * 1024 + hi).astype(np.uint64))
                digit = stretch if digit is None else digit
                n = len(a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, rid[i])), pa.array(np.full(n, row[i])), pa.array(a), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(th.signed(digit)), pa.array(th.signed(stretch))],
                    schema=_OUT,
                )

    return run


def repeated_stretches(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, widths=WIDTHS) -> DataFrame:
    """rid, row, begin, end: stretches of bytes of which every part lies in a repeated string of ``length`` bytes.

    ``docs`` has rid and row (together one for each different row) and text.
    """
    entries = settle(docs.mapInArrow(th.in_pieces(_merged(_first_pass(length, gram))), _OUT_SQL))
    texts, done = docs, None
    for width in (*widths, None):
        grouped = entries.groupBy("digit", "stretch").agg(F.count("*").alias("c"), F.min(F.struct("rid", "row", "a", "lo", "hi")).alias("one"))
        grouped = settle(grouped)
        twice = grouped.where("c > 1").select("digit", "stretch", F.col("c").alias("_count"))
        repeated = join_frequent_apart(entries, twice, ["digit", "stretch"], entries.count())
        repeated = repeated.select("rid", "row", (F.col("a") - F.col("hi")).alias("begin"), (F.col("a") - F.col("lo") + length).alias("end"))
        done = repeated if done is None else done.union(repeated)
        if width is None:
            return done
        split = grouped.groupBy("digit").agg(F.count("*").alias("m")).where("m > 1").select("digit")
        going = grouped.join(split, "digit", "left_semi").select("one.*")
        units = settle(going.groupBy("rid", "row").agg(F.collect_list(F.struct("a", "lo", "hi")).alias("units")))
        if texts is docs:
            texts = settle(docs.select("rid", "row", "text").join(units.select("rid", "row"), ["rid", "row"]).dropDuplicates(["rid", "row"]))
        entries = settle(texts.join(units, ["rid", "row"]).mapInArrow(th.in_pieces(_merged(_next_pass(width, length))), _OUT_SQL))


def _cut(batches):
    """Texts without the bytes of their stretches."""
    for batch in batches:
        raw, offs = th.text_bytes(batch.column("text"))
        out = {"n_bytes": np.diff(offs), "n_removed": [], "spans": [], "kept": []}
        for i, cuts in enumerate(batch.column("_cuts").to_pylist()):
            text = raw[offs[i] : offs[i + 1]]
            edge = np.zeros(len(text) + 1, np.int64)
            for c in cuts or ():
                edge[c["begin"]] += 1
                edge[c["end"]] -= 1
            gone = np.concatenate(([False], np.cumsum(edge)[:-1] > 0, [False]))
            turn = np.flatnonzero(gone[1:] != gone[:-1])
            out["n_removed"].append(int(gone.sum()))
            out["spans"].append(turn.tolist())
            out["kept"].append(text[~gone[1:-1]].tobytes())
        keep = [c for c in batch.schema.names if c not in ("_rid", "_row", "_cuts")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), pa.array(out["n_bytes"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["spans"], pa.list_(pa.int64())), pa.array(out["kept"], pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in out["kept"]])],
            names=[*keep, "n_bytes", "n_removed", "spans", "kept", "kept_sha256"],
        )


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with n_bytes, n_removed, spans (begin and end of each removed run, in turn), kept (bytes) and its hash."""
    docs = without(docs, (*RESULTS, "_rid", "_row", "_cuts"))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns({"_rid": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "_row": F.xxhash64(text)})
    gram = min(GRAM, max(1, length // 4))
    found = settle(repeated_stretches(keyed.select(F.col("_rid").alias("rid"), F.col("_row").alias("row"), "text"), length, gram))
    cuts = found.groupBy(F.col("rid").alias("_rid"), F.col("row").alias("_row")).agg(F.collect_set(F.struct("begin", "end")).alias("_cuts"))
    out = extended(docs, "n_bytes long, n_removed long, spans array<long>, kept binary, kept_sha256 string")
    return keyed.join(cuts, ["_rid", "_row"], "left").select(*docs.columns, "_rid", "_row", "_cuts").mapInArrow(th.in_pieces(_cut), out)


def repeats_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    done = remove_repeats(docs.select("doc_id", "text"), length)
    return done.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), "kept_sha256")


#: Every start of a string of 400 bytes by its MD5, in chunks of 2,000 starts; bytes are pairs of hexadecimal digits.
ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, j, substr(x, 4000 * j + 1, 4798) AS y FROM (SELECT doc_id, x, unnest(range(0, len(x) // 4000 + 1)) AS j FROM d WHERE len(x) >= 800)),
s AS (
  SELECT doc_id, 2000 * j + i AS i, md5(substr(y, 2 * i + 1, 800)) AS m
  FROM (SELECT doc_id, j, y, unnest(range(0, least(2000, len(y) // 2 - 399))) AS i FROM c WHERE len(y) >= 800)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS c FROM s) WHERE c > 1),
b AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= 400 THEN 0 ELSE 1 END AS f FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, i, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM b),
span AS (SELECT doc_id, k, min(i) AS lo, max(i) + 400 AS hi FROM n GROUP BY doc_id, k),
part AS (
  SELECT doc_id, coalesce(lag(hi) OVER w, 0) AS lo, lo AS hi FROM span WINDOW w AS (PARTITION BY doc_id ORDER BY lo)
  UNION ALL
  SELECT d.doc_id, coalesce(max(hi), 0), len(any_value(x)) // 2 FROM d LEFT JOIN span USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS y FROM part JOIN d USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(hi - lo) AS removed, count(*) AS spans FROM span GROUP BY doc_id)
SELECT d.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(y)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
