"""Line dedup: lines that many documents share stay only in the last of them.

Method: explode normalised lines, hash, count distinct documents per hash, drop lines over
the threshold, and reassemble by position.

Defined cases. Null or empty text is one empty line. A document with a null id keeps all its
lines and does not count. Repeated rows of one id are one document: they count once, and all
of them keep or lose the same lines. Extra columns pass through, whatever their names; none of
them is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.store import BROADCAST_ROWS, join_frequent_apart, set_aside, settle, without

BLANKS = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OWN = ("_id", "_row", "_drop", "_lines", "_kept")


def line_key(line):
    """A line without outer blanks, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), _UPPER, _LOWER)


def lines_of(text: str = "text") -> Column:
    """All lines of a text."""
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def shared_positions(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, _row (a hash of the text) and _drop: the positions, from 0, of the lines that a document loses; only documents that lose some.

    Lines travel as two 64-bit hashes, written once and read for the count and for the join.
    """
    # The hash of a text is taken before its lines part: beside a generator it would be taken for each of them.
    whole = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_row"), lines_of(text).alias("_lines"))
    lines = settle(
        whole.select("_id", "_row", F.posexplode(F.transform("_lines", line_key)).alias("_pos", "_key"))
        .where(F.length("_key") >= min_chars)
        .select("_id", "_row", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(7), "_key").alias("_h2"))
    )
    # One row for each line and document first: the count of distinct documents is then a plain one, combined in the tasks that read.
    held = lines.groupBy("_h1", "_h2", "_id").agg(F.count("*").alias("_n"))
    shared = held.groupBy("_h1", "_h2").agg(F.count("*").alias("_docs"), F.max("_id").alias("_keep"), F.sum("_n").alias("_count"))
    shared = settle(shared.where(F.col("_docs") >= min_docs).select("_h1", "_h2", "_keep", "_count"))
    if shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        met = lines.join(F.broadcast(shared), ["_h1", "_h2"])
    else:
        met = join_frequent_apart(lines, shared, ["_h1", "_h2"], lines.count())
    return met.where("_id <> _keep").groupBy("_id", "_row").agg(F.collect_set("_pos").alias("_drop"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one more column, ``_drop`` (positions of the lines to drop, from 0; null for none). Texts are shuffled once, to meet it.

    Columns of this and the other names in ``_OWN`` are replaced; ``drop_shared_lines`` hands them on.
    """
    docs = without(docs, _OWN)
    drop = shared_positions(docs, min_chars, min_docs, doc_id, text)
    here = (F.col(doc_id) == F.col("_id")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("_row"))
    return docs.join(drop, here, "left").drop("_id", "_row")


def with_kept(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` of ``dedup_lines`` with ``_lines`` and ``_kept``: the lines that stay, joined again, in time linear in their number."""
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_drop")
    kept = F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")
    return docs.withColumn("_lines", lines_of(text)).withColumn("_kept", F.when(F.col("_drop").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(kept))


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the hash of what is kept."""
    return with_kept(dedup_lines(docs.select("doc_id", "text"))).select(
        "doc_id",
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )


def drop_shared_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the shared lines gone from the texts and n_chars to match."""
    docs, back = set_aside(docs, _OWN)
    lost = F.col("_drop").isNotNull()
    done = with_kept(dedup_lines(docs))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(lost, F.length("_kept").cast("long")).otherwise(F.col("n_chars")))
    return done.withColumn("text", F.when(lost, F.col("_kept")).otherwise(F.col("text"))).select(back)


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
shared AS (
  SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT d.doc_id, d.line, d.pos, s.k IS NOT NULL AND d.doc_id <> s.keep AS gone
  FROM keyed d LEFT JOIN shared s ON d.k = s.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
