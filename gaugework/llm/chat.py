"""Chat formatting after cumulative-snapshot collapse.

Logs often hold a conversation again each time it grows. Every turn gets a hash of its role,
text and place; the exclusive or of these over the turns so far is the hash of a turn prefix.
A conversation whose whole hash is a proper prefix of another's goes (an anti-join), as do all
but the smallest id of equal conversations; the rest are rendered.

Turns are dealt by ranges of conversation and place, so that a conversation that holds a large
share of all rows is the work of many tasks. Places and hashes are counted within a range; what a
conversation has in earlier ranges is added by a broadcast. A range begins within at most one
conversation, so that this side has at most two rows a range. Such a conversation is rendered in
one piece a range, and the pieces are joined; the result has one text a conversation all the same.

Defined cases. Turns are ordered by turn, nulls first, and those of one number by the SHA-256 of
role and text; a null role or text is empty in the rendering but differs from an empty one in
comparisons. Rows with a null conv_id form one conversation. Repeated rows are repeated turns.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.store import join_frequent_apart, settle

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _marked(c: str) -> Column:
    """A text that tells null from empty."""
    return F.coalesce(F.concat(F.lit(c[0]), c), F.lit(""))


def _order() -> Column:
    """What orders the turns of one number."""
    return F.sha2(F.concat_ws("\x00", _marked("role"), _marked("text")), 256)


def _same(a: str, b: str, *names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out &= F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return out


def prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, n (turns so far), h1 and h2 (128 bits of the prefix), size (turns in all), without texts; and the pieces
    of conversations in several ranges: conv_id, part, before (turns in earlier ranges), whole (turns in all) and from
    (turn and order of the first turn in the range)."""
    hashed = turns.select("conv_id", "turn", F.xxhash64(_marked("role"), _marked("text")).alias("k1"), F.xxhash64(F.lit(7), _marked("role"), _marked("text")).alias("k2"), _order().alias("o"), F.monotonically_increasing_id().alias("tie"))
    ranged = settle(settle(hashed).repartitionByRange("conv_id", "turn", "o", "tie").withColumn("part", F.spark_partition_id()))
    conv = Window.partitionBy("conv_id")
    earlier = conv.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("here"), F.min(F.struct("turn", "o")).alias("from"))
    pieces = pieces.select("conv_id", "part", "from", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"), F.sum("here").over(conv).alias("whole"), F.count("*").over(conv).alias("parts"))
    pieces = settle(pieces.where("parts > 1").drop("parts"))
    known = ranged.alias("r").join(F.broadcast(pieces.alias("p")), _same("r", "p", "conv_id", "part"), "left").select("r.*", "before", "whole")
    piece = Window.partitionBy("conv_id", "part")
    order = piece.orderBy(F.col("turn").asc_nulls_first(), "o", "tie")
    placed = known.withColumn("n", F.row_number().over(order) + F.coalesce("before", F.lit(0)))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = settle(placed.select(
        "conv_id",
        "part",
        "n",
        F.bit_xor(F.xxhash64("n", "k1", "k2")).over(so_far).alias("h1"),
        F.bit_xor(F.xxhash64("k2", "n", "k1")).over(so_far).alias("h2"),
        F.coalesce("whole", F.count("*").over(piece)).alias("size"),
        F.col("whole").isNotNull().alias("split"),
    ))
    ends = placed.where("split").groupBy("conv_id", "part").agg(F.max_by("h1", "n").alias("h1"), F.max_by("h2", "n").alias("h2"))
    carried = ends.select("conv_id", "part", F.bit_xor("h1").over(earlier).alias("c1"), F.bit_xor("h2").over(earlier).alias("c2"))
    both = placed.alias("r").join(F.broadcast(carried.alias("c")), _same("r", "c", "conv_id", "part"), "left")
    zero = F.lit(0).cast("long")
    return both.select("r.conv_id", "n", F.col("h1").bitwiseXOR(F.coalesce("c1", zero)).alias("h1"), F.col("h2").bitwiseXOR(F.coalesce("c2", zero)).alias("h2"), "size"), pieces


def maximal(all_prefixes: DataFrame) -> DataFrame:
    """conv_id and size of the conversations that no other continues or repeats."""
    whole = all_prefixes.where("n = size").groupBy("n", "h1", "h2").agg(F.min(F.struct(F.col("conv_id").isNull(), "conv_id")).alias("first"))
    longer = all_prefixes.where("n < size").select("n", "h1", "h2").distinct()
    return whole.join(longer, ["n", "h1", "h2"], "left_anti").select(F.col("first.conv_id").alias("conv_id"), F.col("n").alias("size"))


def _joined(pieces: Column) -> Column:
    """Texts of ``line`` in the order of the other fields."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(pieces)), lambda x: x["line"]), "")


def render(turns: DataFrame, pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns and the rendered conversation; those in ``pieces`` by a text a piece first."""
    text = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE + "\n"))
    lines = turns.select("conv_id", F.struct("turn", _order().alias("o")).alias("at"), text.alias("line"))
    starts = pieces.groupBy("conv_id").agg(F.collect_list("from").alias("starts"))
    known = lines.alias("r").join(F.broadcast(starts.alias("p")), _same("r", "p", "conv_id"), "left").select("r.*", "starts")
    short = known.where("starts IS NULL").groupBy("conv_id").agg(F.count("*").alias("n_turns"), _joined(F.struct("at", "line")).alias("rendered"))
    part = F.size(F.filter("starts", lambda e: e <= F.col("at")))
    by_part = known.where("starts IS NOT NULL").groupBy("conv_id", part.alias("part")).agg(F.count("*").alias("n"), _joined(F.struct("at", "line")).alias("line"))
    return short.unionByName(by_part.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), _joined(F.struct("part", "line")).alias("rendered")))


def format_chats(turns: DataFrame) -> DataFrame:
    """Maximal conversations, rendered."""
    turns = turns.select("conv_id", "turn", "role", "text")
    all_prefixes, pieces = prefixes(turns)
    keys = {"_none": F.col("conv_id").isNull(), "_id": F.coalesce(F.col("conv_id").cast("string"), F.lit(""))}
    keep = settle(maximal(all_prefixes).withColumns(keys).select("_none", "_id", F.col("size").alias("_count")))
    kept = join_frequent_apart(turns.withColumns(keys), keep, ["_none", "_id"], all_prefixes.count()).drop("_none", "_id")
    return render(kept, pieces)


ORACLE = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS size,
         '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS line
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, n, size, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY n) AS s FROM t),
longer AS (SELECT DISTINCT n, s FROM p WHERE n < size)
SELECT min(conv_id) AS conv_id, n AS n_turns, s AS rendered
FROM p WHERE n = size AND NOT EXISTS (SELECT 1 FROM longer l WHERE l.n = p.n AND l.s = p.s)
GROUP BY n, s
"""
