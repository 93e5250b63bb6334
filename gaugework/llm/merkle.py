"""Merkle manifest of a table of documents, and a proof for each of its rows.

Method: recursive-CTE climb. The levels of the tree are built bottom-up and stored as rows of runs
(up to eight consecutive nodes), each linked to its parent. A recursive query of Spark SQL then
ascends from every leaf: each step joins the parent's row, appends the siblings to the proof and
folds the digest that was recomputed from the tampered document, until no parent is left. Leaves of
one run share all siblings but their own, so that a row of the climb holds one run: its shared
siblings once, and a folded digest for each of its leaves.

Digests are kept as 32 bytes and hashed as lower-case hex text. Leaves are placed by ranges with
offsets, so that a language with most rows is the work of many tasks. A row of the climb meets its
parent by a broadcast for those upper levels that together have at most ``BROADCAST_RUNS`` runs (by
count); below them by a shuffle, where no parent is above more than eight to the number of lower
levels of rows.

Defined cases. A null in any column is hashed as ``-``. A null doc_id comes first in its language
and is not tampered with; rows that repeat a doc_id are ordered by their leaf, and rows alike in all
columns are leaves side by side. A null lang is a language of its own, before all others; an empty
one is another. An empty table has no rows. Columns beyond the five are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.store import broadcast_if_small, join_frequent_apart, settle

#: Nodes of a run.
ARITY = 8
#: Runs of upper levels that are broadcast; each has a few hundred bytes.
BROADCAST_RUNS = 50_000
#: Every document whose crc32 of the id is divisible by this is tampered with.
TAMPERED = 3
#: The tree over the languages' roots, and its lowest level; the languages' trees and levels are numbered from 0.
TOP, TOP_LEVEL = -1, 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _h(digests: Column) -> Column:
    """H of concatenated 32-byte digests, as 32 bytes."""
    return F.unhex(F.sha2(F.lower(F.hex(digests)), 256))


def _text(digest) -> Column:
    return F.lower(F.hex(digest))


def _part(value: Column) -> Column:
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(doc_id, source, lang, n_chars, text) -> Column:
    """The leaf of a document, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*(_part(c) for c in (doc_id, source, lang, n_chars, text))), 256))


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text, with A-Z in lower case where the document is tampered with."""
    hit = F.crc32(doc_id.cast("string").cast("binary")) % TAMPERED == 0
    return F.when(hit, F.translate(text, _UPPER, _LOWER)).otherwise(text)


def leaves(docs: DataFrame) -> DataFrame:
    """lang, doc_id, leaf and forged (the leaf of the tampered document)."""
    c = {n: F.col(n) for n in ("doc_id", "source", "lang", "n_chars", "text")}
    forged = {**c, "text": tampered_text(c["doc_id"], c["text"])}
    return docs.select("lang", F.col("doc_id").cast("long").alias("doc_id"), leaf_of(**c).alias("leaf"), leaf_of(**forged).alias("forged"))


def placed(df: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(``df`` with ``_p`` and ``_i``, ``_p`` and ``keys`` with ``_first``): a row's place among those of its keys, from 0, is ``_i + _first``.

    Rows are dealt by ranges of keys and order; the second table has a row for each range and keys that meet in it.
    ``df`` should be a settled table: rows alike are told apart by their place in it.
    """
    ranges = df.withColumn("_n", F.monotonically_increasing_id()).repartitionByRange(*keys, *order, "_n").sortWithinPartitions(*keys, *order, "_n")
    own = (1 << 33) - 1
    rows = settle(ranges.select(*df.columns, F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit(own)).alias("_i")))
    cuts = rows.groupBy("_p", *keys).agg(F.min("_i").alias("_low"), F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.withColumn("_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_low"))
    return rows, settle(cuts)


def _side_by_side(nodes: Column) -> Column:
    """The digests (``hash``) of a sorted array of nodes, one after the other."""
    return F.aggregate(nodes, F.lit(b""), lambda acc, k: F.concat(acc, k["hash"]))


def _left(kids, slot) -> Column:
    return F.substring(kids, F.lit(1), slot * 32)


def _right(kids, slot) -> Column:
    return F.substring(kids, slot * 32 + 33, F.lit(32 * ARITY))


def _build(first: DataFrame, widest: int) -> tuple[list[DataFrame], DataFrame]:
    """(settled tables of runs above ``first``, lowest first; tree and hash of every root).

    ``first`` has the lowest runs: tree, n (nodes of that tree at this level), run and kids; ``widest`` is the largest n.
    The number of steps is its logarithm. A tree of one node is its own root.
    """
    above, roots, runs = [], first.where("n = 1").select("tree", F.col("kids").alias("hash")), first
    while widest > 1:
        widest = -(-widest // ARITY)
        nodes = runs.where("n > 1").select("tree", F.ceil(F.col("n") / ARITY).cast("long").alias("n"), F.col("run").alias("idx"), _h(F.col("kids")).alias("hash"))
        runs = settle(_packed(nodes).select("tree", "n", "run", _side_by_side(F.col("nodes")).alias("kids")))
        roots = roots.unionByName(runs.where("n = 1").select("tree", F.col("kids").alias("hash")))
        above.append(runs)
    return above, roots


def _packed(nodes: DataFrame) -> DataFrame:
    """One row (tree, n, run, nodes) for each run of ``nodes`` (tree, n, idx, hash and more), in order, numbered by slot."""
    rest = [c for c in nodes.columns if c not in ("tree", "n", "idx")]
    row = F.struct((F.col("idx") % ARITY).cast("int").alias("slot"), *rest)
    return nodes.groupBy("tree", "n", _up("idx").alias("run")).agg(F.sort_array(F.collect_list(row)).alias("nodes"))


def _up(idx: str) -> Column:
    return F.floor(F.col(idx) / ARITY).cast("long")


def _parent(level: int, base: int, langs: int) -> Column:
    """The address of a run's parent: tree, level and run, and the slot in it; null at the root. For rows with tree, n and run of a level."""
    inner, top = F.col("n") > ARITY, (F.col("tree") != TOP) & F.lit(langs > 1)

    def way(a, b):
        return F.when(inner, a).when(top, b)

    return F.struct(
        way(F.col("tree"), F.lit(TOP).cast("long")).alias("tree"),
        way(F.lit(base + level + 1), F.lit(TOP_LEVEL)).alias("level"),
        way(_up("run"), _up("tree")).alias("run"),
        way(F.col("run") % ARITY, F.col("tree") % ARITY).cast("int").alias("slot"),
    )


#: A leaf's way up, a level a step: the parent's row is met, siblings are appended, and each leaf of the run is folded.
CLIMB = """
WITH RECURSIVE climb(tree, run, folded, siblings, up) AS (
  SELECT tree, run, folded, siblings, up FROM {starts}
  UNION ALL
  SELECT tree, run,
         transform(folded, h -> unhex(sha2(lower(hex(concat(substring(kids, 1, 32 * slot), h, substring(kids, 32 * slot + 33)))), 256))),
         concat(siblings, substring(kids, 1, 32 * slot), substring(kids, 32 * slot + 33)),
         next
  FROM (%s)
)
SELECT tree, run, folded, siblings FROM climb WHERE up.level IS NULL
"""
_MET = """
  SELECT /*+ BROADCAST(u) */ c.tree, c.run, c.folded, c.siblings, c.up.slot AS slot, u.kids, u.up AS next
  FROM climb c JOIN {upper} u ON u.tree = c.up.tree AND u.level = c.up.level AND u.run = c.up.run
"""
#: With lower levels that are too large to broadcast. Rows whose parent is an upper one get keys of their own in the shuffled
#: join, as those rows must not meet in one task.
_MET_BOTH = """
  SELECT /*+ BROADCAST(u) */ c.tree, c.run, c.folded, c.siblings, c.up.slot AS slot, coalesce(u.kids, w.kids) AS kids,
         CASE WHEN u.kids IS NULL THEN w.up ELSE u.up END AS next
  FROM climb c
  LEFT JOIN {upper} u ON u.tree = c.up.tree AND u.level = c.up.level AND u.run = c.up.run
  LEFT JOIN {lower} w ON w.tree = c.up.tree AND w.level = c.up.level
    AND w.run = CASE WHEN c.up.level < {edge} THEN c.up.run ELSE -1 - c.run END
  WHERE c.up.level IS NOT NULL
"""


def _climb(starts: DataFrame, above: dict[int, DataFrame]) -> DataFrame:
    """Every start (tree, run, folded, siblings, up) at the root: tree, run, folded, siblings. ``above`` has linked, settled runs by level."""
    spark, edge, room = starts.sparkSession, None, BROADCAST_RUNS
    for level in sorted(above, reverse=True):
        room -= above[level].count()
        if room < 0:
            break
        edge = level
    tables = {True: None, False: None}
    for level, runs in above.items():
        upper = edge is not None and level >= edge
        tables[upper] = runs if tables[upper] is None else tables[upper].unionByName(runs)
    if not above:
        return starts.select("tree", "run", "folded", "siblings")
    none = above[max(above)].where("false")
    if tables[False] is None:
        return spark.sql(CLIMB % _MET, starts=starts, upper=tables[True])
    return spark.sql(CLIMB % _MET_BOTH, starts=starts, upper=none if tables[True] is None else tables[True], lower=tables[False], edge=TOP_LEVEL * 2 if edge is None else edge)


def manifest(docs: DataFrame) -> tuple[DataFrame, bytes | None]:
    """(doc_id, leaf, forged, subroot, own and shared siblings, folded) of every row, digests as 32 bytes; and the root."""
    spark = docs.sparkSession
    rows, cuts = placed(settle(leaves(docs)), ["lang"], ["doc_id", "leaf"])
    lang_rows, lang_cuts = placed(settle(cuts.groupBy("lang").agg(F.sum("_rows").alias("n"))), [], ["lang"])
    trees = lang_rows.join(lang_cuts.select("_p", "_first"), "_p").select("lang", "n", (F.col("_i") + F.col("_first")).alias("tree"))
    size = trees.agg(F.max("n").alias("widest"), F.count("*").alias("langs"), F.sum("n").alias("rows")).first()
    if not size["langs"]:
        return rows.select("doc_id", "leaf", "forged", F.col("leaf").alias("subroot"), F.col("leaf").alias("siblings"), F.col("leaf").alias("folded")), None
    first = settle(cuts.join(trees, cuts["lang"].eqNullSafe(trees["lang"])).select("_p", cuts["lang"].alias("_lang"), "_first", "n", "tree"))
    on = (rows["_p"] == first["_p"]) & rows["lang"].eqNullSafe(first["_lang"])
    nodes = rows.join(broadcast_if_small(first), on).select("tree", "n", (F.col("_i") + F.col("_first")).alias("idx"), F.col("leaf").alias("hash"), "forged", "doc_id")
    ground = settle(_packed(nodes).withColumn("kids", _side_by_side(F.col("nodes"))))

    levels, subroots = _build(ground.select("tree", "n", "run", "kids"), size["widest"])
    subroots = settle(subroots.join(trees.select("tree", "n"), "tree"))
    top = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(size["langs"]).cast("long").alias("n"), F.col("tree").alias("idx"), "hash")
    top_first = settle(_packed(top).select("tree", "n", "run", _side_by_side(F.col("nodes")).alias("kids")))
    top_levels, roots = _build(top_first, size["langs"])
    root = bytes(roots.first()["hash"])

    above = {}
    for base, tables in ((0, [None, *levels]), (TOP_LEVEL, [top_first, *top_levels])):
        for k, runs in enumerate(tables):
            if runs is not None and (base == 0 or size["langs"] > 1):
                linked = runs.where("n > 1").select("tree", F.lit(base + k).alias("level"), "run", "kids", _parent(k, base, size["langs"]).alias("up"))
                above[base + k] = linked
    one = F.transform("nodes", lambda x: F.when(F.col("n") == 1, x["forged"]).otherwise(_h(F.concat(_left(F.col("kids"), x["slot"]), x["forged"], _right(F.col("kids"), x["slot"])))))
    starts = ground.select("tree", "run", one.alias("folded"), F.lit(b"").alias("siblings"), _parent(0, 0, size["langs"]).alias("up"))
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    try:
        climbed = settle(_climb(starts, above))
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", limit)

    side = subroots.select("tree", F.col("hash").alias("subroot"), F.col("n").alias("_count"))
    met = join_frequent_apart(ground.join(climbed, ["tree", "run"]), side, ["tree"], size["rows"])
    each = met.select("kids", "siblings", "subroot", F.explode(F.arrays_zip("nodes", "folded")).alias("x"))
    own = F.concat(_left(F.col("kids"), F.col("x.nodes.slot")), _right(F.col("kids"), F.col("x.nodes.slot")))
    return each.select("x.nodes.doc_id", F.col("x.nodes.hash").alias("leaf"), "x.nodes.forged", "subroot", F.concat(own, "siblings").alias("siblings"), "x.folded"), root


def manifest_digest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row, digests as lower-case hex."""
    rows, root = manifest(docs)
    return rows.select(
        "doc_id", _text("leaf").alias("leaf"), _text("subroot").alias("subroot"), _text(F.lit(root)).alias("root"),
        F.sha2(_text("siblings").cast("binary"), 256).alias("proof_sha256"), _text("folded").alias("folded_root"), (F.col("folded") == F.lit(root)).alias("verified"),
    )


def _oracle(lang_levels: int = 10, top_levels: int = 4) -> str:
    """The manifest in plain SQL, for up to 8 ** ``lang_levels`` rows of a language and 8 ** ``top_levels`` languages."""

    def enc(c):
        return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"

    def leaf(text):
        return "sha256(" + " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def climb(name, base, nodes, levels):
        """CTEs of the levels over ``nodes`` (tree, i, h, n), and of the folding of the rows of ``base`` (tree, i, f, sib and more)."""
        out = []
        for k in range(levels):
            below = nodes if k == 0 else f"{name}{k}"
            start = base if k == 0 else f"{name}_fold{k}"
            out.append(
                f"{name}_run{k} AS (SELECT tree, i // 8 AS i, n, list(h ORDER BY i) AS l FROM {below} GROUP BY ALL), "
                f"{name}{k + 1} AS (SELECT tree, i, CASE WHEN n = 1 THEN l[1] ELSE sha256(array_to_string(l, '')) END AS h, (n + 7) // 8 AS n FROM {name}_run{k}), "
                f"{name}_fold{k + 1} AS (SELECT b.* REPLACE (b.i // 8 AS i, CASE WHEN n = 1 THEN f ELSE sha256(array_to_string(l[1 : b.i % 8], '') || f || array_to_string(l[b.i % 8 + 2 :], '')) END AS f, "
                f"CASE WHEN n = 1 THEN sib ELSE sib || array_to_string(l[1 : b.i % 8], '') || array_to_string(l[b.i % 8 + 2 :], '') END AS sib) "
                f"FROM {start} b JOIN {name}_run{k} r ON r.tree = b.tree AND r.i = b.i // 8)"
            )
        return ", ".join(out)

    crc = (
        "list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
        "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)"
    )
    return f"""
WITH docs AS (SELECT *, CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END AS bad FROM documents),
hashed AS (SELECT doc_id, lang, {leaf("text")} AS leaf, {leaf("bad")} AS f FROM docs),
base AS (SELECT doc_id, leaf, f, '' AS sib, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
                row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS cnt FROM hashed),
nodes AS (SELECT tree, i, leaf AS h, cnt AS n FROM base),
{climb("a", "base", "nodes", lang_levels)},
tops AS (SELECT 0 AS tree, tree AS i, h, count(*) OVER () AS n FROM a{lang_levels}),
top_base AS (SELECT b.* REPLACE (0 AS tree, b.tree AS i), h AS subroot FROM a_fold{lang_levels} b JOIN a{lang_levels} s USING (tree)),
{climb("b", "top_base", "tops", top_levels)}
SELECT doc_id, leaf, subroot, h AS root, sha256(sib) AS proof_sha256, f AS folded_root, f = h AS verified
FROM b_fold{top_levels} JOIN b{top_levels} USING (tree)
"""


ORACLE = _oracle()
