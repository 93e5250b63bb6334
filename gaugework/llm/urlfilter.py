"""URL filters: rules first, then templates of paths that were learned from what the rules labelled.

Method: path-template tree. For each host, paths become a tree of segments, level by level. A
segment stays as it is where it holds ``MIN_SUPPORT`` pages and one part in ``BRANCHES`` of its
node; all others are variable and become one wildcard. Of the kept branches of a node those whose
pages are blocked, allowed and unlabelled in like shares (chi-square between neighbours in the order
of these shares) are merged into one. What the leaves of the tree say of their pages are templates;
one whose smoothed share of blocked pages among its labelled ones is above a half is rejected.

Everything is DataFrame functions. Pages are first counted by host and path. A level is a grouping by
node and segment (summed before it is shuffled), a window over at most ``BRANCHES`` kept segments of
a node, and a join in which frequent segments are broadcast (``join_frequent_apart``), so that a host
with most pages is the work of many tasks. There are as many levels as the deepest node with
``MIN_SUPPORT`` pages has: whatever hangs below smaller nodes is wildcards and is written at once.

Defined cases. A null url, or one without ``://``, has an empty host and path, which make one
template of their own. A path without segments is the template ``""``; an empty segment is a segment. A host keeps
its port and its user. Characters with a meaning in templates (``% * { | }``) are written as
``%XX``. Rows that repeat a page count each. No page without labels is blocked for want of them.
An empty table gives no rows. Columns beyond the two are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.store import FEW, SHARE, join_frequent_apart, settle

#: Pages that a segment needs to be kept, and the share of its node that it needs, as one in so many.
MIN_SUPPORT, BRANCHES = 5, 64
#: Branches are alike below this chi-square: 5 % at two degrees of freedom.
ALIKE = 5.991
#: Blocked and allowed pages that each template is given before its own are counted.
PRIOR_BLOCKED, PRIOR_ALLOWED = 1, 3
#: Characters with a meaning in templates.
ESCAPED = {"%": "%25", "*": "%2A", "{": "%7B", "|": "%7C", "}": "%7D"}
#: The rules of the query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url, both empty where it is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host, path, rules) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, null if none does. ``rules`` are (verdict, host/path) pairs, some hundreds at most."""
    best, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"))):
        own, start = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        best, verdict = F.when(fits, text).otherwise(best), F.when(fits, kind).otherwise(verdict)
    return best, verdict


def _escaped(segment: Column) -> Column:
    return reduce(lambda s, e: F.replace(s, F.lit(e), F.lit(ESCAPED[e])), ESCAPED, segment)


def _differ(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Chi-square of two branches over blocked, allowed and unlabelled pages; each is (pages, blocked, allowed)."""

    def part(x, y):
        d = (x * b[0] - y * a[0]).cast("double")
        return F.when(x + y > 0, d * d / (a[0].cast("double") * b[0].cast("double") * (x + y).cast("double"))).otherwise(0.0)

    return part(a[1], b[1]) + part(a[2], b[2]) + part(a[0] - a[1] - a[2], b[0] - b[1] - b[2])


def _kept_branches(children: DataFrame) -> DataFrame:
    """(host, node, seg, label, _count) of the segments that stay, where merged ones have one label; ``children`` are settled sums."""
    nodes = children.groupBy("host", "node").agg(F.sum("n").alias("total"), F.count_if(F.col("n") >= MIN_SUPPORT).alias("_count"))
    large = children.where(F.col("n") >= MIN_SUPPORT).withColumnRenamed("_count", "c")
    kept = join_frequent_apart(large, nodes.where("_count > 0"), ["host", "node"], large.count()).where(F.col("n") * BRANCHES >= F.col("total"))
    order = Window.partitionBy("host", "node").orderBy(F.col("k") / F.col("n"), F.col("g") / F.col("n"), "seg")
    before = tuple(F.lag(x).over(order) for x in ("n", "k", "g"))
    new = F.when(before[0].isNull() | (_differ(before, (F.col("n"), F.col("k"), F.col("g"))) > ALIKE), 1).otherwise(0)
    parts = kept.withColumn("new", new).withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("host", "node", "part")
    names = F.sort_array(F.collect_list(_escaped(F.col("seg"))).over(whole))
    label = F.when(F.size(names) == 1, names[0]).otherwise(F.concat(F.lit("{"), F.concat_ws("|", names), F.lit("}")))
    return parts.select("host", "node", "seg", label.alias("label"), F.col("c").alias("_count"))


def _stepped(rows: DataFrame, kept: DataFrame, total: int) -> DataFrame:
    """``rows`` (settled) a level further down: with the label of their segment, or a wildcard."""
    edge = max(FEW, int(total * SHARE))
    keys = ["host", "node", "seg"]
    first = rows.join(F.broadcast(kept.where(F.col("_count") >= edge).drop("_count")), keys, "left")
    rest = first.where("label is null").drop("label").join(kept.where(F.col("_count") < edge).drop("_count"), keys, "left")
    both = first.where("label is not null").unionByName(rest)
    return both.withColumn("node", F.concat("node", F.lit("/"), F.coalesce("label", F.lit("*")))).drop("label", "seg")


def path_templates(paths: DataFrame) -> DataFrame:
    """host, path, template, n, k and g of distinct ``paths`` (host, path; n pages, k of them blocked and g allowed)."""
    rows = paths.select("host", "path", "n", "k", "g", F.slice(F.split("path", "/"), F.lit(2), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))).alias("left"), F.lit("").alias("node"))
    rows, done, depth = settle(rows), [], 0
    columns = ["host", "path", "n", "k", "g", "node"]
    while True:
        done.append(rows.where(F.size("left") == depth).select(columns))
        open_ = rows.where(F.size("left") > depth).withColumn("seg", F.element_at("left", depth + 1))
        children = settle(open_.groupBy("host", "node", "seg").agg(*(F.sum(x).alias(x) for x in "nkg"), F.count("*").alias("_count")))
        total = children.groupBy("host", "node").agg(F.sum("n").alias("n"), F.sum("_count").alias("c")).agg(F.max("n").alias("most"), F.sum("c").alias("rows")).first()
        if total["most"] is None or total["most"] < MIN_SUPPORT:
            tail = F.concat("node", F.repeat(F.lit("/*"), F.size("left") - depth))
            done.append(open_.withColumn("node", tail).select(columns))
            return reduce(DataFrame.unionByName, done).withColumnRenamed("node", "template")
        rows, depth = settle(_stepped(open_, settle(_kept_branches(children)), total["rows"])), depth + 1


def judge(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity (smoothed share of blocked pages) of every page."""
    host, path = host_and_path(F.col(url))
    parsed = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    counted = parsed.groupBy("host", "path").agg(F.count("*").alias("n"))
    rule, kind = matching_rule(F.col("host"), F.col("path"), rules)
    ruled = counted.withColumns({"rule": rule, "kind": kind})
    labelled = settle(ruled.select("host", "path", "n", "rule", "kind", *(F.when(F.col("kind") == v, F.col("n")).otherwise(F.lit(0).cast("long")).alias(c) for c, v in (("k", "block"), ("g", "allow")))))
    templates = settle(path_templates(labelled.select("host", "path", "n", "k", "g")))
    judged = templates.groupBy("host", "template").agg(F.sum("k").alias("bad"), F.sum("g").alias("good"), F.count("*").alias("_count"))
    purity = (F.col("bad") + PRIOR_BLOCKED) / (F.col("bad") + F.col("good") + PRIOR_BLOCKED + PRIOR_ALLOWED)
    judged = settle(judged.select("host", "template", purity.alias("purity"), "_count"))
    n = templates.count()
    by_path = join_frequent_apart(templates.select("host", "path", "n", "template"), judged, ["host", "template"], n)
    rule, kind = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") > 0.5, "block").otherwise("allow")
    by_path = settle(by_path.select("host", "path", F.col("n").alias("_count"), "template", "purity", rule.alias("rule"), F.coalesce(kind, own).alias("verdict")))
    total = by_path.agg(F.coalesce(F.sum("_count"), F.lit(0)).alias("n")).first()["n"]
    return join_frequent_apart(parsed, by_path, ["host", "path"], total).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def _oracle(levels: int = 8) -> str:
    """The same in plain SQL, for trees of up to ``levels`` levels."""
    rule = "CASE"
    for kind, text in sorted(RULES, key=lambda r: -len(r[1])):
        own, start = text.split("/", 1)[0], text[text.index("/") :]
        rule += f" WHEN (host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '{start}') THEN '{kind} {text}'"
    escaped = "seg"
    for c, e in ESCAPED.items():
        escaped = f"replace({escaped}, '{c}', '{e}')"

    def part(x, y):
        d = f"({x} * n - {y} * pn)::DOUBLE"
        return f"CASE WHEN {x} + {y} > 0 THEN {d} * {d} / (pn::DOUBLE * n::DOUBLE * ({x} + {y})::DOUBLE) ELSE 0.0 END"

    out = [f"""
WITH cut AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
page AS (SELECT *, {rule} END AS ruled FROM split),
t0 AS (SELECT host, path, count(*) AS n, count(*) FILTER (ruled LIKE 'block%') AS k, count(*) FILTER (ruled LIKE 'allow%') AS g,
              string_split(path, '/')[2:] AS segs, '' AS node FROM page GROUP BY host, path)"""]
    for d in range(levels):
        out.append(f"""
c{d} AS (SELECT host, node, segs[{d + 1}] AS seg, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k, sum(g)::BIGINT AS g FROM t{d} WHERE len(segs) > {d} GROUP BY ALL),
h{d} AS (SELECT * FROM c{d} QUALIFY n >= {MIN_SUPPORT} AND n * {BRANCHES} >= sum(n) OVER (PARTITION BY host, node)),
l{d} AS (SELECT *, lag(n) OVER w AS pn, lag(k) OVER w AS pk, lag(g) OVER w AS pg FROM h{d} WINDOW w AS (PARTITION BY host, node ORDER BY k / n, g / n, seg)),
x{d} AS (SELECT *, CASE WHEN pn IS NULL OR {part("pk", "k")} + {part("pg", "g")} + {part("(pn - pk - pg)", "(n - k - g)")} > {ALIKE} THEN 1 ELSE 0 END AS new FROM l{d}),
g{d} AS (SELECT *, sum(new) OVER (PARTITION BY host, node ORDER BY k / n, g / n, seg) AS part FROM x{d}),
m{d} AS (SELECT host, node, list(seg) AS held, CASE WHEN count(*) = 1 THEN min({escaped}) ELSE '{{' || string_agg({escaped}, '|' ORDER BY {escaped}) || '}}' END AS label FROM g{d} GROUP BY host, node, part),
j{d} AS (SELECT host, node, unnest(held) AS seg, label FROM m{d}),
t{d + 1} AS (SELECT t.host, t.path, t.n, t.k, t.g, t.segs, CASE WHEN len(t.segs) > {d} THEN t.node || '/' || coalesce(j.label, '*') ELSE t.node END AS node
             FROM t{d} t LEFT JOIN j{d} j ON j.host = t.host AND j.node = t.node AND len(t.segs) > {d} AND j.seg = t.segs[{d + 1}])""")
    out.append(f"""
done AS (SELECT host, path, k, g, node || repeat('/*', greatest(len(segs) - {levels}, 0)) AS template FROM t{levels}),
pure AS (SELECT host, path, template, (sum(k) OVER w + {PRIOR_BLOCKED}) / (sum(k) OVER w + sum(g) OVER w + {PRIOR_BLOCKED + PRIOR_ALLOWED}) AS purity
         FROM done WINDOW w AS (PARTITION BY host, template))
SELECT page_id, p.host, p.path, CASE WHEN ruled IS NOT NULL THEN split_part(ruled, ' ', 2) END AS rule,
       CASE WHEN ruled IS NOT NULL THEN split_part(ruled, ' ', 1) WHEN purity > 0.5 THEN 'block' ELSE 'allow' END AS verdict, template, purity::DOUBLE AS purity
FROM page p JOIN pure USING (host, path)""")
    return ",".join(out)


ORACLE = _oracle()
