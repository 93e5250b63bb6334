"""Hard negatives: rows of another label that score just below an anchor's positives.

Method: anchor-clustered shared lists. Anchors are clustered by direction; for a cluster the
candidates are sorted once by an upper bound of their inner product with any member (the angle to
the cluster's axis less the widest angle of a member). Every member walks that list until the bound
shows that nothing further on can change its answer, so that answers are exact. First the positives
are found, then, with their scores known, the negatives in each positive's window.

Candidates are dealt into slices whose size is bounded, each held by one task as a matrix; the
anchors (a hundredth of the rows) go to every slice, sorted by cluster, and stream through it in
blocks of at most ``MEMBERS``. A slice sorts its own list for each block and sends back, for each
anchor, at most as many rows as are asked for; these meet in one ranking. So the matrix in memory,
the anchors in memory and the rows of an anchor that meet are bounded at every size, and copies of
one vector, however many, lie in all slices. Slices grow in number with the table; at 64 components
one holds 262,144 rows, and anchors are sent once to each.

Defined cases. Rows with a null id, label or vector, or a null or non-finite component take no
part. Components are floored after scaling and held within plus and minus 2**25. A vector that is
shorter than others has zeros after its end; a zero vector takes part. Rows that repeat an id are
rows of their own: each anchor row has its results, and no row of the anchor's id is among its
positives. An empty table, or one without anchors, has no results. Columns beyond the three are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.store import settle

#: Components of the candidates that one slice holds, and the least number of slices.
SLICE_VALUES, LEAST_SLICES = 1 << 24, 8
#: Anchors that the axes are fitted on, at most; axes; anchors of a block.
SAMPLE, CLUSTERS, MEMBERS = 4096, 32, 4096
#: Largest magnitude of a scaled component.
LARGEST = 1 << 25
#: Rows of the list that a walk takes at first, and at most.
FIRST, STRIDE = 64, 2048


def _rows_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, offsets, usable) of a column of lists: a row is usable if it is no null and all its values are finite."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.asarray(column.value_lengths().fill_null(0))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    return values, offsets, np.asarray(column.is_valid()) & (bad[offsets[1:]] == bad[offsets[:-1]])


def _quantiser(scale: float):
    def run(batches):
        for batch in batches:
            values, offsets, usable = _rows_of(batch.column("v"))
            with np.errstate(invalid="ignore", over="ignore"):
                whole = np.clip(np.nan_to_num(np.floor(values * scale)), -LARGEST, LARGEST).astype("<i4")
            v = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 4).tobytes()), pa.py_buffer(whole.tobytes())]).cast(pa.binary())
            out = pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), v], names=["id", "label", "v"])
            yield out.filter(pa.array(usable))

    return run


def _matrix(column) -> np.ndarray:
    """The vectors of a binary column as rows of integers, zeros after the end of short ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    parts = [np.frombuffer(x, "<i4") for x in column.to_pylist()]
    wide = max((len(p) for p in parts), default=0)
    if all(len(p) == wide for p in parts):
        return np.stack(parts) if parts else np.zeros((0, 0), np.int32)
    return np.stack([np.pad(p, (0, wide - len(p))) for p in parts])


def _stacked(parts: list[np.ndarray]) -> np.ndarray:
    wide = max(p.shape[1] for p in parts)
    return np.concatenate([p if p.shape[1] == wide else np.pad(p, ((0, 0), (0, wide - p.shape[1]))) for p in parts])


def axes(vectors: np.ndarray, k: int, steps: int = 8, seed: int = 3) -> np.ndarray:
    """``k`` directions at most, by spherical k-means."""
    size = np.linalg.norm(vectors, axis=1)
    unit = vectors[size > 0] / size[size > 0, None]
    if not len(unit):
        return np.zeros((1, vectors.shape[1]))
    out = unit[np.random.default_rng(seed).permutation(len(unit))[:k]]
    for _ in range(steps):
        near = (unit @ out.T).argmax(1)
        sums = np.zeros_like(out)
        np.add.at(sums, near, unit)
        length = np.linalg.norm(sums, axis=1)
        out = np.where(length[:, None] > 0, sums / np.maximum(length, 1e-300)[:, None], out)
    return out


def _assigner(directions: np.ndarray):
    def run(batches):
        for batch in batches:
            m, d = _matrix(batch.column("v")).astype(np.float64), directions
            wide = max(m.shape[1], d.shape[1])
            m, d = np.pad(m, ((0, 0), (0, wide - m.shape[1]))), np.pad(d, ((0, 0), (0, wide - d.shape[1])))
            yield batch.append_column("cluster", pa.array((m @ d.T).argmax(1).astype(np.int32)))

    return run


class Slice:
    """The candidates of one slice, by id, and the lists that anchor blocks share."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.largest = int(np.abs(vectors).max(initial=0))
        self.norms = np.sqrt(np.einsum("ij,ij->i", *(2 * [self.vectors.astype(np.float64)])))
        self._as: dict = {}

    def shared(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of candidates, bounds): no member q has a larger inner product with a candidate than |q| times its bound; bounds fall."""
        m = members.astype(np.float64)
        size = np.linalg.norm(m, axis=1)
        unit = m[size > 0] / size[size > 0, None]
        axis = unit.sum(0)
        if not len(unit) or not np.linalg.norm(axis):
            bound = self.norms
        else:
            axis /= np.linalg.norm(axis)
            widest = np.arccos(np.clip((unit @ axis).min(), -1, 1))
            along = np.concatenate([self.vectors[i : i + 65536].astype(np.float64) @ axis for i in range(0, len(self.ids), 65536)])
            angle = np.arccos(np.clip(along / np.maximum(self.norms, 1e-300), -1, 1))
            bound = self.norms * np.cos(np.maximum(angle - widest, 0))
        # Room for rounding: the bound of equal directions must not fall below their score.
        bound = bound + 1e-7 * self.norms
        order = np.argsort(-bound, kind="stable")
        return order, bound[order]

    def scores(self, members: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact inner products as int64, by the narrowest arithmetic that holds them."""
        reach = self.largest * int(np.abs(members).max(initial=0)) * max(1, members.shape[1])
        kind = np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64
        if kind not in self._as:
            self._as[kind] = self.vectors.astype(kind)
        return (members.astype(kind) @ self._as[kind][at].T).astype(np.int64)

    def walk(self, members, keep, labels, same: bool, own, high, low, of, norms):
        """The first ``keep`` candidates of every asker, by falling score and rising id: (asker, score, id).

        Asker j is member ``of[j]`` and takes scores from ``low`` to ``high`` of candidates that have its label (``same``, but
        not its own id) or another one. It stops at the first bound that is below its floor: ``low``, or its last kept score.
        """
        order, bound = self.shared(members)
        n = len(of)
        got = (np.zeros(0, np.int64),) * 3
        least = np.array(low, np.float64)
        last, last_id = np.full(n, np.iinfo(np.int64).min), np.full(n, np.iinfo(np.int64).max)
        at, step, open_ = 0, FIRST, np.arange(n)
        while at < len(order):
            reach = norms[of[open_]] * bound[at]
            open_ = open_[reach + 1e-6 >= np.maximum(least[open_], last[open_].astype(np.float64))]
            if not len(open_):
                break
            here = order[at : at + step]
            who, back = np.unique(of[open_], return_inverse=True)
            s = self.scores(members[who], here)[back]
            ids, lab = self.ids[here][None, :], self.labels[here][None, :] == labels[of[open_]][:, None]
            fit = (lab & (ids != own[of[open_]][:, None])) if same else ~lab
            fit &= (s <= high[open_][:, None]) & (s >= low[open_][:, None])
            fit &= (s > last[open_][:, None]) | ((s == last[open_][:, None]) & (ids < last_id[open_][:, None]))
            r, c = np.nonzero(fit)
            if len(r):
                j, sc, i = (np.concatenate(x) for x in zip(got, (open_[r], s[r, c], ids[0, c]), strict=True))
                by = np.lexsort((i, -sc, j))
                j, sc, i = j[by], sc[by], i[by]
                first = np.searchsorted(j, j)
                rank = np.arange(len(j)) - first
                kept = rank < keep
                got = (j[kept], sc[kept], i[kept])
                full = rank == keep - 1
                last[j[full]], last_id[j[full]] = sc[full], i[full]
            at, step = at + len(here), min(STRIDE, 2 * step)
        return got


class _Block:
    """Anchors of one cluster."""

    def __init__(self, parts: list[dict]):
        self.a = np.concatenate([p["a"] for p in parts])
        self.ids = np.concatenate([p["id"] for p in parts])
        self.labels = np.concatenate([p["label"] for p in parts])
        self.vectors = _stacked([p["v"] for p in parts])
        self.windows = [w for p in parts for w in p["scores"]]


def _answers(block: _Block, held: Slice, keep: int, percent: int | None):
    """(a, window, score, id) of the slice's answers for a block: positives if ``percent`` is None, else negatives of each window."""
    wide = max(block.vectors.shape[1], held.vectors.shape[1])
    block.vectors = np.pad(block.vectors, ((0, 0), (0, wide - block.vectors.shape[1])))
    if held.vectors.shape[1] < wide:
        held.vectors = np.pad(held.vectors, ((0, 0), (0, wide - held.vectors.shape[1])))
        held._as = {}
    norms = np.linalg.norm(block.vectors.astype(np.float64), axis=1)
    n = len(block.a)
    if percent is None:
        of, window = np.arange(n), np.zeros(n, np.int32)
        low, high = np.full(n, np.iinfo(np.int64).min), np.full(n, np.iinfo(np.int64).max)
    else:
        asked = [(i, k, p) for i, ps in enumerate(block.windows) for k, p in enumerate(ps) if p >= 0]
        of, window, high = (np.array(x, np.int64) for x in zip(*asked, strict=True)) if asked else (np.zeros(0, np.int64),) * 3
        low = -(-percent * high // 100)
    if not len(of):
        return None
    j, score, ids = held.walk(block.vectors, keep, block.labels, percent is None, block.ids, high, low, of, norms)
    return block.a[of[j]], window[j].astype(np.int32), score, ids


def _finder(keep: int, percent: int | None):
    names = ["a", "win", "score", "found"]

    def run(batches):
        held, parts, block, key = None, [], [], None

        def close_block():
            nonlocal block
            done, block = block, []
            if done and held is not None:
                out = _answers(_Block(done), held, keep, percent)
                if out is not None and len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)

        for batch in batches:
            at = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("slice", "kind", "cluster")], axis=1)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                now = tuple(at[lo].tolist())
                if now != key:
                    yield from close_block()
                    if key is None or now[0] != key[0]:
                        held, parts = None, []
                    key = now
                b = batch.slice(lo, hi - lo)
                row = {c: np.asarray(b.column(c)).astype(np.int64) for c in ("a", "id", "label")} | {"v": _matrix(b.column("v"))}
                if now[1] == 0:
                    parts.append(row)
                    continue
                if held is None and parts:
                    held = Slice(np.concatenate([p["id"] for p in parts]), np.concatenate([p["label"] for p in parts]), _stacked([p["v"] for p in parts]))
                    parts = []
                row["scores"] = [x or [] for x in b.column("scores").to_pylist()]
                for k in range(0, hi - lo, MEMBERS):
                    block.append({c: x[k : k + MEMBERS] for c, x in row.items()})
                    if sum(len(p["a"]) for p in block) + min(MEMBERS, hi - lo - k) > MEMBERS:
                        yield from close_block()
        yield from close_block()

    return run


def _find(rows: DataFrame, anchors: DataFrame, slices: int, keep: int, percent: int | None) -> DataFrame:
    """Answers of all slices: a, win (number of the positive), score, found (the id)."""
    none = F.lit(None).cast("array<bigint>")
    dealt = rows.select((F.monotonically_increasing_id() % slices).cast("int").alias("slice"), F.lit(0).alias("kind"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("a"), "id", "label", "v", none.alias("scores"))
    sent = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(1).alias("kind"), "cluster", "a", "id", "label", "v", F.col("scores") if "scores" in anchors.columns else none.alias("scores"))
    return (
        dealt.unionByName(sent).repartitionByRange(slices, "slice").sortWithinPartitions("slice", "kind", "cluster")
        .mapInArrow(_finder(keep, percent), "a long, win int, score long, found long")
    )


def _first(found: DataFrame, keep: int, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def mine(vectors: DataFrame, anchor: Callable[[Column], Column], id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: float = 256.0, positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` makes of an id the condition that picks anchors. An anchor's positives are its first ``positives`` other rows of
    the same label; negatives have another label and between ``percent`` of a positive's score and that score.
    """
    usable = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"))
    rows = settle(usable.where("id is not null and label is not null and v is not null").mapInArrow(_quantiser(scale), "id long, label long, v binary"))
    picked = settle(rows.where(anchor(F.col("id"))).withColumn("a", F.monotonically_increasing_id()))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.octet_length("v")), F.lit(0)).alias("wide")).first()
    slices = max(LEAST_SLICES, -(-size["n"] * size["wide"] // 4 // SLICE_VALUES))
    sample = picked.orderBy(F.xxhash64("id", "a")).limit(SAMPLE).select("v").toArrow()
    fitted = axes(_matrix(sample.column("v")).astype(np.float64), CLUSTERS) if sample.num_rows else np.zeros((1, 1))
    anchors = settle(picked.mapInArrow(_assigner(fitted), "id long, label long, v binary, a long, cluster int"))

    found = settle(_first(_find(rows, anchors, slices, positives, None), positives, ["a"]).select("a", F.col("rank").alias("win"), "score", "found"))
    windows = found.groupBy("a").agg(F.transform(F.sort_array(F.collect_list(F.struct("win", "score"))), lambda x: x["score"]).alias("scores"))
    again = _find(rows, anchors.join(windows, "a"), slices, negatives, percent)
    best = _first(again, negatives, ["a", "win"]).select("a", (F.col("win") + 1).alias("win"), "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    named = found.select("a", "win", F.col("found").alias("positive_id"), F.col("score").alias("positive_score")).join(anchors.select("a", F.col("id").alias("anchor_id")), "a")
    return named.join(best, ["a", "win"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank,
             s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
