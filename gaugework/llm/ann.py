"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of full-dimensional codewords, one from each codebook. Codebooks are
fitted on a bounded sample (``SAMPLE`` vectors): residual k-means, then rounds of beam-search
coding and joint least-squares updates. All vectors are coded by beam search and keep the norm
of what their code stands for, so that a query scores a vector with one table lookup a codebook:
|q - x|^2 = |q|^2 - 2 sum_m <q, c_m> + |x|^2. The best ``RERANK`` of each query, as many at every
size of the table, are ranked again by exact distance on the original vectors.

Estimates do not order near copies that differ by less than the error of their codes. So a query
whose last estimate of these, less the largest error, is not beyond its k-th exact distance goes
over all blocks once more: a candidate whose distance from the query by its code, less its own
error |x - x^|, is not beyond that distance is measured exactly, and takes part if it is as near.

Codes travel in blocks of ``BLOCK`` vectors and queries in blocks of ``QUERIES``; a block of
codes meets each block of queries once, and only the best of it go on.

Defined cases. Vectors that are null, of zero length or norm, or hold a null, NaN or infinity take
no part, as queries or candidates, nor do those of another length than the most common one (of
equally common ones, the smallest). Equal distances go to the smaller id,
also within the candidates kept. A query's own id is no candidate. Repeated ids are candidates
once (the first in order of vectors). With fewer candidates than k all are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.store import settle

SAMPLE, BOOKS, WORDS, BEAM, ROUNDS = 32768, 16, 256, 4, 1
BLOCK, QUERIES, RERANK = 4096, 256, 100
#: Queries that one broadcast of the second pass takes along.
ASKED = 4096


def _kmeans(x: np.ndarray, k: int, rng, steps: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(steps):
        at = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        n = np.bincount(at, minlength=k)
        order = np.argsort(at, kind="stable")
        filled = np.flatnonzero(n)
        c[filled] = np.add.reduceat(x[order], np.searchsorted(at[order], filled)) / n[filled, None]
        empty = np.flatnonzero(n == 0)
        c[empty] = x[rng.choice(len(x), len(empty))]
    return c


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM, rows: int = 512) -> np.ndarray:
    """Codes by beam search over the codebooks in turn."""
    norms = (books * books).sum(2)
    out = np.empty((len(x), len(books)), np.uint8)
    for s in range(0, len(x), rows):
        part = x[s : s + rows]
        n = len(part)
        left, codes, lost = part[:, None, :], np.zeros((n, 1, 0), np.uint8), np.zeros((n, 1))
        for book, norm in zip(books, norms, strict=True):
            cost = lost[:, :, None] + norm - 2 * (left.reshape(-1, part.shape[1]) @ book.T).reshape(n, left.shape[1], -1)
            flat = cost.reshape(n, -1)
            width = min(beam, flat.shape[1])
            near = np.sort(np.argpartition(flat, width - 1, axis=1)[:, :width], axis=1)
            best = np.take_along_axis(near, np.argsort(np.take_along_axis(flat, near, axis=1), axis=1, kind="stable"), axis=1)
            came, word = best // len(book), best % len(book)
            row = np.arange(n)[:, None]
            codes = np.concatenate((codes[row, came], word[:, :, None].astype(np.uint8)), axis=2)
            left, lost = left[row, came] - book[word], flat[row, best]
        out[s : s + rows] = codes[:, 0]
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(b[codes[:, m]] for m, b in enumerate(books))


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """Codebooks (books, words, dimensions) of a sample."""
    rng = np.random.default_rng(seed)
    left, out = x.copy(), []
    for _ in range(books):
        c = _kmeans(left, words, rng)
        left = left - c[np.argmin((c * c).sum(1) - 2 * left @ c.T, axis=1)]
        out.append(c)
    out = np.array(out)
    for _ in range(rounds):
        codes = encode(x, out)
        gram = np.zeros((books * words, books * words))
        want = np.zeros((books * words, x.shape[1]))
        cell = codes.astype(np.int64) + np.arange(books) * words
        for a in range(books):
            np.add.at(want, cell[:, a], x)
            for b in range(books):
                np.add.at(gram, (cell[:, a], cell[:, b]), 1)
        gram[np.diag_indices_from(gram)] += 0.1
        flat = out.reshape(-1, x.shape[1])
        out = (flat + np.linalg.solve(gram, want + 0.1 * flat - gram @ flat)).reshape(out.shape)
    return out.astype(np.float32)


def _rows(batch, column: str = "vec", kind=np.float32) -> np.ndarray:
    v = batch.column(column)
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype(kind)


_CODED = pa.schema([("ids", pa.binary()), ("codes", pa.binary()), ("norms", pa.binary()), ("vecs", pa.binary()), ("errors", pa.binary()), ("worst", pa.float64()), ("longest", pa.float64())])
_CODED_SQL = "ids binary, codes binary, norms binary, vecs binary, errors binary, worst double, longest double"


def _coder(model):
    def run(batches):
        books = model.value
        held: list = []

        def block(rows):
            ids, codes, norms, vecs = (np.concatenate(v) for v in zip(*rows, strict=True))
            errors = np.sqrt(((vecs - decode(codes, books.astype(float))) ** 2).sum(1))
            held = {"ids": ids, "codes": codes, "norms": norms.astype(np.float32), "vecs": vecs, "errors": errors}
            return pa.RecordBatch.from_pydict({**{k: [v.tobytes()] for k, v in held.items()}, "worst": [errors.max()], "longest": [float(norms.max())]}, schema=_CODED)

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch)
            codes = encode(x, books)
            y = decode(codes, books)
            held.append((batch.column("vec_id").to_numpy(), codes, (y * y).sum(1), _rows(batch, kind=float)))
            if sum(len(h[0]) for h in held) >= BLOCK:
                yield block(held)
                held = []
        if held:
            yield block(held)

    return run


def _scorer(model, keep: int):
    """Best candidates of every query of a block within a block of codes."""

    def run(batches):
        books = model.value
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                codes = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1)
                norms = np.frombuffer(row["norms"], np.float32)
                qids = np.array(row["qids"], np.int64)
                q = np.array(row["qvecs"], np.float32)
                tables = np.einsum("qd,mkd->qmk", q, books)
                width = min(keep + 1, len(ids))
                owner, found, score = [], [], []
                for i in range(len(q)):
                    s = norms.copy()
                    for m in range(codes.shape[1]):
                        s -= 2 * tables[i, m][codes[:, m]]
                    edge = np.partition(s, width - 1)[width - 1]
                    top = np.flatnonzero(s <= edge)
                    top = top[ids[top] != qids[i]]
                    top = top[np.lexsort((ids[top], s[top]))[:keep]]
                    owner.append(np.full(len(top), qids[i]))
                    found.append(ids[top])
                    score.append(s[top])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (owner, found, score)], names=["query_id", "vec_id", "estimate"])

    return run


def _bounded(model, asked, k: int):
    """The ``k`` nearest in a block of every query asked, of those that may be and are within its distance."""

    def run(batches):
        books = model.value.astype(float)
        qids, q, within = asked.value
        for batch in batches:
            for row in batch.to_pylist():
                ids, errors = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["errors"])
                x = np.frombuffer(row["vecs"]).reshape(len(ids), -1)
                y = decode(np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1), books)
                norms = (y * y).sum(1)
                owner, found = [], []
                for s in range(0, len(q), QUERIES):
                    part = q[s : s + QUERIES]
                    scale = (part * part).sum(1)[:, None] + norms
                    far = np.sqrt(np.maximum(0.0, scale * (1 - 1e-9) - 2 * part @ y.T)) - errors * (1 + 1e-9)
                    for i in range(len(part)):
                        limit = within[s + i] * (1 + 1e-9)
                        at = np.flatnonzero((far[i] <= limit) & (ids != qids[s + i]))
                        score = np.sqrt(((x[at] - part[i]) ** 2).sum(1))
                        at, score = at[score <= limit], score[score <= limit]
                        top = ids[at[np.lexsort((ids[at], score))[:k]]]
                        owner.append(np.full(len(top), qids[s + i]))
                        found.append(top)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (owner, found)], names=["query_id", "vec_id"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (doubles) of the vectors that take part; one row for an id."""
    v = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vec")).where(good)
    usual = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows if usual is None else rows.where(F.size("vec") == usual["d"])
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, rerank: int = RERANK, sample: int = SAMPLE, close: bool = True) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the ``k`` nearest found.

    ``vectors`` and ``queries`` come from ``usable``. Without ``close``, queries that the codes leave open get no second pass.
    """
    spark = vectors.sparkSession
    total = vectors.count()
    rerank = max(rerank, k)
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec").toArrow()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not rows.num_rows:
        return empty
    x = _rows(rows)
    words = min(WORDS, max(1, len(x) // 2))
    model = spark.sparkContext.broadcast(fit(x, words=words))
    # Blocks are as full however many partitions the input has, so that what they hand on depends on its rows alone.
    parts = max(1, -(-total // BLOCK))
    coded = settle(vectors.coalesce(parts).mapInArrow(_coder(model), _CODED_SQL))
    n_blocks = max(1, -(-queries.count() // QUERIES))
    blocks = settle(queries.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("block")).agg(F.collect_list(F.struct("vec_id", "vec")).alias("q")).select("block", "q.vec_id", "q.vec").toDF("block", "qids", "qvecs"))
    met = coded.select("ids", "codes", "norms", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block")).join(blocks, "block")
    hits = met.mapInArrow(_scorer(model, rerank), "query_id bigint, vec_id bigint, estimate float")
    best = Window.partitionBy("query_id").orderBy("estimate", "vec_id")
    short = hits.withColumn("n", F.row_number().over(best)).where(F.col("n") <= rerank).select("query_id", "vec_id", "estimate")
    score = F.sqrt(F.aggregate(F.zip_with("vec", "qvec", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, y: s + y))
    asking = queries.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec"))
    mine = Window.partitionBy("query_id")
    order = mine.orderBy("score", "vec_id")

    def nearest_of(pairs):
        exact = pairs.join(vectors, "vec_id").join(asking, "query_id").withColumn("score", score).drop("vec", "qvec")
        return exact.withColumn("rank", F.row_number().over(order))

    first = nearest_of(short).withColumn("edge", F.max("estimate").over(mine)).withColumn("n", F.count("*").over(mine))
    first = settle(first.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "edge", "n"))
    if not close:
        return first.select("query_id", "rank", "vec_id", "score")
    # Beyond a full shortlist, a candidate is no nearer than the edge (less the rounding of its estimate) and the largest error allow.
    worst, longest = coded.agg(F.max("worst"), F.max("longest")).first()
    size = F.aggregate("qvec", F.lit(0.0), lambda s, y: s + y * y)
    bounds = first.where(F.col("n") >= rerank).groupBy("query_id").agg(F.max("score").alias("within"), F.max("edge").alias("edge")).join(asking, "query_id")
    open_ = F.sqrt(F.greatest(F.lit(0.0), F.col("edge") + size - 1e-4 * (size + longest))) - worst <= F.col("within")
    asked = settle(bounds.where(open_).select("query_id", F.col("qvec").alias("vec"), "within"))
    n_asked, more = asked.count(), []
    parts = -(-n_asked // ASKED)
    for i in range(parts):
        got = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).toArrow()
        if got.num_rows:
            sent = spark.sparkContext.broadcast((got["query_id"].to_numpy(), _rows(got, kind=float), got["within"].to_numpy()))
            more.append(coded.select("ids", "codes", "vecs", "errors").mapInArrow(_bounded(model, sent, k), "query_id bigint, vec_id bigint"))
    if not more:
        return first.select("query_id", "rank", "vec_id", "score")
    pairs = first.select("query_id", "vec_id")
    for found in more:
        pairs = pairs.union(found)
    return nearest_of(pairs.distinct()).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The ``k`` nearest found of every vector whose id is divisible by ``every``."""
    vectors = settle(usable(embeddings))
    return search(vectors, vectors.where(F.pmod("vec_id", F.lit(every)) == 0), k)


ORACLE = r"""
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, v.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
  FROM v q, v WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INT AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
"""
