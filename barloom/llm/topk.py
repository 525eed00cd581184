"""Exact top-k by inner product, term at a time.

Vectors become sparse rows of integer weights. Candidates lie in blocks, each
turned into postings (dimension -> places and weights). For every query row,
its nonzero terms scatter weight times posting into one dense array of scores
over the block; partition selection keeps the block's best, and the best of
all blocks are merged. Queries and candidates meet in a grid of cells: a block
of queries stays in memory, candidates stream past it in blocks, so neither
side is ever broadcast or gathered. Equal rows are one candidate with a count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import text_batches

#: Queries of a cell; candidates of a block; candidates of a cell if there are
#: cells enough for all cores. Long vectors fill a block by its bytes.
QUERY_BLOCK, CANDIDATE_BLOCK, CANDIDATE_CELL = 8192, 4096, 65536
BLOCK_BYTES = 16 << 20
LONG = 2**63 - 1


def integer_rows(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """``vec_id, w``: floor(scale * x) with x as double, kept as a double, which
    holds it exactly. Rows whose id or vector is null, or whose vector
    holds a null or a non-finite value, take no part; neither do doubles above
    7e305, whose weight is no finite double. An empty vector scores 0."""
    x = F.col("embedding")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * scale) < float("inf")))
    # from 2^52 on every double is whole
    floor = lambda v: F.when(F.abs(v) < float(1 << 52), F.floor(v).cast("double")).otherwise(v)
    weights = F.transform(x, lambda v: floor(v.cast("double") * scale))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), weights.alias("w"))


def dense(column: pa.Array) -> np.ndarray:
    """A matrix of the rows, short ones filled with zeros."""
    n = len(column)
    offsets = np.asarray(column.offsets, np.int64)
    size = np.diff(offsets)
    values = np.asarray(column.values, np.float64)[offsets[0] : offsets[-1]] if n else np.zeros(0)
    out = np.zeros((n, int(size.max(initial=0))))
    out[np.arange(out.shape[1])[None] < size[:, None]] = values
    return out


def alike(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows of about one length (up to twice), with their matrix:
    a long row never widens short ones."""
    kind = np.ceil(np.log2(np.maximum(np.diff(np.asarray(column.offsets, np.int64)), 1)))
    return [(at, dense(column.take(pa.array(at)))) for at in (np.flatnonzero(kind == x) for x in np.unique(kind))]


def stacked(blocks: list[np.ndarray]) -> np.ndarray:
    """One matrix of all rows, narrow ones filled with zeros."""
    out = np.zeros((sum(map(len, blocks)), max(b.shape[1] for b in blocks)))
    lo = 0
    for b in blocks:
        out[lo : lo + len(b), : b.shape[1]] = b
        lo += len(b)
    return out


def postings(block: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each dimension the places with a nonzero weight, and the weights."""
    out = []
    for t in range(block.shape[1]):
        at = np.flatnonzero(block[:, t])
        out.append((at, np.ascontiguousarray(block[at, t])))
    return out


def block_scores(query: np.ndarray, index: list[tuple[np.ndarray, np.ndarray]], n: int, kind) -> np.ndarray:
    """Scatter the weighted postings of the query's terms into an array of scores."""
    acc = np.zeros(n, kind)
    for t in np.flatnonzero(query[: len(index)]):
        at, weight = index[t]
        if len(at) == n:
            acc += query[t] * weight
        else:
            acc[at] += query[t] * weight
    return acc


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if score.dtype == object:
        return np.array(sorted(range(len(score)), key=lambda i: (-score[i], ids[i]))[:k], np.int64)
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def whole(x: np.ndarray, kind) -> np.ndarray:
    """Weights as numbers whose products and sums are exact."""
    if kind is not object:
        return x.astype(kind)
    out = np.zeros(x.shape, object)
    out[...] = [int(v) for v in x.ravel()] if x.ndim == 1 else [[int(v) for v in r] for r in x]
    return out


def exact_kind(a: float, b: float, terms: int):
    """The fastest numbers that hold every sum of ``terms`` products exactly."""
    big = a * b * max(1, terms)
    return np.float64 if big < 2**53 else np.int64 if big < 2**62 else object


def order_key(score: int) -> str:
    """Text that orders scores beyond 64 bits as their values; empty for others."""
    if -LONG < score < LONG:
        return ""
    digits = str(abs(score))
    key = f"{len(digits):05d}{digits}"
    return "+" + key if score > 0 else "-" + key.translate(str.maketrans("0123456789", "9876543210"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k best candidates
    (``vectors`` and ``queries`` as ``integer_rows`` gives them). Rows with the
    query's own id are no candidates of it. A query row that is repeated is
    answered once; two vectors under one query id are answered each, in one list
    of ranks a vector; candidate rows that are repeated take a rank each. Vectors
    of unlike lengths meet in the terms that both have. Scores are compared as
    whole numbers of any size; one beyond 64 bits is shown as the nearest long.
    Empty tables give no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    text_batches(spark)
    queries = queries.select("vec_id", "w").distinct()
    vectors = vectors.groupBy("vec_id", "w").agg(F.least(F.count("*"), F.lit(k)).alias("n"))
    n_queries, n = queries.count(), vectors.count()
    q_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    cells = max(1, -(-n // CANDIDATE_CELL), min(-(-n // CANDIDATE_BLOCK), 3 * spark.sparkContext.defaultParallelism // q_blocks))
    spread = lambda to: F.explode(F.sequence(F.lit(0), F.lit(to - 1)))
    q = queries.select(F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int").alias("q"), spread(cells).alias("cell"), F.lit(0).alias("kind"), "vec_id", F.xxhash64("w").alias("n"), "w")
    c = vectors.select(spread(q_blocks).alias("q"), F.pmod(F.xxhash64("vec_id", "w"), F.lit(cells)).cast("int").alias("cell"), F.lit(1).alias("kind"), "vec_id", "n", "w")
    grid = q.unionByName(c).repartition("q", "cell").sortWithinPartitions("q", "cell", "kind")

    def run(batches):
        cell, names, rows, top, most = None, [], [], {}, []

        def results():
            if top:
                found = [(*names[j], int(i), max(-LONG, min(LONG, int(s))), order_key(int(s))) for j, (ids, score) in sorted(top.items()) for i, s in zip(ids, score, strict=True)]
                cols = list(zip(*found, strict=True)) or [[]] * 5
                kinds = [pa.int64()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=["query_id", "variant", "vec_id", "score", "key"])

        def meet(ids, block, large):
            """All queries of the cell against a block."""
            ready: dict = {}
            for j, row in enumerate(rows):
                kind = exact_kind(most[j], large, min(len(row), block.shape[1]))
                if kind not in ready:
                    ready[kind] = [(at, whole(w, kind)) for at, w in postings(block)]
                score = block_scores(whole(row, kind), ready[kind], len(ids), kind)
                other = ids != names[j][0]
                own, score = (ids, score) if other.all() else (ids[other], score[other])
                at = best(score, own, k)
                if j in top:
                    if not top[j][1].dtype == score.dtype:
                        score, top[j] = whole(score, object), (top[j][0], whole(top[j][1], object))
                    own, score = np.concatenate([top[j][0], own[at]]), np.concatenate([top[j][1], score[at]])
                    at = best(score, own, k)
                top[j] = (own[at], score[at])

        def flush():
            """The waiting candidates, whatever batches they came in, as blocks of like length."""
            for parts in waiting.values():
                ids, block = np.concatenate([i for i, _ in parts]), stacked([b for _, b in parts])
                large = np.abs(block).max(1, initial=0)
                # the few vectors with weights beyond a float's whole numbers go by themselves
                huge = large >= 2.0**26
                for own in (~huge, huge):
                    if own.any():
                        meet(ids[own], block[own], float(large[own].max()))
            waiting.clear()

        waiting: dict = {}
        held = size = 0
        for batch in batches:
            keys = batch.column(0).to_numpy().astype(np.int64) * (1 << 32) + batch.column(1).to_numpy()
            mark = keys * 2 + batch.column(2).to_numpy()
            bounds = [0, *(np.flatnonzero(mark[1:] != mark[:-1]) + 1).tolist(), len(mark)]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if lo == hi:
                    continue
                if keys[lo] != cell:
                    flush()
                    held = size = 0
                    yield from results()
                    cell, names, rows, top, most = keys[lo], [], [], {}, []
                part = batch.slice(lo, hi - lo)
                ids, times = part.column(3).to_numpy(), part.column(4).to_numpy()
                for at, block in alike(part.column(5)):
                    if mark[lo] % 2 == 0:
                        names += zip(ids[at].tolist(), times[at].tolist(), strict=True)
                        rows += list(block)
                        most += np.abs(block).max(1, initial=0).tolist()
                        continue
                    again = np.repeat(np.arange(len(at)), times[at])
                    block = block[again]
                    waiting.setdefault(int(block.shape[1] - 1).bit_length(), []).append((ids[at][again], block))
                    held, size = held + len(block), size + block.nbytes
                    if held >= CANDIDATE_BLOCK or size >= BLOCK_BYTES:
                        flush()
                        held = size = 0
        flush()
        yield from results()

    part = grid.mapInArrow(run, "query_id long, variant long, vec_id long, score long, key string")
    order = Window.partitionBy("query_id", "variant").orderBy(F.col("score").desc(), F.col("key").desc(), "vec_id")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w::DOUBLE[], c.w::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
