"""Nearest neighbours by a block matrix join: int8 tiles with error bounds, survivors again in double precision."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import stored

K = 20
QUERY_EVERY = 20
#: Mean rows of a block of queries and of candidates; a tile is one of each.
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 4096


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of scale * code, and norms of what the codes leave out (rounded up)."""
    scale = np.abs(vectors).max(axis=1) / 127.0
    codes = np.rint(vectors / np.where(scale > 0, scale, 1.0)[:, None])
    close = codes * scale[:, None]
    left = np.linalg.norm(vectors - close, axis=1)
    return codes.astype(np.int8), scale, np.linalg.norm(close, axis=1) * (1 + 1e-9), left * (1 + 1e-9)


def int8_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products; in float32 by slices of columns short enough to be exact."""
    out = np.zeros((len(left), len(right)))
    for at in range(0, left.shape[1], 1024):  # 1024 * 127 * 127 < 2 ** 24
        out += left[:, at : at + 1024].astype(np.float32) @ right[:, at : at + 1024].astype(np.float32).T
    return out


def exact_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row inner products in double precision, summed from the first component on."""
    total = np.zeros(len(left))
    for d in range(left.shape[1]):
        total += left[:, d] * right[:, d]
    return total


def tile(queries: tuple, candidates: tuple, k: int) -> Iterator[tuple[int, list[int], list[float]]]:
    """For each query of the tile its k nearest in the tile, nearest first.

    The product of two vectors differs from that of their codes by at most
    |code_x| left_y + |code_y| left_x + left_x left_y. A pair survives if its
    upper bound reaches the k-th largest lower bound of its query.
    """
    (q_ids, q), (c_ids, c) = queries, candidates
    qc, qs, qn, ql = quantised(q)
    cc, cs, cn, cl = quantised(c)
    for at in range(0, len(q), 256):
        part = slice(at, at + 256)
        near = int8_products(qc[part], cc) * qs[part, None] * cs
        slack = qn[part, None] * cl + ql[part, None] * cn + ql[part, None] * cl
        slack += 1e-9 * (qn[part, None] + ql[part, None]) * (cn + cl)  # rounding of the doubles themselves
        own = q_ids[part, None] == c_ids
        low = np.where(own, -np.inf, near - slack)
        if low.shape[1] > k:
            bar = -np.partition(-low, k - 1, axis=1)[:, k - 1]
        else:
            bar = np.full(len(low), -np.inf)
        rows, cols = np.nonzero((near + slack >= bar[:, None]) & ~own)
        scores = exact_products(q[part][rows], c[cols])
        order = np.lexsort((c_ids[cols], -scores, rows))
        rows, cols, scores = rows[order], cols[order], scores[order]
        starts = np.searchsorted(rows, np.arange(len(low) + 1))
        for i in range(len(low)):
            a, b = starts[i], min(starts[i] + k, starts[i + 1])
            if b > a:
                yield int(q_ids[at + i]), c_ids[cols[a:b]].tolist(), scores[a:b].tolist()


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """The k nearest of ``vectors`` to each of ``queries`` (both ``vec_id``, ``embedding``) by inner product.

    Columns query_id, rank (from 1), vec_id, score; nearest first, ties to the
    smaller vec_id; a query's own vec_id is no candidate. The result is exact:
    the bounds only leave out pairs that cannot be among the k nearest.

    Take no part: null ids; vectors null, empty, zero, or holding null or
    non-finite components. Vectors of different length are not compared. Of rows
    that share a vec_id one counts, the smallest array. Other columns are not read.
    The blocks follow the number of rows, so a task holds two blocks at any size.
    """

    def usable(frame: DataFrame) -> DataFrame:
        frame = frame.select(
            F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
        )
        finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        some = F.exists("embedding", lambda x: x != 0)
        frame = frame.where("vec_id IS NOT NULL").where(F.coalesce(finite & some, F.lit(False)))
        return frame.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))

    vectors, queries = stored(usable(vectors)), stored(usable(queries))
    n_query = max(1, -(-queries.count() // query_block))
    n_candidate = max(1, -(-vectors.count() // candidate_block))

    def blocks(frame: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        frame = frame.withColumn("dim", F.size("embedding"))
        frame = frame.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(n_own)).cast("int"))
        return frame.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    left = blocks(queries, "_q", n_query, "_c", n_candidate)
    right = blocks(vectors, "_c", n_candidate, "_q", n_query)

    def joined(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found: list = []
        if len(q) and len(c):
            sides = [(f["vec_id"].to_numpy(np.int64), np.stack(f["embedding"].to_numpy()).astype(float)) for f in (q, c)]
            found = list(tile(*sides, k))
        return pd.DataFrame(found, columns=["query_id", "ids", "scores"])

    keys = ["_q", "_c", "dim"]
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        joined, "query_id long, ids array<long>, scores array<double>"
    )
    lists = lists.repartition("query_id").sortWithinPartitions("query_id")

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Heap-merge the lists of each query, k rows at most; the lists of one query may lie in two batches."""
        now, best = None, []

        def rows(query: int, best: list) -> list[tuple]:
            return [(query, i + 1, vec, -score) for i, (score, vec) in enumerate(best)]

        for batch in batches:
            out: list[tuple] = []
            for query, ids, scores in zip(batch["query_id"], batch["ids"], batch["scores"], strict=True):
                if query != now:
                    out += rows(now, best)
                    now, best = query, []
                more = [(-s, v) for s, v in zip(scores, ids, strict=True)]
                best = [x for _, x in zip(range(k), heapq.merge(best, more), strict=False)]
            yield pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])
        yield pd.DataFrame(rows(now, best), columns=["query_id", "rank", "vec_id", "score"])

    return lists.mapInPandas(merged, "query_id long, rank int, vec_id long, score double")


def op4_query(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, embeddings.where(F.col("vec_id") % QUERY_EVERY == 0))


ORACLE = f"""
WITH usable AS (
  SELECT vec_id, min(embedding)::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), lambda a, b: a + b) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {QUERY_EVERY} = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
