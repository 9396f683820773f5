"""Exact top-k search by inner product over multi-resolution segment statistics.

With a vector cut in segments of length l, each of mean m and deviation s, the inner product of two vectors is
at most the sum of l * (m1 * m2 + s1 * s2) over segments (Cauchy-Schwarz within a segment), which is a lower
bound on their distance. Bounds go from few long segments to many short ones; only pairs whose bound reaches
the query's present k-th score are looked at again, and the surviving pairs get their exact score. The k-th score
starts from a sample of rows, so every block of rows knows a threshold from the beginning.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import ROW_BLOCK, best, keep_best, kth, search_blocks, usable, with_least

RESOLUTIONS = (4, 16)
#: Rows whose bounds are taken at once, and the share of pairs above which a whole block product is cheaper.
TILE, DENSE = 512, 0.05


def segment_statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """For each vector the means, then the deviations of its segments, each times the root of the segment's length."""
    edges = np.linspace(0, v.shape[1], min(segments, v.shape[1]) + 1).astype(int)
    size = np.diff(edges)
    means = np.add.reduceat(v, edges[:-1], axis=1) / size
    spread = np.sqrt(np.maximum(np.add.reduceat((v - np.repeat(means, size, axis=1)) ** 2, edges[:-1], axis=1), 0))
    return np.hstack([means * np.sqrt(size), spread])


def grid(v: np.ndarray) -> np.ndarray:
    return np.floor(64 * v)


def _score(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Lower bounds of scores: exact products, less what rounding could add to large ones."""
    s = grid(q) @ grid(r).T
    return s - 1e-9 * np.abs(s)


def _index(ids: np.ndarray, v: np.ndarray):
    # Long vectors first: they have the high scores, and raise the thresholds early.
    order = np.argsort(-np.linalg.norm(v, axis=1), kind="stable")
    r = grid(v[order])
    return ids[order], r, [segment_statistics(r, s) for s in RESOLUTIONS]


def pairwise(a: np.ndarray, b: np.ndarray, dense: bool, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (a[i], b[j]): from a block product if that is cheaper, else one by one."""
    return (a @ b.T)[i, j] if dense else np.einsum("ij,ij->i", a[i], b[j])


def _search(index, q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int):
    ids, r, levels = index
    q = grid(q)
    if np.abs(q).max() * np.abs(r).max() * q.shape[1] >= 2.0**52:
        return _search_large(ids, r, q_ids, q, k)
    own = [segment_statistics(q, s) for s in RESOLUTIONS]
    none = np.zeros(0, np.int64)
    held = (none, none, np.zeros(0))
    for a in range(0, len(ids), TILE):
        b = slice(a, a + TILE)
        floor = kth(held, k, least)
        i, j = np.nonzero(q_ids[:, None] != ids[b][None, :])
        size = len(q_ids) * len(ids[b])
        for mine, theirs in zip(own, levels, strict=True):
            bound = pairwise(mine, theirs[b], len(i) > DENSE * size, i, j)
            reach = bound + 1e-9 * np.abs(bound) + 1e-6 >= floor[i]
            i, j = i[reach], j[reach]
        if len(i):
            s = pairwise(q, r[b], len(i) > DENSE * size, i, j)
            good = s >= floor[i]
            held = keep_best(held, (i[good], ids[b][j[good]], s[good]), k)
    at, found, s = held
    return q_ids[at], found, s.astype(np.int64)


def _search_large(ids: np.ndarray, r: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int):
    """Products beyond the integers that doubles hold: whole numbers of any size; scores end at those of 64 bits."""
    whole = [[int(x) for x in row] for row in r.tolist()]
    out: tuple[list, list, list] = ([], [], [])
    low, high = -(1 << 63), (1 << 63) - 1
    for a, row in zip(q_ids.tolist(), q.tolist(), strict=True):
        row = [int(x) for x in row]
        scored = sorted((-min(max(sum(x * y for x, y in zip(row, w, strict=True)), low), high), b) for b, w in zip(ids.tolist(), whole, strict=True) if a != b)
        for s, b in scored[:k]:
            for c, x in zip(out, (a, b, -s), strict=True):
                c.append(x)
    return tuple(np.array(c, np.int64) for c in out)


def exact_top_k(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k rows of largest integer inner product, ties to the smaller id.

    Components become floor(64 * x) first. A query's own id is no candidate. Rows with a null id, and vectors
    that are null, empty or hold null or non-finite components take no part, nor do pairs of unequal length.
    Repeated rows are candidates of their own. An empty side gives no rows. Products too large for doubles are
    taken in whole numbers, and scores stop at the largest and smallest long.
    """
    real = lambda df: usable(df, id_col, vec_col).where(~F.exists("v", lambda x: F.abs(x) >= 2.0**1017))
    asked = with_least(real(queries), real(rows), _score, k)
    found = search_blocks(asked, real(rows), _index, partial(_search, k=k), "long", row_block)
    return best(found, k, [F.desc("score"), F.asc("vec_id")])


def op3_exact_top_k(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return exact_top_k(rows, rows.where("vec_id % 20 = 0"), 20)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.v::DOUBLE[], r.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""
