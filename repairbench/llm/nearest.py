"""Approximate nearest neighbours: stable projections in a kd-tree, a chi-square test to stop.

Vectors of length one go through a few 2-stable (Gaussian) projections, and each block of rows has one kd-tree over
its projections. A query walks down the tree, takes the leaves it reaches in the order of their projected distance,
and verifies rows on the original vectors. If a row lies within distance d, its squared projected distance over d
squared follows a chi-square law of `projections` degrees. So a node, leaf or row further than the quantile `sure` of
that law times the present k-th distance is left out: a nearer row would have been met with probability `sure`.
The k-th distance starts from a sample of rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import ROW_BLOCK, best, keep_best, kth, search_blocks, usable, with_least

PROJECTIONS, SURE, LEAF = 8, 0.97, 256


def chi_square_quantile(degrees: int, p: float) -> float:
    """For an even number of degrees: the law is 1 - exp(-x/2) * sum((x/2)^i / i!), inverted by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        term = total = np.exp(-x / 2)
        for i in range(1, degrees // 2):
            term *= x / 2 / i
            total += term
        low, high = (x, high) if 1 - total < p else (low, x)
    return x


def unit(v: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled by their largest component first, so that no square over- or underflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _cosines(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    return unit(q) @ unit(r).T - 1e-9


class KdTree:
    """Cuts at the median of a node's widest side until `leaf` rows are left; each node knows its box."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.rows = np.arange(len(points))
        self.low, self.high, self.left, self.span = [], [], [], []
        todo = [(0, len(points))]
        for a, b in todo:  # children are added behind, in pairs
            rows = self.rows[a:b]
            box = points[rows]
            self.low.append(box.min(axis=0))
            self.high.append(box.max(axis=0))
            self.span.append((a, b))
            if b - a <= leaf:
                self.left.append(-1)
                continue
            side = np.ptp(box, axis=0).argmax()
            self.rows[a:b] = rows[np.lexsort((rows, box[:, side]))]
            self.left.append(len(todo))
            todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
        self.low, self.high, self.left, self.span = (np.array(x) for x in (self.low, self.high, self.left, self.span))

    def reached(self, points: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, leaf, squared distance) of the leaves whose path of boxes lies within each point's limit."""
        q, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        out = []
        while len(q):
            away = (np.maximum(np.maximum(self.low[node] - points[q], points[q] - self.high[node]), 0) ** 2).sum(axis=1)
            near = away <= limit[q]
            q, node, away = q[near], node[near], away[near]
            end = self.left[node] < 0
            out.append((q[end], node[end], away[end]))
            q, node = np.repeat(q[~end], 2), np.repeat(self.left[node[~end]], 2)
            node[1::2] += 1
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _index(ids: np.ndarray, v: np.ndarray, projections: int, seed: int):
    across = np.random.default_rng(seed).standard_normal((v.shape[1], projections))
    r = unit(v)
    low = r @ across
    tree = KdTree(low)
    return ids[tree.rows], r[tree.rows], low[tree.rows], tree, across


def _search(index, q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int, limit: float, count=None):
    ids, r, r_low, tree, across = index
    q = unit(q)
    q_low = q @ across
    none = np.zeros(0, np.int64)
    held, floor = (none, none, np.zeros(0)), least
    reach = lambda s: limit * np.maximum(0.0, 2 - 2 * s)  # squared distance of unit vectors: 2 - 2 cos
    who, leaf, away = tree.reached(q_low, reach(floor))
    order = np.lexsort((leaf, away, who))
    who, leaf, away = who[order], leaf[order], away[order]
    first = np.flatnonzero(np.diff(who, prepend=-1))
    place = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
    # In round t each query takes its t-th leaf; queries at the same leaf share a product.
    by_round = np.argsort(place, kind="stable")
    for at in np.split(by_round, np.flatnonzero(np.diff(place[by_round])) + 1) if len(by_round) else []:
        at = at[away[at] <= reach(floor[who[at]])]
        found = []
        at = at[np.argsort(leaf[at], kind="stable")]
        for some in np.split(at, np.flatnonzero(np.diff(leaf[at])) + 1) if len(at) else []:
            a, b = tree.span[leaf[some[0]]]
            w = who[some]
            far = ((q_low[w][:, None, :] - r_low[a:b][None, :, :]) ** 2).sum(axis=2)
            i, j = np.nonzero((far <= reach(floor[w])[:, None]) & (q_ids[w][:, None] != ids[a:b][None, :]))
            if count is not None:
                count.append(len(i))
            near = (q[w] @ r[a:b].T)[i, j] >= floor[w][i] - 1e-9
            i, j = w[i[near]], a + j[near]
            # the same sum for equal vectors, whatever block they are in
            found.append((i, ids[j], (q[i] * r[j]).sum(axis=1)))
        if found:
            held = keep_best(held, tuple(np.concatenate(x) for x in zip(*found, strict=True)), k)
            floor = kth(held, k, least)
    at, found, s = held
    return q_ids[at], found, s


def nearest(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", row_block: int = ROW_BLOCK, projections: int = PROJECTIONS, sure: float = SURE, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k nearest rows found, by cosine, ties to the smaller id.

    A query's own id is no candidate. Rows with a null id, and vectors that are null, empty, zero or hold null or
    non-finite components take no part, nor do pairs of unequal length. Repeated rows are candidates of their
    own. Every row is indexed, in the block it falls in. `projections` is even. An empty side gives no rows.
    While a query has fewer than k rows nothing is left out, so it gets k rows if there are as many.
    """
    real = lambda df: usable(df, id_col, vec_col).where(F.exists("v", lambda x: x != 0))
    asked = with_least(real(queries), real(rows), _cosines, k)
    search = partial(_search, k=k, limit=chi_square_quantile(projections, sure))
    found = search_blocks(asked, real(rows), partial(_index, projections=projections, seed=seed), search, "double", row_block)
    return best(found, k, [F.desc("score"), F.asc("vec_id")])


def op7_nearest(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 50 = 0"), 5)
