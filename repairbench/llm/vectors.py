"""A query set meets all rows of a vector table, block by block: shared by the exact and the approximate search."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block, queries searched at once, and rows of the fixed-size sample that first thresholds come from.
ROW_BLOCK, QUERY_BATCH, PILOTS = 8192, 512, 2048
_FIELDS = "r_block int, dim int, is_query boolean, id long, least double, v array<double>"


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v array<double>: rows whose id and vector are there, and whose components are all finite."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)


def matrix(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """A list column, all lists of one length, as a matrix."""
    n = len(column)
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _with_least(batches, score: Callable, pilots, k: int):
    """The k-th best score of each query among the pilots (of other ids); none reach it: minus infinity."""
    ids, by_dim = pilots.value
    for batch in batches:
        least = np.full(batch.num_rows, -np.inf)
        q_ids, dims = batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy()
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            r = by_dim.get(int(dim))
            if r is None:
                continue
            for i in range(0, len(at), QUERY_BATCH):
                some = at[i : i + QUERY_BATCH]
                s = score(matrix(batch.column(1).take(pa.array(some))), r)
                s[q_ids[some][:, None] == ids[int(dim)][None, :]] = -np.inf
                if s.shape[1] >= k:
                    least[some] = np.partition(s, s.shape[1] - k, axis=1)[:, -k]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least)], ["id", "v", "least"])


def with_least(queries: DataFrame, rows: DataFrame, score: Callable, k: int) -> DataFrame:
    """id, v, least: a score that each query's k-th best row reaches for sure, from a sample of PILOTS rows.

    The sample only saves work: whatever it holds, the threshold is a lower bound.
    """
    pilots = rows.orderBy(F.xxhash64("id"), "id").limit(PILOTS).collect()
    ids, by_dim = {}, {}
    for dim in {len(r.v) for r in pilots}:
        ids[dim] = np.array([r.id for r in pilots if len(r.v) == dim], np.int64)
        by_dim[dim] = np.array([r.v for r in pilots if len(r.v) == dim])
    sent = queries.sparkSession.sparkContext.broadcast((ids, by_dim))
    return queries.select("id", "v").mapInArrow(partial(_with_least, score=score, pilots=sent, k=k), "id long, v array<double>, least double")


def _searched(batches, index: Callable, search: Callable, schema: pa.Schema):
    """Blocks come one after the other, each with its rows first; its index serves all queries that follow."""
    key, ids, vectors, built = None, [], [], None
    for batch in batches:
        block, dim, is_query = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
        edge = np.flatnonzero((np.diff(block) != 0) | (np.diff(dim) != 0) | (np.diff(is_query.astype(np.int8)) != 0)) + 1
        for i, j in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows], strict=True):
            if i == j:
                continue
            part = batch.slice(i, j - i)
            if (block[i], dim[i]) != key:
                key, ids, vectors, built = (block[i], dim[i]), [], [], None
            own, v = part.column(3).to_numpy(), matrix(part.column(5))
            if not is_query[i]:
                ids.append(own)
                vectors.append(v)
            elif ids:
                if built is None:
                    at = np.argsort(np.concatenate(ids), kind="stable")
                    built = index(np.concatenate(ids)[at], np.concatenate(vectors)[at])
                least = part.column(4).to_numpy()
                for k in range(0, j - i, QUERY_BATCH):
                    q, r, s = search(built, own[k : k + QUERY_BATCH], v[k : k + QUERY_BATCH], least[k : k + QUERY_BATCH])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((q, r, s), schema.types, strict=True)], schema.names)


def search_blocks(queries: DataFrame, rows: DataFrame, index: Callable, search: Callable, score_type: str, row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, vec_id, score: what `search` finds for each query (id, v, least) in each block of rows (id, v).

    A block is a hash of the id and the row's place in the scan, about `row_block` rows. Rows are dealt once, to
    their block; queries go to every block and stream through, so a task holds one block and one batch of queries.
    Vectors of another length never meet: the length is part of a block's key.
    """
    blocks = -(-max(1, rows.count()) // row_block)
    dealt = rows.select(F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("r_block"), F.size("v").alias("dim"), F.lit(False).alias("is_query"), "id", F.lit(None).cast("double").alias("least"), "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("r_block"), F.size("v").alias("dim"), F.lit(True).alias("is_query"), "id", "least", "v")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64() if score_type == "long" else pa.float64())])
    both = dealt.unionByName(asked).repartition("r_block", "dim").sortWithinPartitions("r_block", "dim", "is_query")
    return both.mapInArrow(partial(_searched, index=index, search=search, schema=schema), f"query_id long, vec_id long, score {score_type}")


def keep_best(held: tuple[np.ndarray, np.ndarray, np.ndarray], more: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k largest scores of each query, ties to the smaller id; sorted by query and rank."""
    q, r, s = (np.concatenate(x) for x in zip(held, more, strict=True))
    order = np.lexsort((r, -s, q))
    q, r, s = q[order], r[order], s[order]
    first = np.flatnonzero(np.diff(q, prepend=-1))
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    kept = place < k
    return q[kept], r[kept], s[kept]


def kth(best: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, floor: np.ndarray) -> np.ndarray:
    """The k-th score of each query, or its floor while it has fewer."""
    q, _, s = best
    out = floor.copy()
    last = np.flatnonzero(np.diff(q, append=-1))
    full = np.bincount(q, minlength=len(floor))[q[last]] >= k
    out[q[last[full]]] = np.maximum(out[q[last[full]]], s[last[full]])
    return out


def best(found: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first k rows (query_id, vec_id, score) of each query, ranked."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
