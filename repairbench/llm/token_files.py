"""Token ids in directly addressable codes, written as segments of a Parquet table.

A segment holds the ids of consecutive documents. Level k holds chunk k (8 bits) of every id that has one, in
order; its bitmap says which of these ids go on to level k + 1, and its rank directory holds the ones before
each 64-bit word. Id i is read from level 0 at i, from level 1 at rank(i), and so on: no block is decoded.

One row for each segment: part, segment, doc_ids, doc_tokens, n_tokens, levels(codes, more, ranks).
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, read_table, small
from .tokens import flat_texts, library_encoder, text_chunks

SEGMENT_TOKENS = 1 << 20
LEVEL = pa.struct([("codes", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])
SCHEMA = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("levels", pa.list_(LEVEL))])
DDL = "part int, segment int, doc_ids array<long>, doc_tokens array<long>, n_tokens long, levels array<struct<codes: binary, more: binary, ranks: binary>>"


def encode_codes(ids: np.ndarray) -> list[dict[str, bytes]]:
    """Levels of directly addressable codes of an array of unsigned 32-bit ids."""
    levels, rest = [], ids.astype(np.uint32)
    while len(rest) or not levels:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        words = np.zeros(-(-len(bits) // 8) * 8, np.uint8)
        words[: len(bits)] = bits
        ones = np.bitwise_count(words.view("<u8")).astype(np.int64)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]) if len(ones) else ones
        levels.append({"codes": (rest & 255).astype(np.uint8).tobytes(), "more": words.tobytes(), "ranks": ranks.astype("<u4").tobytes()})
        rest = rest[more] >> 8
    return levels


class Codes:
    """Random access to the ids of a segment."""

    def __init__(self, levels: list[dict[str, bytes]]):
        self.levels = [(np.frombuffer(x["codes"], np.uint8), np.frombuffer(x["more"], "<u8"), np.frombuffer(x["ranks"], "<u4")) for x in levels]

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """Ids at the given positions."""
        out, which, at = np.zeros(len(at), np.uint32), None, np.asarray(at, np.int64)
        for k, (codes, more, ranks) in enumerate(self.levels):
            piece = codes[at].astype(np.uint32) << np.uint32(8 * k)
            if which is None:
                out = piece
            else:
                out[which] |= piece
            word, bit = more[at >> 6], (at & 63).astype(np.uint64)
            goes_on = (word >> bit) & np.uint64(1) > 0
            if not goes_on.any():
                break
            at, word, bit = at[goes_on], word[goes_on], bit[goes_on]
            before = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            which = np.flatnonzero(goes_on) if which is None else which[goes_on]
            at = ranks[at >> 6].astype(np.int64) + before
        return out


def _segments(batches, path: str, end_id: int, most: int):
    part, encode, end = TaskContext.get().partitionId(), library_encoder(path), np.array([end_id], "<u4")
    doc_ids, sizes, parts, held, segment = [], [], [], 0, 0

    def row() -> pa.RecordBatch:
        ids = np.concatenate(parts)
        row = {"part": part, "segment": segment, "doc_ids": doc_ids, "doc_tokens": sizes, "n_tokens": len(ids), "levels": encode_codes(ids)}
        return pa.RecordBatch.from_pylist([row], SCHEMA)

    for batch in batches:
        (raw, offsets), keys = flat_texts(batch.column(1)), batch.column(0).to_pylist()
        for i, j in text_chunks(offsets):
            ids, at = encode(raw, offsets[i : j + 1])
            at = at.tolist()
            for k in range(j - i):
                n = at[k + 1] - at[k] + 1
                doc_ids.append(keys[i + k])
                sizes.append(n)
                parts += [ids[at[k] : at[k + 1]], end]
                held += n
                if held >= most:
                    yield row()
                    doc_ids, sizes, parts, held, segment = [], [], [], 0, segment + 1
    if parts:
        yield row()


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, segment_tokens: int = SEGMENT_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all texts, each followed by `end_id`, in ascending id order.

    Parts are ranges of the id, segments follow each other within a part. Null texts are empty; null ids come
    first; rows that share an id are ordered by their text. A document longer than a segment is one segment.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = base.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    ordered.mapInArrow(partial(_segments, path=vocabulary, end_id=end_id, most=segment_tokens), DDL).write.parquet(path)


def token_directory(files: DataFrame) -> DataFrame:
    """part, segment, first: ids in all segments before each segment."""
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row for each written part; a segment's place within its part needs no other part.
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_tokens")
    return files.select("part", "segment", inside.alias("inside")).join(small(before), "part").select("part", "segment", (F.col("base") + F.col("inside")).alias("first"))


def _read(batches, at_once: int = 1 << 18):
    """The documents of each segment, whose ids are looked up `at_once` or one document at a time."""
    for batch in batches:
        for row in batch.to_pylist():
            codes, sizes = Codes(row["levels"]), np.array(row["doc_tokens"], np.int64)
            ends = np.cumsum(sizes)
            i, start = 0, 0
            while i < len(sizes):
                j = max(i + 1, int(np.searchsorted(ends, start + at_once, side="right")))
                raw = codes[np.arange(start, ends[j - 1])].astype("<u4").view(np.uint8)
                places = (4 * (np.append(ends[i:j] - sizes[i:j], ends[j - 1]) - start)).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(raw))])
                firsts = row["first"] + ends[i:j] - sizes[i:j]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"][i:j], pa.int64()), pa.array(firsts), pa.array(sizes[i:j]), ids], ["doc_id", "start", "n_tokens", "ids"])
                i, start = j, int(ends[j - 1])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)."""
    files = spark.read.parquet(path)
    first = small(token_directory(files.select("part", "segment", "n_tokens")))
    return files.join(first, ["part", "segment"]).select("doc_ids", "doc_tokens", "levels", "first").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{Scratch(spark, 'tokens').root}/files"
    write_token_files(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
