"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each Spark partition.

Encoding: the distinct pattern matches of many texts become token-position rows. A recursive query joins adjacent
rows of a word to the merge table and contracts each word's leftmost pair of minimum rank, until no pair merges.
In long words a step contracts every disjoint pair of that rank, from the left, where no pair made by it can have
a smaller rank: the same order in fewer steps. A query stops after a bounded number of rows and goes on from its
last state, so no word is too long. Decoding: token-position rows join the vocabulary, and an ordered aggregation
puts the bytes together.
"""

from __future__ import annotations

import base64
from functools import partial

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table
from .tokens import Encoder, Memo, flat_texts, text_chunks

#: Words in one query, bytes from which a word takes the query for long ones, rows of all steps of one query, ids decoded in one query.
QUERY_WORDS, LONG, STATE_ROWS, DECODE_IDS = 25_000, 64, 4_000_000, 1 << 18

# A row knows the token after it; a pair contracts into its right row, whose next token stays.
MERGE = """
WITH RECURSIVE state AS (
  SELECT 0::INT AS step, w, pos, id, next FROM word_tokens
  UNION ALL
  SELECT s.step + 1, s.w, (s.pos - (s.pos > best.pos)::INT)::INT, CASE WHEN s.pos = best.pos + 1 THEN best.id ELSE s.id END, CASE WHEN s.pos = best.pos - 1 THEN best.id ELSE s.next END
  FROM state s JOIN (
    SELECT w, (k % 65536)::INT AS pos, (k // 65536)::INT AS id FROM (
      SELECT t.w, min(m.id * 65536::BIGINT + t.pos) AS k FROM state t JOIN merges m ON m.pair = t.id * 2147483648::BIGINT + t.next
      WHERE t.step < {steps} GROUP BY t.w)) best ON s.w = best.w
  WHERE s.pos <> best.pos)
SELECT w, step, pos, id FROM state
"""
MERGE_LONG = """
WITH RECURSIVE state AS (
  SELECT 0::INT AS step, w, pos, id, next FROM word_tokens
  UNION ALL
  (WITH pairs AS (
     SELECT t.w, t.pos, m.id, m.clean FROM state t JOIN merges m ON m.pair = t.id * 2147483648::BIGINT + t.next WHERE t.step < {steps}),
   least AS (SELECT w, min(id) AS id FROM pairs GROUP BY w),
   runs AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY pos) AS place FROM pairs SEMI JOIN least USING (w, id)),
   chosen AS (
     SELECT w, pos, id FROM (SELECT *, row_number() OVER (PARTITION BY w, pos - place ORDER BY pos) AS nth FROM runs)
     WHERE nth % 2 = 1 AND (clean OR place = 1)),
   merged AS (
     SELECT s.step, s.w, s.pos, coalesce(c.id, s.id) AS id FROM state s SEMI JOIN least t ON s.w = t.w
     LEFT JOIN chosen c ON s.w = c.w AND s.pos = c.pos ANTI JOIN chosen d ON s.w = d.w AND s.pos = d.pos + 1)
   SELECT step + 1, w, (row_number() OVER place - 1)::INT, id, lead(id, 1, -1) OVER place FROM merged WINDOW place AS (PARTITION BY w ORDER BY pos)))
SELECT w, step, pos, id FROM state
"""
DECODE = "SELECT string_agg(bytes, '' ORDER BY pos) FROM run_tokens JOIN vocabulary USING (id)"


class DuckBpe:
    """Encoder and decoder of one rank file, kept for the life of a Python worker."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        # A token is clean if no pair that holds it merges to a smaller rank than its own.
        clean = np.ones(max(ranks.values()) + 1, bool)
        for left, right, r in pairs:
            clean[left] &= r > left
            clean[right] &= r > right
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes_of[list(ranks.values())] = [len(t) for t in ranks]
        left, right, merged = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self.db.register("m", pa.table({"pair": left * (1 << 31) + right, "id": merged.astype(np.int32), "clean": clean[merged]}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m")
        # A byte is held as the character of its number.
        self.db.register("v", pa.table({"id": pa.array(ranks.values(), pa.int32()), "bytes": [t.decode("latin-1") for t in ranks]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM v")
        self.words = Memo(self.merge)
        self.encode = Encoder(self.encode_parts)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32-bit) of words, each merged to its fixpoint."""
        out: list[bytes] = [b""] * len(words)
        for query, which, most in ((MERGE, [i for i, w in enumerate(words) if len(w) <= LONG], QUERY_WORDS), (MERGE_LONG, [i for i, w in enumerate(words) if len(w) > LONG], 1)):
            for k in range(0, len(which), most):
                some = which[k : k + most]
                for i, ids in zip(some, self._fixpoint(query, [words[i] for i in some]), strict=True):
                    out[i] = ids
        return out

    def _fixpoint(self, query: str, words: list[bytes]) -> list[bytes]:
        out, which = [b""] * len(words), np.arange(len(words))
        size = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        while len(which):
            first, steps = np.cumsum(size) - size, max(4, STATE_ROWS // max(1, len(ids)))
            after = np.append(ids[1:], -1).astype(np.int32)
            after[first + size - 1] = -1
            rows = pa.table({"w": np.repeat(np.arange(len(size), dtype=np.int32), size), "pos": (np.arange(size.sum()) - np.repeat(first, size)).astype(np.int32), "id": ids, "next": after})
            self.db.register("word_tokens", rows)
            done = self.db.sql(query.format(steps=steps)).to_arrow_table()
            w, step, pos, ids = (done[c].to_numpy() for c in ("w", "step", "pos", "id"))
            last = np.zeros(len(size), np.int32)
            np.maximum.at(last, w, step)
            kept = np.flatnonzero(step == last[w])
            kept = kept[np.lexsort((pos[kept], w[kept]))]
            w, ids = w[kept], ids[kept]
            at = np.searchsorted(w, np.arange(len(size) + 1))
            raw, more = ids.astype("<i4").tobytes(), last >= steps
            for k in np.flatnonzero(~more).tolist():
                out[which[k]] = raw[4 * at[k] : 4 * at[k + 1]]
            ids = ids[np.repeat(more, np.diff(at))]
            which, size = which[more], np.diff(at)[more]
        return out

    def encode_parts(self, parts: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32-bit) of texts: those of their pattern matches in order."""
        find = self.pattern.findall
        split = [find(p.decode()) for p in parts]
        words = list(dict.fromkeys(m for s in split for m in s))
        ids = dict(zip(words, self.words([w.encode() for w in words]), strict=True))
        return [ids[s[0]] if len(s) == 1 else b"".join([ids[m] for m in s]) for s in split]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of the id arrays ids[at[i]:at[i + 1]] together, and where each begins."""
        out = []
        for k in range(0, len(ids), DECODE_IDS):
            some = ids[k : k + DECODE_IDS].astype(np.int32)
            self.db.register("run_tokens", pa.table({"pos": np.arange(len(some), dtype=np.int32), "id": some}))
            out.append(self.db.sql(DECODE).fetchall()[0][0].encode("latin-1"))
        return b"".join(out), np.concatenate([[0], np.cumsum(self.bytes_of[ids])])[at]


_open: dict[tuple[str, str], DuckBpe] = {}


def _engine(path: str, pattern: str) -> DuckBpe:
    if (path, pattern) not in _open:
        _open.clear()
        _open[path, pattern] = DuckBpe(path, pattern)
    return _open[path, pattern]


def _encode(batches, path: str, pattern: str):
    bpe = _engine(path, pattern)
    for batch in batches:
        keys, (raw, offsets) = batch.column(0), flat_texts(batch.column(1))
        for i, j in text_chunks(offsets):
            ids, at = bpe.encode(raw, offsets[i : j + 1])
            yield pa.RecordBatch.from_arrays([keys[i:j], pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])


def _decode(batches, path: str, pattern: str):
    bpe = _engine(path, pattern)
    for batch in batches:
        sizes = np.array([0 if n is None else n for n in batch.column(1).value_lengths().to_pylist()], np.int64)
        values, at = batch.column(1).flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
        for i, j in text_chunks(4 * at):
            text, first = bpe.decode(values[at[i] : at[j]], at[i : j + 1] - at[i])
            decoded = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(first.astype(np.int32)), pa.py_buffer(text)])
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], decoded], ["doc_id", "ids", "decoded"])


def bpe_encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: a row for each row. A null or empty text has no ids; ids of rows may repeat or be null.

    `ranks` is a file of base64 tokens and ranks; matches of `pattern` are merged separately, without special tokens.
    Texts and words may have any length; an empty table gives none.
    """
    base = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return base.mapInArrow(partial(_encode, path=ranks, pattern=pattern), "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, ids, decoded binary. Null ids decode to no bytes."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, path=ranks, pattern=pattern), "doc_id long, ids array<int>, decoded binary")


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = bpe_decode(bpe_encode(read_table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)
    digest = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
