"""Line dedup with two Bloom filters: hashes seen once, hashes seen twice.

Each task sets a key's bits in its filter "once"; a key whose bits are all there already goes to "twice".
Filters of two tasks merge by ``twice = t1 | t2 | (o1 & o2)`` and ``once = o1 | o2``, block by block on Spark.
Every key of two or more documents is in "twice", so only suspected repeats shuffle, as 128-bit hashes,
to be counted exactly; false alarms of the filter drop out there.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bytes_list, free_name, read_table, small, tidied

_SPACE = b" \t\n\x0b\x0c\r"
#: Bits of one filter: about 8 for each expected key, between these powers of two (64 MB at most).
LEAST_BITS, MOST_BITS, BLOCK = 20, 29, 1 << 16


def _key(line: bytes, least: int) -> bytes | None:
    key = line.strip(_SPACE).lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return key


def _keys(text: bytes | None, least: int) -> set[bytes]:
    return {k for line in (text or b"").split(b"\n") if (k := _key(line, least)) is not None}


def _positions(keys: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    mask = np.uint64((1 << bits) - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def _get(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _set(packed: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(packed, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


@tidied
def _filters(batches, least: int, bits: int):
    once, twice = np.zeros(1 << (bits - 3), np.uint8), np.zeros(1 << (bits - 3), np.uint8)
    for batch in batches:
        seen: dict[bytes, int] = {}
        for text in bytes_list(batch.column(0)):
            for k in _keys(text, least):
                seen[k] = seen.get(k, 0) + 1
        p, q = _positions(list(seen), bits)
        again = (np.fromiter(seen.values(), np.int64, len(seen)) > 1) | (_get(once, p) & _get(once, q))
        for at in (p, q):
            _set(twice, at[again])
        for at in (p, q):
            _set(once, at)
    for k in range(0, len(once), BLOCK):
        if once[k : k + BLOCK].any():
            yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int64()), pa.array([once[k : k + BLOCK].tobytes()], pa.binary()), pa.array([twice[k : k + BLOCK].tobytes()], pa.binary())], ["k", "once", "twice"])


@tidied
def _merged(batches):
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for k, o, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            o, t = np.frombuffer(o, np.uint8), np.frombuffer(t, np.uint8)
            if k in held:
                a, b = held[k]
                held[k] = [a | o, b | t | (a & o)]
            else:
                held[k] = [o, t]
    for k, (_, t) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([t.tobytes()], pa.binary())], ["k", "twice"])


def _halves(key: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(key)
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


@tidied
def _suspects(batches, least: int, bits: int, twice):
    packed = np.frombuffer(twice.value, np.uint8)
    for batch in batches:
        ids, hi, lo = [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), bytes_list(batch.column(1)), strict=True):
            if not (keys := list(_keys(text, least))):
                continue
            p, q = _positions(keys, bits)
            for i in np.flatnonzero(_get(packed, p) & _get(packed, q)):
                a, b = _halves(keys[i])
                ids.append(doc_id)
                hi.append(a)
                lo.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, hi, lo)], ["doc_id", "hi", "lo"])


@tidied
def _rewritten(batches, least: int, text_at: int, names: list[str]):
    for batch in batches:
        *columns, lost = batch.columns
        texts, n_lines, n_dropped = bytes_list(columns[text_at]), [], []
        out = []
        for text, gone in zip(texts, lost.to_pylist(), strict=True):
            lines = (text or b"").split(b"\n")
            kept = lines
            if gone:
                gone = {(g["hi"], g["lo"]) for g in gone}
                kept = [x for x in lines if (k := _key(x, least)) is None or _halves(k) not in gone]
            out.append(b"\n".join(kept).decode())
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
        columns[text_at] = pa.array(out, pa.string())
        yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The input with repeated lines taken out of `text_col`, and n_lines (before) and n_dropped.

    A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Keys of at least
    `min_chars` code points in at least `min_docs` rows lose all their lines, but for the row of the largest id.

    A null or empty text is one empty line, and comes back as an empty text. Every row counts as a document;
    of rows that share the largest id all keep the line. Texts may have any length. Rows with a null id count, and never hold the
    largest. Input columns named n_lines or n_dropped are replaced; all others pass through.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    least = min_chars
    data = docs.drop("n_lines", "n_dropped")
    base = data.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bits = min(MOST_BITS, max(LEAST_BITS, int(docs.count() * 128).bit_length()))

    blocks = max(1, (1 << (bits - 3)) // BLOCK)
    made = base.select("text").mapInArrow(partial(_filters, least=least, bits=bits), "k long, once binary, twice binary")
    merged = made.repartition(min(blocks, 256), "k").mapInArrow(_merged, "k long, twice binary")
    packed = bytearray(1 << (bits - 3))
    for r in merged.toLocalIterator():  # 2 ** MOST_BITS bits at most, whatever the input
        packed[r.k * BLOCK : (r.k + 1) * BLOCK] = r.twice
    twice = spark.sparkContext.broadcast(bytes(packed))

    suspects = scratch.save(base.mapInArrow(partial(_suspects, least=least, bits=bits, twice=twice), "doc_id long, hi long, lo long"))
    repeated = suspects.groupBy("hi", "lo").agg(F.count("*").alias("c"), F.max("doc_id").alias("keeper")).where(F.col("c") >= min_docs).drop("c")
    repeated = scratch.save(repeated)
    lost = suspects.join(small(repeated), ["hi", "lo"]).where("doc_id IS NULL OR keeper IS NULL OR doc_id < keeper")
    gone, key = free_name("lost", data), free_name("lost_id", data)
    lost = lost.select("doc_id", "hi", "lo").distinct().groupBy("doc_id").agg(F.collect_list(F.struct("hi", "lo")).alias(gone))
    lost = scratch.save(lost.withColumnRenamed("doc_id", key))

    joined = data.join(small(lost, 250_000), F.col(id_col).cast("long").eqNullSafe(F.col(key)), "left").drop(key)
    joined = joined.withColumn(text_col, F.col(text_col).cast("string"))
    names = [*data.columns, "n_lines", "n_dropped"]
    fields = joined.drop(gone).schema.add("n_lines", "long").add("n_dropped", "long")
    return joined.mapInArrow(partial(_rewritten, least=least, text_at=data.columns.index(text_col), names=names), fields)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT d.doc_id, p.n, p.line,
         translate(trim(p.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM documents d,
       LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line,
                       generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) AS n) p),
repeated AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.*, r.k IS NOT NULL AND l.doc_id < r.keeper AS gone FROM lines l LEFT JOIN repeated r ON l.k = r.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
