"""Bounded-space online packing of token ids into sequences.

Every partition keeps a fixed number of open windows. Whole stretches of a document go out at once; the rest
goes best-fit into the window it leaves least room in. When none fits, it tops up the fullest window, which is
emitted, and what is left of it goes on. Windows still open at the end of a partition are merged by a second,
much smaller pass; there a last window is cut at powers of two, so no sequence needs padding.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, read_table, tidied
from .tokens import MEMO, close_encoders, flat_texts, library_encoder, text_chunks

FIELDS = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_COLUMNS = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
_MERGED = 1 << 62
_OUT_ROWS = 2000


class Packer:
    """Places pieces (doc_id, start, ids, doc_tokens) in windows of `length`; `out` collects emitted rows."""

    def __init__(self, length: int, windows: int, first_id: int):
        self.length, self.windows, self.next_id = length, windows, first_id
        self.open: list[list] = []  # each: [used, pieces]
        self.out: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc_id, start, n, ids, total, self.next_id, offset))
            offset += n
        self.next_id += 1

    def add_document(self, doc_id, ids: bytes) -> None:
        total, size = len(ids) // 4, 4 * self.length
        whole = len(ids) // size * size
        for at in range(0, whole, size):
            self.emit([(doc_id, at // 4, ids[at : at + size], total)])
        if whole < len(ids):
            self.add([(doc_id, whole // 4, ids[whole:], total)])

    def add(self, pieces: list[tuple]) -> None:
        """Places pieces that together are shorter than a window."""
        while pieces:
            need = sum(len(p[2]) for p in pieces) // 4
            fits = [w for w in self.open if w[0] + need <= self.length]
            if fits:
                w = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.windows:
                self.open.append(w := [0, []])
            else:
                w = max(self.open, key=lambda w: w[0])
            now, pieces = cut(pieces, self.length - w[0])
            w[1] += now
            w[0] += sum(len(p[2]) for p in now) // 4
            if w[0] == self.length:
                self.open.remove(w)
                self.emit(w[1])

    def close(self) -> None:
        """Joins the open windows into full ones; the last is cut at powers of two."""
        pieces = [p for w in self.open for p in w[1]]
        left, size = sum(w[0] for w in self.open), self.length
        self.open = []
        while left:
            while size > left:
                size = 1 << (min(size, left + 1) - 1).bit_length() - 1
            now, pieces = cut(pieces, size)
            self.emit(now)
            left -= size


def cut(pieces: list[tuple], room: int) -> tuple[list[tuple], list[tuple]]:
    """The first `room` tokens of the pieces, and the rest."""
    first = []
    for i, (doc_id, start, ids, total) in enumerate(pieces):
        n = len(ids) // 4
        if n > room:
            if room:
                first.append((doc_id, start, ids[: 4 * room], total))
            return first, [(doc_id, start + room, ids[4 * room :], total), *pieces[i + 1 :]]
        first.append(pieces[i])
        room -= n
    return first, []


def _batch(rows: list[tuple], more: list[tuple] = ()) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 7
    arrays = [pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)]
    names = list(_COLUMNS)
    if more is not None:
        part, window = zip(*more, strict=True) if more else ((), ())
        arrays += [pa.array(part, pa.int32()), pa.array(window, pa.int32())]
        names += ["part", "window"]
    return pa.RecordBatch.from_arrays(arrays, names)


@tidied
def _pack(batches, path: str, end_id: int, length: int, windows: int, memo: int):
    part = TaskContext.get().partitionId()
    encode, end = library_encoder(path, memo), np.array([end_id], "<u4").tobytes()
    packer = Packer(length, windows, part << 32)
    for batch in batches:
        (raw, offsets), keys = flat_texts(batch.column(1)), batch.column(0).to_pylist()
        for i, j in text_chunks(offsets):
            ids, at = encode(raw, offsets[i : j + 1])
            tokens, at = ids.tobytes(), (4 * at).tolist()
            for k in range(j - i):
                packer.add_document(keys[i + k], tokens[at[k] : at[k + 1]] + end)
                if len(packer.out) >= _OUT_ROWS:
                    yield _batch(packer.out, [(part, -1)] * len(packer.out))
                    packer.out = []
    encode = None
    close_encoders()
    yield _batch(packer.out, [(part, -1)] * len(packer.out))
    packer.out, rows = [], []
    for k, (_, pieces) in enumerate(packer.open):
        packer.emit(pieces)
        rows += [(part, k)] * len(pieces)
    yield _batch(packer.out, rows)


@tidied
def _merge(batches, length: int, windows: int):
    packer = Packer(length, windows, _MERGED + (TaskContext.get().partitionId() << 32))
    key, pieces = None, []
    for batch in batches:
        for part, window, doc_id, start, ids, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (part, window) != key:
                packer.add(pieces)
                key, pieces = (part, window), []
            pieces.append((doc_id, start, ids, total))
        if packer.out:
            yield _batch(packer.out, None)
            packer.out = []
    packer.add(pieces)
    packer.close()
    yield _batch(packer.out, None)


def pack_tokens(docs: DataFrame, vocabulary: str, end_id: int = 0, length: int = 1024, windows: int = 16, merge: int = 32, memo: int = MEMO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is the ids of its text by the tokenizers file `vocabulary`, then `end_id`. Every id lies in one
    piece; the pieces of a sequence fill it from offset 0. A sequence holds `length` ids, or a power of two.

    A null or empty text is the end id alone. Rows with a null or a repeated id are packed as any other.
    Texts may have any length: a partition keeps `windows` windows and one document at a time. Leftovers of
    `merge` partitions meet in one task of the second pass. An empty table gives no rows. Less `memo` takes less memory and
    more time, with the same ids. Strings of special tokens are ordinary text.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    base = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    fill = partial(_pack, path=vocabulary, end_id=end_id, length=length, windows=windows, memo=memo)
    packed = scratch.save(base.mapInArrow(fill, FIELDS + ", part int, window int"))
    left = packed.where("window >= 0").select("part", "window", "doc_id", "start", "ids", "doc_tokens", "offset")
    parts = left.agg(F.countDistinct("part")).first()[0]
    left = left.repartition(max(1, parts // merge), "part").sortWithinPartitions("part", "window", "offset").drop("offset")
    merged = left.mapInArrow(partial(_merge, length=length, windows=windows), FIELDS)
    return packed.where("window < 0").select(*_COLUMNS).unionByName(merged)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
