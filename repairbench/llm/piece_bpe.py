"""SentencePiece encoding and decoding by merge rounds over flat numpy arrays.

A text becomes symbols (code points with the space mark), cut into words wherever two symbols stand side by side in
no piece of the vocabulary: no merge can cross such a place. The distinct words of many texts lie behind each other
in one array. A round looks up the rank of every pair, takes each word's minimum rank by a segmented reduction,
merges in all words at once, and closes the gaps; words without a pair leave. Within a word all disjoint pairs of
the minimum rank merge together, from the left, if no pair made by them can rank as low; else only the leftmost.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, tidied
from .tokens import Memo, flat_texts, gather, text_chunks

SPACE = 0x2581
_NONE = np.int32(2**31 - 1)


class PieceBpe:
    """Encoder and decoder of one model file, kept for the life of a Python worker. The library only reads the vocabulary."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        probe = " a  Åﬁ　\n "
        if model.normalize(probe) != chr(SPACE) + probe.replace(" ", chr(SPACE)):
            raise ValueError("a model that changes texts before it cuts them isn't served")
        n = self.n = model.get_piece_size()
        pieces, ids = [model.id_to_piece(i) for i in range(n)], range(n)
        if any(model.is_unused(i) for i in ids):
            raise ValueError("a model with unused pieces isn't served")
        special = {i: b"" for i in ids if model.is_control(i)} | {i: " ⁇ ".encode() for i in ids if model.is_unknown(i)}
        special |= {i: bytes([int(pieces[i][3:5], 16)]) for i in ids if model.is_byte(i)}
        self.byte_ids = np.zeros(256, np.int32)
        for i in ids:
            if model.is_byte(i):
                self.byte_ids[special[i][0]] = i
        own = {pieces[i]: i for i in ids if i not in special}
        score = {p: model.get_score(i) for p, i in own.items()}
        # Symbols are the ids of one-character pieces; characters that only stand inside longer pieces get numbers behind all ids.
        chars = sorted(set("".join(own)))
        self.loose = [c for c in chars if c not in own]
        number = {c: n + k for k, c in enumerate(self.loose)} | {p: i for p, i in own.items() if len(p) == 1}
        self.symbol = np.full(0x110000, -1, np.int32)
        place = np.full(0x110000, -1, np.int32)
        for k, c in enumerate(chars):
            self.symbol[ord(c)], place[ord(c)] = number[c], k
        self.place, self.width = place, len(chars)
        beside = np.zeros((len(chars), len(chars)), bool)
        for p in own:
            at = place[[ord(c) for c in p]]
            beside[at[:-1], at[1:]] = True
        self.beside = np.packbits(beside.ravel(), bitorder="little")
        ranks = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = [(number[p[:k]] if k == 1 else own[p[:k]], number[p[k:]] if len(p) - k == 1 else own[p[k:]], ranks[score[p]], i) for p, i in own.items() for k in range(1, len(p)) if (k == 1 or p[:k] in own) and (len(p) - k == 1 or p[k:] in own)]
        left, right, rank, made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        key = left * (1 << 31) + right
        order = np.argsort(key)
        self.key, self.rank, self.made = key[order], rank[order].astype(np.int32), made[order].astype(np.int32)
        own_rank = np.full(n + len(self.loose), -1, np.int64)
        own_rank[list(own.values())] = [ranks[score[p]] for p in own]
        #: A piece is clean if every pair that holds it ranks behind it.
        self.clean = np.ones(n + len(self.loose), bool)
        for side in (left, right):
            self.clean[side[rank <= own_rank[side]]] = False
        # Runs of the space mark merge after all else, from the left. Where two longest pieces' worth of marks gives just two such
        # pieces, which merge no further, a run may be cut behind each.
        runs = {len(p): p for p in own if set(p) == {chr(SPACE)}}
        mixed = any(p.startswith(chr(SPACE) * 2) and set(p) != {chr(SPACE)} for p in own)
        self.run, last = max(runs, default=0), min(score.values())
        if self.run < 2 or mixed or any(score[p] != last for k, p in runs.items() if k > 1):
            self.run = None
        elif self.merge([np.full(2 * self.run, own[runs[1]], np.int32).tobytes()]) != [np.full(2, own[runs[self.run]], "<i4").tobytes()]:
            self.run = None
        told = [special[i] if i in special else pieces[i].replace(chr(SPACE), " ").encode() for i in ids]
        self.size = np.array([len(t) for t in told], np.int64)
        self.first, self.flat = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(told), np.uint8)
        self.control = np.array([model.is_control(i) for i in ids])
        self.marked = np.array([i not in special and pieces[i].startswith(chr(SPACE)) for i in ids])
        self.words = Memo(self.merge)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair of symbols."""
        key = left.astype(np.int64) * (1 << 31) + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = self.key[at] == key
        return np.where(hit, self.rank[at], _NONE), self.made[at]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32-bit) of words, given as their symbols (-1 - code point for those outside the vocabulary)."""
        if not words:
            return []
        size = np.fromiter(map(len, words), np.int64, len(words)) // 4
        symbol, word = np.frombuffer(b"".join(words), np.int32).copy(), np.repeat(np.arange(len(words)), size)
        rank, made = np.full(len(symbol), _NONE), np.zeros(len(symbol), np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner], made[inner] = self._pairs(symbol[inner], symbol[inner + 1])
        done = []
        while len(symbol):
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            length = np.diff(np.append(begins, len(word)))
            least = np.minimum.reduceat(rank, begins)
            if (least == _NONE).any():
                over = np.repeat(least == _NONE, length)
                done.append((word[over], symbol[over]))
                symbol, word, rank, made = symbol[~over], word[~over], rank[~over], made[~over]
                continue
            at = np.flatnonzero(rank == np.repeat(least, length))
            head = np.append(True, word[at[1:]] != word[at[:-1]])
            heads = np.flatnonzero(head)
            together = np.repeat(np.logical_and.reduceat(self.clean[made[at]], heads), np.diff(np.append(heads, len(at))))
            # Of pairs that overlap every other one merges, from the left.
            chain = np.append(True, (at[1:] != at[:-1] + 1) | head[1:])
            links = np.flatnonzero(chain)
            nth = np.arange(len(at)) - np.repeat(links, np.diff(np.append(links, len(at))))
            at = at[head | (together & (nth % 2 == 0))]
            symbol[at] = made[at]
            stays = np.ones(len(symbol), bool)
            stays[at + 1] = False
            moved = at - np.arange(len(at))  # where they are when the gaps are closed
            symbol, word, rank, made = symbol[stays], word[stays], rank[stays], made[stays]
            rank[moved] = _NONE
            near = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
            near = near[near < len(word) - 1]
            near = near[word[near] == word[near + 1]]
            rank[near], made[near] = self._pairs(symbol[near], symbol[near + 1])
        word, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        word, symbol = word[order], symbol[order]
        at = np.searchsorted(word, np.arange(len(words) + 1))
        raw = symbol.astype("<i4").tobytes()
        out = [raw[4 * i : 4 * j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for w in np.unique(word[(symbol < 0) | (symbol >= self.n)]).tolist():
            out[w] = b"".join(self._spelled(s) for s in symbol[at[w] : at[w + 1]].tolist())
        return out

    def _spelled(self, symbol: int) -> bytes:
        """The id of a symbol, or those of the bytes of a character that is no piece."""
        if 0 <= symbol < self.n:
            return symbol.to_bytes(4, "little")
        char = chr(-1 - symbol) if symbol < 0 else self.loose[symbol - self.n]
        return self.byte_ids[np.frombuffer(char.encode(), np.uint8)].astype("<i4").tobytes()

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For UTF-8 texts raw[offsets[i]:offsets[i + 1]]: the ids of all, and where each text's begin (and the last's end)."""
        raw, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        code = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.int32)
        at = np.append(0, np.cumsum((raw & 0xC0) != 0x80))[offsets]
        full = at[1:] > at[:-1]
        code = np.insert(code, at[:-1][full], SPACE)
        at = at + np.append(0, np.cumsum(full))
        code[code == 32] = SPACE
        place, symbol = self.place[code], self.symbol[code]
        symbol = np.where(place < 0, -1 - code, symbol).astype(np.int32)
        cut = np.ones(len(code), bool)
        key = place[:-1].astype(np.int64) * self.width + place[1:]
        known = (place[:-1] >= 0) & (place[1:] >= 0)
        key[~known] = 0
        cut[1:] = ~known | ((self.beside[key >> 3] >> (key & 7)) & 1 == 0)
        cut[at[:-1][full]] = True
        if self.run:
            mark = np.flatnonzero(code == SPACE)
            fresh = np.append(True, (mark[1:] != mark[:-1] + 1) | cut[mark[1:]])
            nth = np.arange(len(mark)) - np.maximum.accumulate(np.where(fresh, np.arange(len(mark)), 0))
            cut[mark[(nth > 0) & (nth % self.run == 0)]] = True
        starts = np.flatnonzero(cut)
        ids, first = self.words.stretches(symbol.view(np.uint8), 4 * starts, np.int32)
        return ids, first[np.searchsorted(starts, at)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of the id arrays ids[at[i]:at[i + 1]]: the first piece loses its space mark; each stray byte becomes U+FFFD."""
        raw, first = gather(self.flat, self.first, self.size, ids)
        begin = first[at].copy()
        plain = np.append(np.flatnonzero(~self.control[ids]), len(ids))
        head = plain[np.searchsorted(plain, at[:-1])]
        held = np.flatnonzero(head < at[1:])
        held = held[self.marked[ids[head[held]]]]
        start = begin[:-1].copy()
        start[held] += 1
        raw, breaks = raw.tobytes(), first[:-1][self.control[ids]]  # bytes before and after a control make no character together
        texts = []
        for i, j in zip(start.tolist(), begin[1:].tolist(), strict=True):
            inner = breaks[np.searchsorted(breaks, i, "right") : np.searchsorted(breaks, j)].tolist() if len(breaks) else []
            texts.append("".join(_text(raw[a:b]) for a, b in zip([i, *inner], [*inner, j], strict=True)))
        return texts


def _text(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            try:
                out.append(raw[i:].decode())
                break
            except UnicodeDecodeError as e:
                out.append(raw[i : i + e.start].decode() + "�" * (e.end - e.start))
                i += e.end
        return "".join(out)


_open: dict[str, PieceBpe] = {}


def _engine(path: str) -> PieceBpe:
    if path not in _open:
        _open.clear()
        _open[path] = PieceBpe(path)
    return _open[path]


@tidied
def _encode(batches, path: str):
    engine = _engine(path)
    for batch in batches:
        raw, offsets = flat_texts(batch.column(1))
        for i, j in text_chunks(offsets):
            ids, at = engine.encode(raw, offsets[i : j + 1])
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])


@tidied
def _decode(batches, path: str):
    engine = _engine(path)
    for batch in batches:
        sizes = np.array([n or 0 for n in batch.column(1).value_lengths().to_pylist()], np.int64)
        ids, at = batch.column(1).flatten().to_numpy(), np.append(0, np.cumsum(sizes))
        for i, j in text_chunks(4 * at):
            texts = engine.decode(ids[at[i] : at[j]], at[i : j + 1] - at[i])
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])


def piece_encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: a row for each row, as the library encodes without begin or end ids and sampling.

    A null or empty text has no ids; ids of rows may repeat or be null. Texts and words may have any length (a word of
    one script without spaces costs more the more different pieces it holds); an empty table gives none. `model` is the
    file of a byte-pair model that leaves texts as they are before it cuts them; any other is refused.
    """
    base = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return base.mapInArrow(partial(_encode, path=model), "doc_id long, ids array<int>")


def piece_decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, decoded: the texts of id lists. Null and empty lists give empty texts; ids of controls say nothing."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, path=model), "doc_id long, ids array<int>, decoded string")


def op13_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    decoded = piece_decode(piece_encode(read_table(spark, sf_dir, "documents"), model), model)
    digest = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
