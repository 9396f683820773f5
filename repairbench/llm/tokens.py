"""Exact token ids of whole texts by a public tokenizer: texts are cut into parts, distinct parts are encoded once.

A text is cut only where no match of the tokenizer's pattern can cross, whatever stands around, so the ids of a
text are those of its parts in order. Cuts are found on the bytes of many texts at once, parts are numbered by
Arrow's dictionary encoding, and the ids of a text are gathered from those of its distinct parts.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Parts remembered between chunks (twice as many at most), and the longest part that is.
MEMO, MEMO_BYTES = 120_000, 48

_SPACE, _LETTER, _SIGN, _LEAD = 1, 2, 4, 8  # kinds of bytes
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = _LETTER  # and digits
_KIND[[x for x in range(33, 127) if not _KIND[x] and x != 39]] = _SIGN
_KIND[0xC3:0xE0] = _LEAD  # two-byte characters, none of which is white space
#: Last bytes of characters outside ASCII that are no white space, whatever comes before.
_NO_SPACE = np.zeros(256, bool)
_NO_SPACE[[x for x in range(0x80, 0xC0) if not (x <= 0x8A or x in (0x9F, 0xA0, 0xA8, 0xA9, 0xAF))]] = True
_NO_SPACE[33:127] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACES = _KIND == _SPACE
#: Letters of Latin-1 by their second byte after 0xC3.
_LATIN = np.zeros(256, bool)
_LATIN[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True


def flat_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow string column behind each other, and where each begins (and the last ends)."""
    column = (column.fill_null("") if column.null_count else column).cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and at[-1] else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def text_chunks(offsets: np.ndarray, most: int = 1 << 19):
    """Ranges (start, end) of consecutive texts of about `most` bytes together, at least one text each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def cuts(raw: np.ndarray) -> np.ndarray:
    """A mask of bytes before which no match of the patterns served can be going on.

    White space after what is none; an ASCII sign (no apostrophe) after a letter or digit; a letter or digit after
    such a sign; what surely is no white space after a single line end. Letters here are ASCII and Latin-1.
    """
    out = np.zeros(len(raw), bool)
    if len(raw) < 2:
        return out
    kind, solid = _KIND[raw], _NO_SPACE[raw]
    second = (raw[1:] >= 0x80) & (kind[:-1] == _LEAD)
    solid[1:] |= second
    letter = kind == _LETTER
    letter[1:] |= (raw[:-1] == 0xC3) & _LATIN[raw[1:]]
    space, sign = _SPACES[raw], kind == _SIGN
    out[1:] = (space[1:] & solid[:-1]) | (sign[1:] & letter[:-1]) | ((kind[1:] == _LETTER) & sign[:-1])
    ends = (raw[1:-1] == 10) & solid[:-2] & ((kind[2:] & (_LETTER | _SIGN | _LEAD)) > 0)
    out[2:] |= ends
    return out


def gather(flat: np.ndarray, first: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches flat[first:first + size] in the order of `codes`, and where each begins (and the last ends)."""
    n = size[codes]
    end = np.concatenate([[0], np.cumsum(n)])
    return flat[np.arange(end[-1]) + np.repeat(first[codes] - end[:-1], n)], end


class Memo:
    """A bounded memo of what `make` gives for byte strings: when full, it starts anew, and what is used again of the generation before moves over."""

    def __init__(self, make: Callable[[list[bytes]], list[bytes]], most: int = MEMO):
        self.make, self.most, self.now, self.old = make, most, {}, {}

    def __call__(self, keys: list[bytes]) -> list[bytes]:
        """Values of distinct keys."""
        if len(self.now) > self.most:
            self.now, self.old = {}, self.now
        now, old = self.now, self.old
        values = list(map(now.get, keys))
        absent = []
        for i in [i for i, v in enumerate(values) if v is None]:
            if (v := old.get(keys[i])) is None:
                absent.append(i)
            else:
                values[i] = now[keys[i]] = v
        for i, v in zip(absent, self.make([keys[i] for i in absent]), strict=True):
            values[i] = v
            if len(keys[i]) <= MEMO_BYTES:
                now[keys[i]] = v
        return values

    def stretches(self, raw: np.ndarray, starts: np.ndarray, width: type) -> tuple[np.ndarray, np.ndarray]:
        """For parts of `raw` that begin at `starts`: their values behind each other, as numbers of `width`, and where each begins."""
        places = np.append(starts, len(raw)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        values = self(parts.dictionary.to_pylist())
        size = np.fromiter(map(len, values), np.int64, len(values)) // np.dtype(width).itemsize
        return gather(np.frombuffer(b"".join(values), width), np.cumsum(size) - size, size, parts.indices.to_numpy())


class Encoder:
    """Ids of texts. `encode` gives for byte strings their ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], lower: bool = False, most: int = MEMO):
        self.memo, self.lower = Memo(encode, most), lower

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For texts raw[offsets[i]:offsets[i + 1]]: the ids of all, and where each text's begin (and the last's end)."""
        raw = raw[offsets[0] : offsets[-1]]
        at = offsets - offsets[0]
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        raw = _LOWER[raw] if self.lower else raw
        mask = cuts(raw)
        mask[at[:-1][at[:-1] < len(raw)]] = True
        starts = np.flatnonzero(mask)
        ids, first = self.memo.stretches(raw, starts, np.uint32)
        return ids, first[np.searchsorted(starts, at)]

    def encode_texts(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each of a few texts."""
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        ids, at = self(np.frombuffer(b"".join(texts), np.uint8), offsets)
        return [ids[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]


#: Bytes of parts that are one match of the pattern, whatever stands around them: letters only, or signs only.
_PLAIN = np.zeros(256, np.uint8)
_PLAIN[[*range(65, 91), *range(97, 123)]] = 1
_PLAIN[_KIND == _SIGN] = 2


def plain(parts: list[bytes]) -> tuple[list[int], list[int]]:
    """Which of the parts are letters only or signs only: those behind one space, and those without it."""
    if not parts:
        return [], []
    raw, size = np.frombuffer(b"".join(parts), np.uint8), np.fromiter(map(len, parts), np.int64, len(parts))
    first, kind = np.cumsum(size) - size, _PLAIN[raw]
    pair = np.flatnonzero((raw[:-1] == 0xC3) & _LATIN[raw[1:]])
    kind[pair] = kind[pair + 1] = 1
    space = raw[first] == 32
    kind[first[space]] = 3
    good = (np.bitwise_and.reduceat(kind, first) > 0) & (size > space)
    return np.flatnonzero(good & space).tolist(), np.flatnonzero(good & ~space).tolist()


_open: dict[str, Encoder] = {}


def close_encoders() -> None:
    """Lets the tokenizers of this Python worker go, at the end of a task: other stages need the memory."""
    _open.clear()


def library_encoder(path: str, memo: int = MEMO) -> Encoder:
    """An encoder by the tokenizers library, kept while a Python worker serves the same file (one at a time).

    It remembers the ids of up to two generations of `memo` parts.
    """
    if path not in _open or _open[path].memo.most != memo:
        _open.clear()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        # One kind drops white space, takes lower case and ends words by a mark; the other begins them with their space.
        drops = tokenizer.normalizer is not None
        edge = np.zeros(tokenizer.get_vocab_size(), bool)
        for i in range(len(edge)):
            token = tokenizer.id_to_token(i) or ""
            edge[i] = token.endswith("</w>") if drops else token.startswith("\u0120")

        def together(out: list, parts: list[bytes], which: list[int], joint: bytes) -> None:
            """A thousand parts in one text, taken apart at the tokens that end (or begin) a word."""
            for k in range(0, len(which), 1000):
                some = which[k : k + 1000]
                text = joint.join([parts[i] for i in some]).decode()
                # The batch form keeps no offsets, which nobody reads here.
                ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                at = np.flatnonzero(edge[ids])
                if len(at) != len(some):
                    continue  # not one match each; they are encoded one by one below
                ends = at + 1 if drops else np.append(at[1:], len(ids))
                raw, a = ids.tobytes(), 0
                for i, b in zip(some, (4 * ends).tolist(), strict=True):
                    out[i] = raw[a:b]
                    a = b

        def encode(parts: list[bytes]) -> list[bytes]:
            out: list[bytes | None] = [None] * len(parts)
            led, bare = plain(parts)
            together(out, parts, led, b"")
            if drops:
                together(out, parts, bare, b" ")
            rest = [i for i, x in enumerate(out) if x is None]
            for i, e in zip(rest, tokenizer.encode_batch_fast([parts[i].decode() for i in rest], add_special_tokens=False) if rest else [], strict=True):
                out[i] = array("I", e.ids).tobytes()
            return out

        _open[path] = Encoder(encode, lower=drops, most=memo)
    return _open[path]
