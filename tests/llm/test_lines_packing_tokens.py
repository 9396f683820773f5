"""Line dedup, packing, token files and BPE against brute force and the public libraries."""

import base64
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from repairbench.llm.byte_bpe import DuckBpe, bpe_decode, bpe_encode
from repairbench.llm.common import Scratch
from repairbench.llm.line_dedup import line_dedup
from repairbench.llm.packing import pack_tokens
from repairbench.llm.token_files import Codes, encode_codes, read_token_files, write_token_files
from repairbench.llm.tokens import library_encoder

ODD = [None, "", " ", "a  b", "a \n b.", "x, y. Z.\nnext", "don't,  'tis", "é, à.", "…, .. ,", "\x00 \x1c", "<|endoftext|> a", "漢字 " * 40, "k" * 3000, "word " * 2000, "a.\n\nb", "S.\n", " ,", "réaux$$$ x!!"]


def fuzz(n):
    rng = random.Random(8)
    signs = list("ab'sS1,,..!é \t\n  \x1c\x85ßΣ́漢<|>\\\0") + [" ", "  ", ".\n", ", ", ". ", "'re", "<|endoftext|>"]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoders_equal_the_library(file):
    texts = [t for t in ODD if t is not None] + fuzz(6000)
    plain = Tokenizer.from_file(P.path(file))
    plain.encode_special_tokens = True
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    raw = [t.encode() for t in texts]
    assert library_encoder(P.path(file)).encode_texts(raw) == want
    assert [x for t in raw[:200] for x in library_encoder(P.path(file)).encode_texts([t])] == want[:200]


def test_bpe_equals_tiktoken_and_decodes(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ODD + fuzz(300)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = bpe_decode(bpe_encode(df, path, P.PATTERN), path, P.PATTERN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.ids == known.encode_ordinary(text) and bytes(r.decoded) == text.encode()


def test_long_words_and_bounded_queries(monkeypatch):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    words = ["a" * 150, "abcab" * 30, "thereforeandéñß" * 5, "k" * 20000, "漢字國語中文" * 60, "x"] + ["".join(rng.choice(a) for _ in range(n)) for a in ("etaoin", "abc", "thing") for n in (66, 130, 700)]
    want = [np.array(known.encode_ordinary(w), "<i4").tobytes() for w in words]
    raw = [w.encode() for w in words]
    assert DuckBpe(path, P.PATTERN).merge(raw) == want
    monkeypatch.setattr("repairbench.llm.byte_bpe.STATE_ROWS", 2000)  # each query stops early and goes on from its last state
    assert DuckBpe(path, P.PATTERN).merge(raw[:3] + raw[5:9]) == want[:3] + want[5:9]


def test_bpe_takes_empty_tables_and_repeated_rows(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    df = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "x"), (2, None)], "doc_id long, text string")
    rows = bpe_decode(bpe_encode(df, path, P.PATTERN), path, P.PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in rows) == [("1", b"one two"), ("1", b"one two"), ("2", b""), ("None", b"x")]
    assert bpe_decode(bpe_encode(df.limit(0), path, P.PATTERN), path, P.PATTERN).collect() == []


def brute_lines(rows):
    keys = {}
    clean = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    for n, (i, t) in enumerate(rows):
        for x in (t or "").split("\n"):
            if len(clean(x)) >= 40:
                keys.setdefault(clean(x), {})[n] = i
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = lambda x: len(d := keys.get(clean(x), {})) >= 5 and (i is None or i < max(v for v in d.values() if v is not None))  # noqa: E731, B023
        kept = [x for x in lines if not gone(x)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    rng = random.Random(2)
    pool = [("Line number %d with É " % k) + "x" * rng.choice((10, 18, 19, 20, 21, 40)) for k in range(30)]
    rows = [(i, "\n".join(rng.choice(["  %s ", "%s", "%s\r"]) % rng.choice(pool) for _ in range(rng.randrange(0, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, "\n".join(pool)), (60, ("w" * 50 + "\n") * 20000), (59, "\n".join(pool + pool))]
    df = spark.createDataFrame([(i, t, "k", 7) for i, t in rows], "doc_id long, text string, lost string, n_lines int")
    got = line_dedup(df)
    assert got.columns == ["doc_id", "text", "lost", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=repr) == brute_lines(rows)
    assert line_dedup(df.limit(0)).collect() == []


def test_packing_is_whole_and_unpadded(spark):
    path = P.path("byte_bpe_50k.json")
    texts = ODD + ["some words of a text " * k for k in (1, 3, 30, 300, 900)] * 3
    df = spark.createDataFrame([(i % 17, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int").repartition(5)
    rows = pack_tokens(df, path, windows=2, merge=2).collect()
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    want = sorted((i % 17, [*plain.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in enumerate(texts))
    pieces, sequences = {}, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.length > 0
        sequences.setdefault(r.sequence_id, []).append(r)
    for found in sequences.values():
        found.sort(key=lambda r: r.offset)
        end = 0
        for r in found:
            assert r.offset == end
            end += r.length
        assert end == 1024 or end & (end - 1) == 0 and end < 1024
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert sum(r.length for r in rows) == sum(len(x) for _, x in want)
    for i, ids in want:
        pieces = by_doc[i, len(ids)]
        for start, part in pieces:
            assert 0 <= start and start + len(part) <= len(ids)
        if sum(1 for j, x in want if (j, len(x)) == (i, len(ids))) == 1:
            assert [x for _, p in sorted(pieces) for x in p] == ids
    assert pack_tokens(df.limit(0), path).collect() == []


def test_codes_give_random_access():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), rng.integers(0, 1 << 32, 1000, dtype=np.uint32), rng.integers(0, 300, 777, dtype=np.uint32), np.arange(70000, dtype=np.uint32)):
        codes, at = Codes(encode_codes(ids)), rng.integers(0, max(1, len(ids)), 500 if len(ids) else 0)
        assert (codes[at] == ids[at]).all() and (codes[np.arange(len(ids))] == ids).all()


def test_token_files_round_trip(spark):
    path = P.path("word_bpe_49k.json")
    texts = ODD + fuzz(100)
    df = spark.createDataFrame([(None if i == 3 else 1000 - 7 * i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, part string")
    at = f"{Scratch(spark, 'test').root}/files"
    write_token_files(df, at, path, segment_tokens=300)
    rows = sorted(read_token_files(spark, at).collect(), key=lambda r: r.start)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    want, start = sorted(((None if i == 3 else 1000 - 7 * i), [*plain.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in enumerate(texts) if i != 3), 0
    want = [(None, [*plain.encode(texts[3], add_special_tokens=False).ids, 2]), *want]
    for r, (i, ids) in zip(rows, want, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (i, start, len(ids), ids)
        start += len(ids)
    empty = f"{Scratch(spark, 'test').root}/files"
    write_token_files(df.limit(0), empty, path)
    assert read_token_files(spark, empty).collect() == []


def test_plain_parts_are_what_a_pattern_finds():
    """Parts of letters only or of signs only, behind one space or none, told on bytes as by a pattern on each."""
    import random
    import re

    from repairbench.llm.tokens import plain

    letters = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"
    pattern = re.compile(rb"( ?)(?:" + letters + rb"|[!-&(-/:-@\[-`{-~]+)")
    draw = random.Random(1)
    parts = ["".join(draw.choice("ab Zz'!?-(09é×÷ÿĀ中\n\t`{~^") for _ in range(draw.randint(1, 4))).encode() for _ in range(20_000)]
    found = [pattern.fullmatch(p) for p in parts]
    assert plain(parts) == ([i for i, m in enumerate(found) if m and m[1]], [i for i, m in enumerate(found) if m and not m[1]])
    assert plain([]) == ([], []) and plain([b" "]) == ([], [])
