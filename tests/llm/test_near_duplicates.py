"""N-gram Jaccard join and components against brute force."""

import random

import numpy as np
import pyarrow as pa

from repairbench.llm import ngram_jaccard as J
from repairbench.llm.common import Scratch
from repairbench.llm.components import connected_components
from repairbench.llm.ngram_jaccard import ngram_jaccard_join
from repairbench.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, component_id string, n int"


def brute(rows, percent=75):
    def shingles(text):
        words = (text or "").encode().lower().split()
        if not words:
            return frozenset()
        k = min(5, len(words))
        return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))

    sets = [shingles(t) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b, x, y = rows[j][0], sets[i], sets[j]
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted(((i, len(s), find(i) if i is not None else None) for (i, _), s in zip(rows, sets)), key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard_join(df).collect()), key=repr)


def test_edges_nulls_ties(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [
        (5, base), (3, base.upper()), (9, base + " tail"), (4, None), (7, ""), (8, " \t\n"), (None, base), (11, "one two"), (12, "two one"),
        (13, "ONE\ttwo"), (14, "é " * 8), (2, "w1 w2 w3 w4 w5 w6 w7"), (15, "w1 w2 w3 w4 w5 w6 w7 w8"), (9, base), (20, "a\x0bb\x1cc d e f"),
    ]
    assert run(spark, rows) == brute(rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(70)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice((0, 1, 2, 2))):
            words[rng.randrange(70)] = f"e{rng.randrange(9999)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12)))) for i in range(60)]
    assert run(spark, rows) == brute(rows)


def test_many_copies_and_very_long_texts(spark):
    rows = [(i, "one text that many rows hold as it is") for i in range(400)] + [(1000 + i, " ".join(f"v{k}" for k in range(60000 + i))) for i in range(2)]
    assert run(spark, rows) == sorted([(i, 5, 0) for i in range(400)] + brute(rows[400:]), key=repr)


def test_empty_texts_of_shared_ids_link_nothing(spark):
    base = [f"w{i}" for i in range(40)]
    other = base[:34] + [f"x{i}" for i in range(6)]
    rows = [(1, " ".join(base)), (1, ""), (2, " ".join(other)), (2, " ")] + [(i, " ".join(w[30:])) for i, w in ((4, base), (5, other), (6, base), (7, other))]
    assert run(spark, rows) == brute(rows)


def test_postings_are_packed_whole(monkeypatch):
    monkeypatch.setattr(J, "PACKED", 50)
    rng = np.random.default_rng(3)
    prefixes = [rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (3, 0, 40, 17, 1, 30)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(range(60, 66)), pa.array([p.tobytes() for p in prefixes])], ["cid", "n", "prefix"])
    packed = list(J._postings([batch.slice(0, 3), batch.slice(3)], 7))
    found = [(place, *row) for b in packed for place, *lists in zip(*(c.to_pylist() for c in b.columns)) for row in zip(*lists, strict=True)]
    wanted = [(int(x) % 7, int(np.uint32(x >> np.uint64(32)).astype(np.int32)), i, 60 + i, k) for i, p in enumerate(prefixes) for k, x in enumerate(p)]
    assert sorted(found) == sorted(wanted) and sum(b.num_rows for b in packed) <= 14


def test_bitmaps_drop_unlike_pairs_and_no_link():
    rng = random.Random(5)
    texts, pairs = [], []
    for i in range(300):
        words = [f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 400))]
        texts += [" ".join(words), " ".join(words[: rng.randrange(1, len(words) + 1)] + [f"u{k}" for k in range(rng.randrange(9))])]
        pairs += [(2 * i, 2 * i + 1), (2 * i, rng.randrange(2 * i + 1))]
    sets = [set(s.tolist()) for s in shingle_sets([t.encode() for t in texts])]
    marks = [b.column(k).to_pylist() for b in J._marks([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "t"])], 5) for k in (1, 2)]
    a, b = zip(*pairs)
    columns = [pa.array(a), pa.array(b), *[pa.array([m[i] for i in side]) for m in marks for side in (a, b)]]
    (near,) = J._near([pa.RecordBatch.from_arrays(columns, ["a", "b", "na", "nb", "ma", "mb"])], 75)
    near = near.column(2).to_pylist()
    linked = [100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]) for x, y in pairs]
    assert all(n for n, l in zip(near, linked) if l) and 50 < sum(linked) <= sum(near) < 1.5 * sum(linked) < 0.7 * len(pairs)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_shingle_sets_are_whole_sets():
    sets = list(shingle_sets([b"A b  c d e F", b"", None, b"a", b" a\tB c\x0bd e f "]))
    assert [len(s) for s in sets] == [2, 0, 0, 1, 2] and list(sets[0]) == list(sets[4])


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101)], "a long, b long")
    found = {r.node: r.component for r in connected_components(edges, Scratch(spark, "test")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {101: 100}
