"""The fuzzy join against scoring every pair, its bound, and what a mapping tells beside its choice."""

import random

import numpy as np

from repairbench.operators import mapping as M


def words(seed, n):
    random.seed(seed)
    some = ["brake", "pad", "pads", "front", "rear", "oil", "filter", "fltr", "é", "日本", "x", "lamp", "offside", "nearside", "123"]
    return sorted({" ".join(random.choice(some) for _ in range(random.randint(1, 5))) for _ in range(n)} | {""})


def test_bounds_are_never_below_the_similarity():
    texts, names = words(1, 120), words(2, 120)
    left, right = M._letters(texts), M._letters(names)
    for k, text in enumerate(texts):
        true = np.array([M.token_set_similarity(text, n) for n in names])
        assert (M.bounds(left, k, right) >= true - 1e-9).all()


def test_subsequences_by_bits():
    random.seed(3)
    for _ in range(300):
        a, b = ("".join(random.choice("abcé ") for _ in range(random.randint(0, 12))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert M.indel_similarity(a, b) == (2 * table[-1][-1] / (len(a) + len(b)) if a or b else 1.0)


def test_fuzzy_pairs_in_blocks_equal_all_pairs(spark):
    texts, names = words(4, 60), words(5, 50)
    t, n = spark.createDataFrame([(x,) for x in texts], "text string"), spark.createDataFrame(list(enumerate(names)), "item_id long, name string")
    want = sorted((a, i, round(M.token_set_similarity(a, b) + 1e-12, 4)) for a in texts for i, b in enumerate(names) if round(M.token_set_similarity(a, b) + 1e-12, 4) >= 0.6)
    rows = M.fuzzy_pairs(t, n, 0.6, block_texts=16, block_names=9).collect()
    assert sorted((r.text, r.item_id, r.confidence) for r in rows) == want
    assert M.fuzzy_pairs(t.limit(0), n, 0.6).count() == M.fuzzy_pairs(t, n.limit(0), 0.6).count() == 0


def test_alternatives_status_and_mismatch(spark):
    items = spark.createDataFrame([(1, "oil filter", "part", ["engine oil strainer"], ["P1"]), (2, "oil filters", "part", [], ["P1"]), (3, "fit oil filter", "labour", [], [])], "item_id long, name string, item_type string, synonyms array<string>, part_numbers array<string>")
    lines = spark.createDataFrame([(1, "x", "p-1", "part"), (2, "Oil Filter", None, "labour"), (3, "oil filtr", None, "part"), (4, "zzz", None, "part")], "line_id long, description string, part_number string, kind string")
    got = {r.line_id: r for r in M.map_lines(lines, items).collect()}
    assert (got[1].item_id, got[1].status, [a.item_id for a in got[1].alternatives], got[1].type_mismatch) == (1, "auto_accepted", [2], False)
    assert (got[2].item_id, got[2].decision, got[2].status, [a.item_id for a in got[2].alternatives], got[2].type_mismatch) == (None, "no_match", "review", [1], True)
    assert (got[3].item_id, got[3].decision, got[3].status, [a.item_id for a in got[3].alternatives]) == (1, "fuzzy", "review", [2])
    assert (got[4].decision, got[4].candidates, got[4].type_mismatch) == ("no_match", 0, False)
