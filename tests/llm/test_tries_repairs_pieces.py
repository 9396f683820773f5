"""Prefix tries, conversation repair and SentencePiece on hostile tables, against DuckDB, brute force and the library."""

import itertools
import random

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from repairbench.llm import chat_repair, piece_bpe, prefix_trie
from repairbench.llm.tokens import flat_texts, text_chunks

SCHEMA = "conv_id long, turn long, role string, text string, Depth string"


def saved(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def asked(sf_dir, sql):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS FROM '{sf_dir}/conversations.parquet/*.parquet'")
    return sorted(map(repr, db.execute(f"SELECT * FROM ({sql})").fetchall()))


def told(df, columns):
    return sorted(repr(tuple(r)) for r in df.select(*columns).collect())


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_with_copies_ties_nulls_and_long_conversations(spark, tmp_path):
    random.seed(5)
    rows = [(c, random.choice([None, k, k]), random.choice(["user", "user", None]), random.choice(["a", "a", "b", "", None, "1:x"]), "x") for c in [None, -205, -100, -7, *range(150)] for k in range(random.choice([1, 2, 5, 9]))]
    rows += [(c, k, "user", f"copy{k}", None) for c in range(2000, 2090) for k in range(4)]
    rows += [(c, k, "user", f"copy{k}" if k < 70 else f"z{c % 3}", None) for c in range(3000, 3012) for k in range(80)]
    sf_dir = saved(spark, tmp_path, rows)
    expected = asked(sf_dir, prefix_trie.ORACLE)
    assert told(prefix_trie.op11_prefix_trie(spark, sf_dir), NODE) == expected
    turns = prefix_trie.rebuilt(prefix_trie.conversation_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    assert told(prefix_trie.prefix_trie(turns, shard=5), NODE) == expected


def test_trie_of_conversations_without_turns_and_of_none(spark):
    empty = spark.createDataFrame([(4, []), (2, []), (9, [(b"1" * 16, 7)])], "conv_id long, turns array<struct<digest:binary,size:long>>")
    rows = {r["depth"]: r for r in prefix_trie.prefix_trie(empty).collect()}
    assert (rows[0]["conv_id"], rows[0]["n_convs"], rows[0]["n_children"], rows[0]["n_leaves"], rows[1]["parent_conv_id"]) == (2, 3, 1, 1, 2)
    assert prefix_trie.prefix_trie(empty.limit(0)).count() == 0


REPAIR = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair_of_hostile_conversations(spark, tmp_path):
    random.seed(3)
    rows = []
    for c in [None, *range(40)]:
        for k in range(random.choice([0, 1, 2, 3, 5, 9, 40])):
            text = random.choice(["hi.", "ok", "", "  \n", "yes!", "wow? \t", "a.b", None, f"t{random.random()}."])
            rows.append((c, random.choice([None, k, k, k, k + 1, k // 2]), random.choice(["user", "assistant", "system", "tool", "", None]), text, "x"))
    sf_dir = saved(spark, tmp_path, rows)
    assert told(chat_repair.op12_chat_repair(spark, sf_dir), REPAIR) == asked(sf_dir, chat_repair.ORACLE)
    damaged = chat_repair.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    whole = told(chat_repair.repair_chats(damaged), REPAIR)
    assert told(chat_repair.repair_chats(damaged, block_rows=3), REPAIR) == whole  # one conversation in many blocks
    assert chat_repair.repair_chats(damaged.limit(0)).count() == 0


def test_repair_of_a_very_long_conversation(spark):
    rows = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 1, "assistant").otherwise("user").alias("role"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"))
    row = chat_repair.repair_chats(rows).first()
    # Of six rows u a u u a u the last three take other roles; to delete the third and the sixth would cost more.
    assert (row["cost"], len(row["audit"]), row["audit"].count("D"), row["illegal"]) == (1500, 3000, 0, 999)


@pytest.mark.parametrize("seed", range(6))
def test_parse_against_all_edits(seed):
    random.seed(seed)
    rows = [(random.choice("suax"), random.choice([0, 0, 1, 3])) for _ in range(random.randint(0, 3))]
    least = None
    for choice in itertools.product(*[["D"] if f in (1, 2) else ["D", "K", "Ru", "Ra"] for _, f in rows]):
        for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
            audit, read, cost = "I" * len(gaps[0]), gaps[0], 5 * len(gaps[0])
            for (x, f), edit, gap in zip(rows, choice, gaps[1:], strict=True):
                cost += {"D": 2, "K": 0}.get(edit, 1) + 5 * (f == 3 and edit != "D") + 5 * len(gap)
                audit += edit[0] + "I" * len(gap)
                read += {"D": "", "K": x}.get(edit, edit[1:]) + gap
            body = read[1:] if read[:1] == "s" else read
            if (read == "" or body) and body == "ua" * (len(body) // 2):
                least = min(least or (cost, audit), (cost, audit))
    cells = [chat_repair.row_cell(x, f) for x, f in rows] or [chat_repair.inserted()]
    assert chat_repair.best(chat_repair.parse(cells)[-1][0][0])[0] == least


def encoded(engine, texts):
    raw, offsets = flat_texts(pa.array(texts, pa.string()))
    ids, back = [], []
    for i, j in text_chunks(offsets, 1 << 12):
        some, at = engine.encode(raw, offsets[i : j + 1])
        ids += [some[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
        back += engine.decode(some, at)
    return ids, back


def test_pieces_equal_those_of_the_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, engine = sentencepiece.SentencePieceProcessor(model_file=path), piece_bpe.PieceBpe(path)
    random.seed(1)
    vocabulary = [library.id_to_piece(i).replace("▁", " ") for i in range(32000)]
    signs = " \t\n▁ab the é日本語　\xa0😀.,<s>0123\0ßﬁ"
    texts = ["".join(random.choice(signs) for _ in range(random.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(random.choice(vocabulary) for _ in range(random.randint(1, 8))) for _ in range(1500)]
    texts += [" " * k + w for k in range(70) for w in ("", "a", "the x", "\n", "日", " ▁")] + ["a" + " " * k + "b" for k in range(70)]
    texts += ["".join(random.choice("abcdefghij") for _ in range(5000)), "x" * 5000, "ab" * 5000, " " * 50000 + "the", "日本" * 3000]
    ids, back = encoded(engine, texts)
    assert ids == library.encode(texts) and back == library.decode(ids)
    for _ in range(2000):  # lists that no text gives: stray bytes, controls, unknowns
        some = [random.choice([0, 1, 2, 28705, 259, random.randint(3, 258), random.randint(0, 31999)]) for _ in range(random.randint(0, 8))]
        assert engine.decode(np.array(some, np.int64), np.array([0, len(some)])) == [library.decode(some)]


def test_pieces_of_rows(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = spark.createDataFrame([(1, "a  b"), (1, "a  b"), (None, "x"), (2, None), (3, ""), (4, "é\n" * 30000)], "doc_id long, text string").withColumn("IDS", F.lit(1))
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted(repr((r["doc_id"], r["ids"], r["decoded"])) for r in piece_bpe.piece_decode(piece_bpe.piece_encode(rows, path), path).collect())
    assert got == sorted(repr((r["doc_id"], library.encode(r["text"] or ""), r["text"] or "")) for r in rows.collect())
    assert piece_bpe.piece_encode(rows.limit(0), path).count() == 0
