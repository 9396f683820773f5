"""Searches against brute force, chats read back, pages, the classifier and the pipeline."""

import hashlib
import zlib

import numpy as np
import pytest

import corpus_pipeline
from repairbench.llm.chat_format import escape, format_chats, loss_text, op4_chat_format, read_chats, unescape
from repairbench.llm.exact_top_k import exact_top_k
from repairbench.llm.html_extract import Block, classify, extract_html, inherit, main_text
from repairbench.llm.nearest import chi_square_quantile, nearest
from repairbench.llm.quality import score_quality
from pyspark.sql import functions as F

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=12).tolist(), "q") for i in range(300)]
    rows += [(300 + i, rows[20][1], "q") for i in range(30)]
    rows += [(400, None, ""), (401, [], ""), (402, [float("nan")] * 12, ""), (403, [None] * 12, ""), (404, [float("inf")] * 12, ""), (None, rows[1][1], ""), (406, [0.0] * 12, ""), (407, [1.0, 2.0], ""), (1, rows[1][1], "")]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")


def usable(rows):
    return [(i, np.array(v)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]


def test_exact_top_k(spark):
    rows, df = vectors(spark)
    got = exact_top_k(df, df.where("vec_id % 20 = 0"), 7, row_block=40)
    good, want = [(i, np.floor(64 * v)) for i, v in usable(rows)], []
    for i, v in good:
        if i % 20 == 0:
            found = sorted((-int(v @ w), j) for j, w in good if j != i and len(w) == len(v))[:7]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(found)]
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == sorted(want)
    assert exact_top_k(df.limit(0), df.limit(0), 5).collect() == []


def test_nearest_recall_and_ties(spark):
    rows, df = vectors(spark)
    got = nearest(df, df.where("vec_id % 20 = 0"), 5, row_block=80).collect()
    good = [(i, v / np.linalg.norm(v)) for i, v in usable(rows) if np.linalg.norm(v)]
    hit = total = 0
    for i, v in good:
        if i % 20 == 0:
            want = [j for _, j in sorted((-round(float(v @ w), 12), j) for j, w in good if j != i and len(w) == len(v))[:5]]
            hit, total = hit + len(set(want) & {r.vec_id for r in got if r.query_id == i}), total + len(want)
    assert hit >= 0.9 * total
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 20] == [300, 301, 302, 303, 304]
    assert abs(chi_square_quantile(8, 0.95) - 15.507) < 0.01


def test_exact_top_k_of_negative_ties_and_huge_products(spark):
    rows = [(0, [1000.0, 0.0, 0.0])] + [(i, [-1e6, 0.0 if i <= 1500 else 7.0, 0.0]) for i in range(1, 3001)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = exact_top_k(df, df.where("vec_id = 0"), 5, row_block=900).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5] and {r.score for r in got} == {-64000 * 64000000}
    huge = spark.createDataFrame([(0, [1e9, 3.0]), (1, [1e9, 1.0]), (2, [1e9, 2.0]), (3, [-1e300, 0.0]), (4, [1.7e308, 0.0])], "vec_id long, embedding array<double>")
    got = exact_top_k(huge, huge.where("vec_id = 0"), 5).orderBy("rank").collect()
    top = 64_000_000_000**2
    assert [(r.vec_id, r.score) for r in got] == [(1, (1 << 63) - 1), (2, (1 << 63) - 1), (3, -(1 << 63))] and top > 1 << 63
    mid = spark.createDataFrame([(0, [2e7, 3.0]), (1, [2e7, 1.0]), (2, [2e7, 2.0])], "vec_id long, embedding array<double>")
    got = exact_top_k(mid, mid.where("vec_id = 0"), 5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 1_280_000_000**2 + 192 * 128), (1, 1_280_000_000**2 + 192 * 64)]


def test_nearest_on_given_clustered_and_extreme_vectors(spark):
    from functools import partial

    from repairbench.llm import nearest as module

    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    got = {}
    for r in nearest(rows, rows.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    data = sorted((r.vec_id, r.embedding) for r in rows.collect())
    ids, u = np.array([i for i, _ in data]), module.unit(np.array([v for _, v in data], float))
    hit = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = u @ u[i]
        s[i] = -2
        want = set(ids[np.lexsort((ids, -s))[:5]].tolist())
        hit, total = hit + len(want & got[int(ids[i])]), total + 5
    assert hit >= 0.9 * total
    # Clusters: most rows are never verified.
    rng = np.random.default_rng(4)
    v = np.repeat(rng.normal(size=(40, 32)), 100, axis=0) + 0.01 * rng.normal(size=(4000, 32))
    count, many = [], np.arange(4000)
    module._search(module._index(many, v, 8, 7), many[::50], v[::50], np.full(80, -np.inf), 5, chi_square_quantile(8, 0.97), count)
    assert sum(count) < 0.2 * 80 * 4000
    odd = spark.createDataFrame([(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [1.0, -1.0]), (4, [5.0, 5.0])], "vec_id long, embedding array<double>")
    found = nearest(odd, odd.where("vec_id = 1"), 3).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [2, 4, 3] and abs(found[0].score - 1) < 1e-12
    assert nearest(odd.limit(0), odd, 3).collect() == [] and nearest(odd, odd.limit(0), 3).collect() == []


def test_chats_read_back(spark):
    odd = ["", "\\", "</turn>", "<says>\\<turn>", "\\### Assistant: </turn> ok", "<<turn>", "\\n", "a\nb é漢", "<\\/turn>"]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    assert all(r.t == r.u for r in df.select("t", unescape(escape(F.col("t"))).alias("u")).collect())
    rows = [(1, 1, None, "user", "hi", 1.0), (1, 2, 1, "assistant", "a</turn>", 5.0), (1, 3, 1, "assistant", "b", 9.0), (1, 4, 2, None, None, 8.0), (1, 5, 3, "user", "c", 1.0), (2, 1, 77, "assistant", "lone", None)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    out = {r.tree: r for r in format_chats(df).select("tree", "leaf", read_chats(F.col("formatted")).alias("t"), loss_text(F.col("formatted"), F.col("loss")).alias("l")).collect()}
    assert out[1].leaf == 4 and [tuple(t) for t in out[1].t] == [("user", "hi"), ("assistant", "a</turn>"), ("", "")] and out[1].l == "a</turn>"
    assert [tuple(t) for t in out[2].t] == [("assistant", "lone")]
    assert format_chats(df, branches=None).count() == 3
    deep = spark.range(100).select(F.lit(1).alias("tree"), F.col("id").alias("node"), (F.col("id") - 1).alias("parent"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit(1.0).alias("score"))
    assert [t.text for t in format_chats(deep).select(read_chats(F.col("formatted")).alias("t")).first().t] == [str(i) for i in range(100)]
    assert format_chats(df.limit(0)).collect() == []


def test_chats_with_circles_ties_and_long_texts(spark):
    rows = [(1, 1, 3, "user", "a", 1.0), (1, 2, 1, "user", "b", 1.0), (1, 3, 2, "user", "c", 1.0), (1, 4, 3, "user", "hangs on the circle", 9.0)]
    rows += [(2, 1, None, "user", "q" * 200000, 1.0), (2, 2, 1, "assistant", "tie", 5.0), (2, 3, 1, "assistant", "tie too", 5.0)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    out = format_chats(df).select("tree", "leaf", read_chats(F.col("formatted")).alias("t")).collect()
    assert [(r.tree, r.leaf, [len(x.text) for x in r.t]) for r in out] == [(2, 2, [200000, 3])]


def test_chat_query_holds_the_sample(spark):
    row = op4_chat_format(spark, TINY).where("conv_id = -7").first()
    text = r"\### Assistant: </turn> ok"
    assert (row.n_turns, row.loss_chars) == (2, len(text)) and row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_pages(spark):
    long = "The quick brown fox of the forest is in the house and it was on the way to the river, as they have said. "
    page = f"<html><body><nav><a href=x>Home</a></nav><article><h1>T &amp; x</h1><p>{long}<p>Short<br>one<script>var t='</p>'</script><div class='comments'><p>{long}</div><p>end</article><footer>(c)</footer>"
    assert main_text(page) == f"T & x {long.strip()} Short one end"
    assert main_text(f"<div class='menu'><a>Home</a></div><p>{long}</p><p>tail</p><!-- x --><div id=sidebar>{long}</div>") == f"{long.strip()} tail"
    assert [main_text(p) for p in (None, "", "<p", "plain", "<p>a<b")] == ["", "", "", "plain", "a"]
    df = spark.createDataFrame([(1, "u", page, "x"), (None, None, None, "y")], "page_id long, url string, html string, text string")
    assert sorted((r.n_chars, r.page_id) for r in extract_html(df).collect()) == [(0, None), (len(main_text(page)), 1)]
    assert len(main_text("<div>" * 20000 + long)) and main_text("<p>a" * 20000)


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(None, None, "z"), (-1, "", "z"), (-2, "x" * 5000, "z")], "doc_id long, text string, score string")
    rows = score_quality(docs.select("doc_id", "text", F.lit("s").alias("score")).unionByName(odd), labels).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows) and len(rows) == docs.count() + 3
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows if r.doc_id is not None)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean(held) > 0.95
    many = labels.select("doc_id", "quality").unionByName(labels.select("doc_id", F.lit(None).cast("int").alias("quality"))).unionByName(labels.select("doc_id", F.lit(0).alias("quality")))
    twice = score_quality(docs.unionByName(docs.limit(40)), many).collect()
    assert len(twice) == docs.count() + 40 and all(len({r.score for r in twice if r.doc_id == i}) == 1 for i in {r.doc_id for r in twice})
    none = score_quality(odd.limit(2), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_pipeline_stages_on_their_own_input(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").cache()
    again, k = docs, {name: f for name, f in corpus_pipeline.STAGES}
    kept = k["quality"](spark, docs, TINY)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    lines = k["lines"](spark, again, TINY)
    assert lines.columns == docs.columns and lines.count() == docs.count() and lines.where("n_chars <> length(text)").count() == 0
    one = k["near_duplicates"](spark, docs.unionByName(docs.limit(3)), TINY)
    assert one.columns == docs.columns and one.count() == one.select("doc_id").distinct().count() < docs.count()
    packed = k["packing"](spark, docs.limit(5), TINY)
    assert packed.select("doc_id").distinct().count() == 5
    assert corpus_pipeline.run(spark, TINY).count() > 0


@pytest.mark.parametrize("name", ["quality", "lines", "near_duplicates", "packing"])
def test_stages_take_empty_tables(spark, name):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").limit(0)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, TINY).collect() == []


def test_pooled_vectors_against_brute_force():
    from repairbench.llm import quality
    from repairbench.llm.shingles import word_hashes

    vectors = quality.index_vectors()
    texts = [b"one two two three", b"", None, b"  \t", b"x" * 5000, b"a b " * 700]
    got = quality.features(texts, vectors)
    for t, x in zip(texts, got, strict=True):
        v = vectors[quality._buckets(word_hashes([t])[0])]
        want = np.concatenate([v.mean(axis=0), (v * v).mean(axis=0)]) if len(v) else np.zeros(quality.WIDTH)
        assert np.allclose(x, want, atol=1e-5)


def test_pipeline_takes_nulls_extra_and_clashing_columns(spark):
    texts = [None, "", "same words here for both of them", "same words here for both of them", "A line of its own, long enough to count for more than forty.\nx"]
    rows = [(i if i < 4 else None, t, "en", "s", len(t or ""), "k", 7, "m") for i, t in enumerate(texts)] + [(1, "", "en", "s", 0, "k", 7, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, other_id string, row int, lost string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, TINY)
        if name != "packing":
            assert out.columns == docs.columns
        if name == "near_duplicates":
            assert sorted(str(r.doc_id) for r in out.collect()) == ["0", "1", "2", "None"]
        elif name == "lines":
            assert out.count() == 6
        else:
            out.collect()


def test_chats_without_a_tree_are_one_tree(spark, tmp_path):
    import duckdb

    from repairbench.llm.chat_format import ORACLE

    rows = [(None, 1, None, "user", "q", 1.0), (None, 2, 1, "assistant", "low", 1.0), (None, 3, 1, "assistant", "high", 2.0), (0, 1, None, "user", "other", 1.0)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    out = {r.tree: [x.text for x in r.t] for r in format_chats(df).select("tree", read_chats(F.col("formatted")).alias("t")).collect()}
    assert out == {None: ["q", "high"], 0: ["other"]} and format_chats(df, branches=None).count() == 3
    talk = [(c, t, ("user", "assistant")[t % 2], f"{c} </turn> {t}") for c in (None, 0, 1) for t in range(5)]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r) for r in op4_chat_format(spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert set(got) == {None, 0, 1, -7} and got == {r[0]: r for r in db.sql(ORACLE).fetchall()}


def test_long_blocks_need_no_stop_words():
    fin = "Metsän laidalla seisoi vanha talo, jonka ikkunoista näkyi järvelle saakka koko pitkän kesän ajan."
    links = f"<p><a href=x>{'Lue lisää uutisia täältä ' * 4}</a></p>"
    numbers = "1024 2048 4096 8192 Aho Berg Cederqvist Dahl Ek Forss Grahn Hult Ilves Juslin 16384 32768"
    for page in (f"<article><p>{fin}</p>{links}<p>{numbers}</p></article>", f"<p>{fin}</p>{links}<p>{numbers}</p>"):
        assert main_text(page) == f"{fin} {numbers}"
    known = "The quick brown fox of the forest is in the house and it was on the way to the river, as they have said."
    assert main_text(f"<p>{known}</p><p>\N{COPYRIGHT SIGN} {known}</p><p>\N{COPYRIGHT SIGN} 2024 Shop</p>") == f"{known} \N{COPYRIGHT SIGN} {known}"
    assert main_text(f"<p>{known}</p>{links}<p>{numbers}</p>{links}") == known


KNOWN = "The quick brown fox of the forest is in the house and it was on the way to the river, as they have said."


def test_names_only_weigh():
    side = f"<div class='sidebar'><p>{KNOWN}</p></div>"
    for page in (f"<div class='layout with-sidebar'><p>{KNOWN}</p>{side}</div>", f"<div id='comment-free legal-notice-text'><p>{KNOWN}</p></div>", f"<form action=x><div><p>{KNOWN}</p></div><button>Send</button></form>", f"<div class='promo'><p>{KNOWN}</p></div><footer>{KNOWN}</footer>"):
        assert main_text(page) == KNOWN
    article = f"<article><header><h1>Title</h1></header><p>{KNOWN}</p></article>"
    comments = f"<section id=comments><article class=comment><p>{KNOWN} {KNOWN} {KNOWN}</p></article></section>"
    assert main_text(article + comments) == main_text(comments + article) == f"Title {KNOWN}"
    assert main_text(f"<main><p>{KNOWN}</p><div class='comments'><p>{KNOWN} {KNOWN} {KNOWN}</p></div></main>") == KNOWN


def test_an_article_keeps_its_linked_and_captioned_blocks():
    linked = "<p>See <a href=x>the longest of all the linked sentences of this page</a> for it.</p>"
    page = f"<article><p>{KNOWN}</p>{linked}<figure><img src=x><figcaption>A caption</figcaption></figure><p>\N{COPYRIGHT SIGN} {KNOWN}</p><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul></article>"
    assert main_text(page) == f"{KNOWN} See the longest of all the linked sentences of this page for it. A caption \N{COPYRIGHT SIGN} {KNOWN}"


L = "A plain paragraph of the article that is long enough to be told from a short one, as it goes on for a while in the usual words of such it."


def test_no_article_text_goes_by_one_word_of_a_name():
    inside = "<article><h1 class='header'>Head</h1><p>{0}</p>{1}</article>"
    for part in (f"<div class='share-price'><p>{L}</p></div>", f"<p class='notice-of-death'>{L}</p>", f"<div class='article-header'><p>{L}</p></div>"):
        assert main_text(inside.format(L, part)) == f"Head {L} {L}"
    assert main_text(f"<p>{L}</p><div class='cookie-recipe'><p>{L}</p><p>{L}</p></div>") == f"{L} {L} {L}"
    assert main_text(inside.format(L, "<div class='share-price'><a href=x>Share this</a></div>")) == f"Head {L}"
    for name in ("ad", "ad-slot", "share-buttons", "cookie-consent-bar", "article-comments", "newsletter-signup"):
        assert main_text(inside.format(L, f"<div class='{name}'><p>{L}</p></div>")) == f"Head {L}"


def test_comments_and_foot_lines_of_pages_without_an_article():
    assert main_text(f"<p>{L}</p><div class=comments><p>{L}</p><p>{L}</p><p>{L}</p><p>{L}</p></div>") == L
    assert main_text(f"<p>{L}</p><p>All rights reserved</p>") == main_text(f"<p>{L}</p><div>Contact us</div>") == L
    assert main_text(f"<article><p>{L}</p><p>Contact us</p></article>") == f"{L} Contact us"


def test_deep_pages_are_linear():
    import time

    ads = "<div class=ad>" * 8000
    links = "<p><a href=x>one of very many links</a></p>" * 8000
    for page, want in ((f"<p>{L}</p>{ads}{L}{'</div>' * 8000}", L), (ads + L, L), (f"<p>{L}</p>{links}", L), ("<div>" * 8000 + "</b></section>" * 8000 + L, L)):
        start = time.process_time()
        assert main_text(page) == want
        assert time.process_time() - start < 1


def test_pass_one_against_an_independent_rule():
    import random

    from repairbench.llm.html_extract import Mark

    rng = random.Random(9)
    for _ in range(400):
        marks: list = [None]
        for _ in range(rng.randrange(6)):
            marks.append(Mark(rng.choice(marks), rng.choice(["aside", "aside", "readers", "doubt"])))
        blocks, chains = [], []
        for m in sorted(rng.choices(range(len(marks)), k=rng.randrange(1, 12))):
            text = rng.choice(["Short one", KNOWN, L + L, "Wxyz " * 30]).strip()
            blocks.append(Block(text, rng.choice([0, 0, 0, len(text)]), rng.choice([0, 0, 1]), rng.random() < 0.1, marks[m]))
            chain, at = [], marks[m]
            while at:
                chain, at = [at, *chain], at.outer
            chains.append(chain)
        plain = [len(b.text) >= 70 and not b.linked and not b.outside for b in blocks]
        size = lambda keep: sum(len(b.text) for b, c, ok in zip(blocks, chains, plain) if ok and keep(b, c))
        out = {m for c in chains for m in c if m.kind != "doubt"}
        order = list(dict.fromkeys(m for c in chains for m in c))
        for m in order:
            if m in out and not out & set(next(c for c in chains if m in c)[: next(c for c in chains if m in c).index(m)]):
                held, bare = size(lambda b, c, m=m: m in c), size(lambda b, c: not out & set(c))
                article = size(lambda b, c: b.part and not out & set(c))
                if held and (not bare or m.kind != "readers" and held > 0.7 * size(lambda b, c: True) and not article):
                    out.discard(m)
        classify(blocks)
        gone = [b.outside or bool(out & set(c)) for b, c in zip(blocks, chains)]
        articles = any(b.part and not g for b, g in zip(blocks, gone))
        good = []
        for b, c, g, ok in zip(blocks, chains, gone, plain):
            doubt = any(m.kind == "doubt" for m in c)
            if g or articles and not b.part:
                assert b.label == "bad"
            elif ok and (b.text == L + L or b.part and not doubt or b.text == KNOWN and not doubt):
                good.append(b)
                assert b.label == "good"
            elif not b.linked:
                assert b.label != "bad" and (b.label == "" or ok)
        assert not good or {id(b) for b in good} == {id(b) for b in blocks if b.label == "good"}


def test_two_passes_against_brute_force():
    import random

    rng = random.Random(12)
    for _ in range(300):
        blocks = []
        for _ in range(rng.randrange(1, 25)):
            text = rng.choice(["Short one", KNOWN, "Wxyz " * 30, "Menu"]).strip()
            blocks.append(Block(text, rng.choice([0, 0, 0, len(text)]), rng.choice([0, 0, 1]), rng.random() < 0.1))
        classify(blocks)
        kept = []
        for i, b in enumerate(blocks):
            decided = [(abs(i - j), j > i, x.label) for j, x in enumerate(blocks) if x.label and not x.outside and x.part == b.part and j != i]
            if b.label == "good" or not b.label and (not decided or min(decided)[2] == "good"):
                kept.append(b)
        assert [id(b) for b in inherit(blocks)] == [id(b) for b in kept]
        for b in blocks:
            if b.outside or (b.part == 0 and any(x.part and not x.outside for x in blocks)):
                assert b.label == "bad"
            elif len(b.text) >= 70 and not b.linked and b.part:
                assert b.label == "good"


def test_pages_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "u", f"<p>{KNOWN}"), (1, "u", f"<p>{KNOWN}"), (2, None, "")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.text) for r in extract_html(df).collect()) == [(1, KNOWN), (1, KNOWN), (2, "")]
    assert extract_html(df.limit(0)).collect() == []


def test_word_vectors_come_from_all_texts(spark, monkeypatch):
    from repairbench.llm import quality
    from repairbench.llm.shingles import word_hashes

    texts = [(i, f"alpha beta gamma delta word{i} omega") for i in range(40)] + [(99, None), (100, "")]
    seen, real = [], quality.word_vectors
    monkeypatch.setattr(quality, "word_vectors", lambda *a: seen.append(real(*a)) or seen[0])
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    quality.score_quality(docs, spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int"), sample=4)
    index = quality.index_vectors()
    context = np.zeros(index.shape)
    for _, t in texts:
        b = quality._buckets(word_hashes([(t or "").encode()])[0])
        for i in range(len(b)):
            for j in range(max(0, i - quality.WINDOW), min(len(b), i + quality.WINDOW + 1)):
                if i != j:
                    context[b[i]] += index[b[j]]
    want = index + context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1)
    assert np.allclose(seen[0], want, atol=1e-5)
