"""Mapping of line descriptions to catalogue items: part number, then exact text, then fuzzy text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repairbench.functions.rules import type_compatible
from repairbench.functions.text import apply_invoice_aliases, normalise_description, part_number_key

#: Texts and names of a block of the fuzzy join; a task meets one block of each.
BLOCK_TEXTS, BLOCK_NAMES = 4096, 2048


def match_part_number(lines: DataFrame, items: DataFrame) -> DataFrame:
    """line_id, item_id, confidence, kind: lines whose part number is one of an item's."""
    numbers = items.select("item_id", F.explode("part_numbers").alias("p")).select("item_id", part_number_key(F.col("p")).alias("key")).where("key <> ''").distinct()
    keyed = lines.select("line_id", part_number_key(F.col("part_number")).alias("key")).where("key <> ''")
    return keyed.join(numbers, "key").select("line_id", "item_id", F.lit(1.0).alias("confidence"), F.lit("exact_part_number").alias("kind"))


def match_exact_text(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Lines whose normalised description is an item's name (.99) or one of its synonyms (.98)."""
    names = items.select("item_id", normalise_description(F.col("name")).alias("text"), F.lit(0.99).alias("confidence"), F.lit("exact_canonical_name").alias("kind"))
    synonyms = items.select("item_id", F.explode("synonyms").alias("s")).select("item_id", normalise_description(F.col("s")).alias("text"), F.lit(0.98).alias("confidence"), F.lit("exact_synonym").alias("kind"))
    known = names.unionByName(synonyms).groupBy("text", "item_id").agg(F.max(F.struct("confidence", "kind")).alias("m"))
    return lines.select("line_id", "text").join(known, "text").select("line_id", "item_id", "m.confidence", "m.kind")


def indel_similarity(a: str, b: str) -> float:
    """2 * longest common subsequence / length of both; a bit for each character of `a` in whole numbers."""
    if not a and not b:
        return 1.0
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & at.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def token_set_similarity(a: str, b: str) -> float:
    """Best indel similarity among the shared words, and the shared words with either side's rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = (" ".join([both, *sorted(s)]).strip() if both else " ".join(sorted(s)) for s in (x - y, y - x))
    if both and (not x - y or not y - x):
        return 1.0
    scores = [indel_similarity(left, right)]
    if both:  # it begins both sides, so it is the common part
        scores += [2 * len(both) / (len(both) + len(left)), 2 * len(both) / (len(both) + len(right))]
    return max(scores)


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text's distinct words, joined: counts of characters by kind (32 kinds), the length, a 64-bit mask of words."""
    counts, masks = np.zeros((len(texts), 32), np.int16), np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        words = set(text.split())
        joined = " ".join(words)
        counts[k] = np.bincount(np.frombuffer(joined.encode("utf-32-le"), np.uint32) % 32, minlength=32)
        for w in words:
            masks[k] |= np.uint64(1 << (sum(w.encode()) * 31 + len(w)) % 64)
    return counts, counts.sum(axis=1, dtype=np.int32), masks


def bounds(left: tuple, k: int, right: tuple) -> np.ndarray:
    """Upper bounds of the similarity of one text with all names.

    A common subsequence holds no more of a kind of character than either side. Without a shared word that is all; with
    one, its shared words alone may be as like the shorter side as their characters allow.
    """
    common = np.minimum(left[0][k], right[0]).sum(axis=1, dtype=np.int32).astype(float)
    size, other = float(left[1][k]), right[1].astype(float)
    plain = 2 * common / np.maximum(size + other, 1)
    shared = 2 * common / np.maximum(common + np.minimum(size, other), 1)
    return np.where((left[2][k] & right[2]) != 0, shared, plain)


def fuzzy_pairs(texts: DataFrame, names: DataFrame, least: float, block_texts: int = BLOCK_TEXTS, block_names: int = BLOCK_NAMES) -> DataFrame:
    """text, item_id, confidence, scored: pairs of texts(text) and names(item_id, name) whose similarity is `least` or more.

    Blocks of texts meet blocks of names, one pair of blocks in a task; neither side is collected or broadcast. Bounds by
    character counts drop most pairs before they are scored (scored: how many of the text and block were).
    """
    n, m = (max(1, -(-df.count() // most)) for df, most in ((texts, block_texts), (names, block_names)))
    dealt = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    left = texts.select("text", dealt("text", n).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("b"))
    right = names.select("item_id", "name", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("a"), dealt("name", m).alias("b"))
    kind = dict(names.dtypes)["item_id"]

    def meet(some: pa.Table, listed: pa.Table) -> pa.Table:
        found, ids, lines = listed["name"].to_pylist(), listed["item_id"].to_pylist(), some["text"].to_pylist()
        l, r, rows = _letters(lines), _letters(found), []
        for k, text in enumerate(lines):
            near = np.flatnonzero(bounds(l, k, r) >= least - 1e-4).tolist()
            for j in near:
                score = round(token_set_similarity(text, found[j]) + 1e-12, 4)
                if score >= least:
                    rows.append((text, ids[j], score, len(near)))
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        return pa.table(dict(zip(("text", "item_id", "confidence", "scored"), map(pa.array, columns, (pa.string(), listed.schema.field("item_id").type, pa.float64(), pa.int64())), strict=True)))

    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(meet, f"text string, item_id {kind}, confidence double, scored long")


def match_fuzzy(lines: DataFrame, items: DataFrame, least: float = 0.45) -> DataFrame:
    """Items whose best name is similar enough to a line's text; each distinct text is compared once (see `fuzzy_pairs`)."""
    texts = lines.where("text IS NOT NULL").select("text").distinct()
    names = items.select("item_id", F.explode(F.array_append(F.col("synonyms"), F.col("name"))).alias("n")).select("item_id", normalise_description(F.col("n")).alias("name")).where("name IS NOT NULL").distinct()
    best = fuzzy_pairs(texts, names, least).groupBy("text", "item_id").agg(F.max("confidence").alias("confidence"))
    return lines.select("line_id", "text").join(best, "text").select("line_id", "item_id", "confidence", F.lit("fuzzy").alias("kind"))


def map_lines(lines: DataFrame, items: DataFrame, top_k: int = 8, fuzzy_least: float | None = 0.45) -> DataFrame:
    """One row for each line: the chosen item or null, confidence, decision, candidates (their number), alternatives, status, type_mismatch.

    lines(line_id, description, part_number, kind), items(item_id, name, item_type, synonyms, part_numbers). A line
    goes to the next stage only if the one before found nothing. The best `top_k` by confidence and item id are
    cut before types are compared, so a stage whose hits are of the wrong type ends without a match (type_mismatch).
    Alternatives (item_id, name, kind, confidence) are the other candidates of a fitting type, or all where none was chosen;
    status is auto_accepted above a confidence of .95, else review.
    """
    texts = lines.withColumn("text", apply_invoice_aliases(normalise_description(F.col("description"))))
    found = match_part_number(texts, items)
    rest = texts.join(found.select("line_id").distinct(), "line_id", "left_anti")
    exact = match_exact_text(rest, items)
    found = found.unionByName(exact)
    if fuzzy_least is not None:
        rest = rest.join(exact.select("line_id").distinct(), "line_id", "left_anti")
        found = found.unionByName(match_fuzzy(rest, items, fuzzy_least))
    order = Window.partitionBy("line_id").orderBy(F.desc("confidence"), "item_id")
    top = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_k)
    typed = top.join(items.select("item_id", "name", "item_type"), "item_id").join(lines.select("line_id", F.col("kind").alias("line_kind")), "line_id")
    fits = typed.withColumn("fits", F.coalesce(type_compatible(F.col("line_kind"), F.col("item_type")), F.lit(False)))
    listed = F.array_sort(F.collect_list(F.struct("place", "fits", "item_id", "name", "kind", "confidence")))
    chosen = fits.groupBy("line_id").agg(F.min_by(F.struct("item_id", "confidence", "kind", "place"), F.when(F.col("fits"), F.col("place"))).alias("c"), F.count("*").alias("candidates"), listed.alias("listed"))
    decision = F.when(F.col("c").isNull(), "no_match").when(F.col("c.kind") == "exact_part_number", "exact_part_number").when(F.col("c.kind") == "fuzzy", "fuzzy").otherwise("synonym")
    others = F.filter("listed", lambda x: F.col("c").isNull() | (x["fits"] & (x["place"] != F.col("c.place"))))
    others = F.transform(others, lambda x: F.struct(x["item_id"].alias("item_id"), x["name"].alias("name"), x["kind"].alias("kind"), x["confidence"].alias("confidence")))
    out = lines.select("line_id").join(chosen.withColumn("alternatives", others), "line_id", "left")
    status = F.when(F.col("c.confidence") > 0.95, "auto_accepted").otherwise("review")
    mismatch = F.col("c").isNull() & (F.coalesce("candidates", F.lit(0)) > 0)
    return out.select("line_id", F.col("c.item_id").alias("item_id"), F.col("c.confidence").alias("confidence"), decision.alias("decision"), F.coalesce("candidates", F.lit(0)).alias("candidates"), "alternatives", status.alias("status"), mismatch.alias("type_mismatch"))
