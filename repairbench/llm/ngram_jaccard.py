"""N-gram Jaccard join by grouped prefix filtering.

1. Documents with the same shingle set collapse into one class (its smallest id stands for it).
2. Classes order their shingles rarest first by a bounded count sketch of the corpus. Any total order
   makes the prefix filter exact; the sketch only makes prefixes rare. Of a set of n shingles the first
   n - ceil(t n) + 1 are its prefix: two sets of similarity t or more share one.
3. Classes of identical prefix and size collapse into one group, and only groups post their prefixes.
4. Lists of a shingle give group pairs that pass the size and position filters; groups then expand to
   their classes. Pairs meet on bitmaps of their sets first, which bound what the sets differ in from below; only
   pairs that this leaves are verified on whole sets.

A list is never expanded into all its pairs. In star rounds its members are verified against a few pivots, and
what is linked shares a label. Later rounds keep only lists with several labels. What is left in the end, pairs
of different labels, is verified to the last pair: short lists by a join, long lists block against block inside
tasks that give out links only. Pairs under one label can't change a component, so the components are exact.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, bytes_list, chunks, read_table, small, tidied
from .components import connected_components
from .shingles import SIZE, shingle_sets

#: Counters of the sketch (2 ** bits; 2 bytes each in a task, 1 byte each when broadcast) and of one block.
SKETCH_BITS, BLOCK_BITS = 22, 16
#: Pivots of the star rounds, at most; lists above LONG rows are finished in blocks of these sizes.
PIVOTS, LONG, FEW_BLOCK, ALL_BLOCK = (1, 4, 4, 4), 48, 64, 1024
#: Most rows of what is known of lists (some 60 bytes each) that may be broadcast to their members.
LIST_ROWS = 100_000
#: Tasks that the copies of one text are dealt to.
SALTS = 16
#: Places that postings are dealt to, at least, most postings of a place on average, and postings packed at once in a task.
PLACES, PLACE_ROWS, PACKED = 256, 1 << 22, 1 << 19
#: Bits of a document's bitmap for each of its shingles, at least.
MARK_BITS = 4
_MASK = np.uint64((1 << SKETCH_BITS) - 1)


def _sets(batch: pa.RecordBatch, size: int):
    ids, texts = batch.column(0).to_pylist(), bytes_list(batch.column(1))
    for i, j in chunks(texts):
        yield from zip(ids[i:j], shingle_sets(texts[i:j], size), strict=True)


@tidied
def _digests(batches, size: int):
    """A row for each document (kind 0), then the task's counts in blocks (kind 1)."""
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    for batch in batches:
        rows = []
        for doc_id, s in _sets(batch, size):
            np.add.at(counts, (s & _MASK).astype(np.int64), 1)
            d = xxhash.xxh3_128_intdigest(s.tobytes())
            rows.append((doc_id, len(s), (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)))
        ids, n, hi, lo = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array([0] * len(n), pa.int32()), pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.nulls(len(n), pa.binary())],
            ["kind", "doc_id", "n", "hi", "lo", "block"],
        )
    if counts.any():
        blocks = np.minimum(counts, 65535).astype(np.uint16).reshape(-1, 1 << BLOCK_BITS)
        k = len(blocks)
        yield pa.RecordBatch.from_arrays(
            [pa.array([1] * k, pa.int32()), pa.nulls(k, pa.int64()), pa.array([0] * k, pa.int64()), pa.array([0] * k, pa.int64()), pa.array(range(k), pa.int64()), pa.array([b.tobytes() for b in blocks], pa.binary())],
            ["kind", "doc_id", "n", "hi", "lo", "block"],
        )


@tidied
def _sum_blocks(batches):
    """Adds up the blocks of a partition as they stream by; gives classes of frequency, a byte for each counter."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            b = np.frombuffer(block, np.uint16).astype(np.int64)
            total[k] = total[k] + b if k in total else b
    for k, b in total.items():
        rank = np.minimum(4 * np.log2(np.maximum(b, 1)), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([rank.tobytes()], pa.binary())], ["lo", "block"])


@tidied
def _prefixes(batches, size: int, percent: int, sketch):
    rank = np.frombuffer(sketch.value, np.uint8)
    for batch in batches:
        rows = []
        for doc_id, s in _sets(batch, size):
            if n := len(s):
                order = np.argsort(rank[(s & _MASK).astype(np.int64)], kind="stable")[: n + (-percent * n) // 100 + 1]
                prefix = s[order].tobytes()
                rows.append((doc_id, n, xxhash.xxh3_64_intdigest(prefix) - (1 << 63), prefix))
        ids, n, digest, prefix = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.int64()), pa.array(prefix, pa.binary())], ["cid", "n", "digest", "prefix"])


@tidied
def _postings(batches, places: int):
    """Postings of many classes as lists by place. A key is 32 bits of a shingle beside its place: shingles that share one share a list."""
    held, many = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), [np.frombuffer(p, np.uint64) for p in batch.column(2).to_pylist()]))
        many += sum(map(len, held[-1][2]))
        if many >= PACKED:
            yield _packed(held, places)
            held, many = [], 0
    if many:
        yield _packed(held, places)


def _packed(held: list, places: int) -> pa.RecordBatch:
    prefixes = [p for _, _, ps in held for p in ps]
    k, token = np.fromiter(map(len, prefixes), np.int64, len(prefixes)), np.concatenate(prefixes)
    place = (token % np.uint64(places)).astype(np.int32)
    order = np.argsort(place, kind="stable")
    there, start = np.unique(place[order], return_index=True)
    ends = pa.array(np.append(start, len(order)).astype(np.int32))
    pos = np.arange(len(order)) - np.repeat(np.cumsum(k) - k, k)
    columns = [(token >> np.uint64(32)).astype(np.uint32).view(np.int32), np.repeat(np.concatenate([c for c, _, _ in held]), k)]
    columns += [np.repeat(np.concatenate([n for _, n, _ in held]), k).astype(np.int32), pos.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(there), *[pa.ListArray.from_arrays(ends, pa.array(c[order])) for c in columns]], ["place", "keys", "cids", "ns", "poss"])


@tidied
def _marks(batches, size: int):
    """Bitmaps of sets, of a power of two of bits: a shingle sets the bit of its lowest bits, so the halves of one make the next smaller one."""
    for batch in batches:
        rows = []
        for doc_id, s in _sets(batch, size):
            if len(s):
                m = np.zeros(max(64, MARK_BITS << (len(s) - 1).bit_length()), np.uint8)
                m[(s & np.uint64(len(m) - 1)).astype(np.int64)] = 1
                rows.append((doc_id, len(s), np.packbits(m).tobytes()))
        ids, n, mark = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(mark, pa.binary())], ["cid", "n", "m"])


@tidied
def _near(batches, percent: int):
    """Pairs with whether their bitmaps allow a link: sets differ in a shingle at least for each bit in which these do."""
    for batch in batches:
        a, b, na, nb, ma, mb = (c.to_pylist() for c in batch.columns)
        keep = []
        for m, k, x, y in zip(na, nb, ma, mb, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(x) > len(y):
                x, y = y, x
            apart = int(np.bitwise_count(x ^ np.bitwise_or.reduce(y.reshape(-1, len(x)))).sum())
            keep.append((100 + percent) * apart <= (100 - percent) * (m + k))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(keep, pa.bool_())], ["a", "b", "near"])


@tidied
def _whole_sets(batches, size: int):
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            rows = [(d, s.tobytes()) for d, s in _sets(batch.slice(i, 500), size) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.binary())], ["cid", "s"])


@tidied
def _verified(batches, percent: int):
    for batch in batches:
        a, b, sa, sb = (c.to_pylist() for c in batch.columns)
        keep = []
        for x, y in zip(sa, sb, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(keep, pa.bool_())], ["a", "b", "linked"])


def _block_links(table: pa.Table, percent: int) -> pa.Table:
    """Links between the few (open labels) and all rows of a block pair, as many as it takes to join their labels."""
    table = table.combine_chunks()
    cid, label, few = table["cid"].to_numpy(), table["label"].to_numpy(), table["few"].to_numpy(zero_copy_only=False)
    sets = [np.frombuffer(x, np.uint64) for x in table["s"].to_pylist()]
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    x, y = np.flatnonzero(few), np.flatnonzero(~few)
    if not len(x) or not len(y):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    known = np.unique(np.concatenate([sets[i] for i in x]))
    both = np.zeros((len(x), len(y)), np.float32)
    sides = []
    for side in (x, y):
        flat, owner = np.concatenate([sets[i] for i in side]), np.repeat(np.arange(len(side)), n[side])
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        hit = known[at] == flat
        order = np.argsort(at[hit], kind="stable")
        sides.append((at[hit][order], owner[hit][order], len(side)))
    for c in range(0, len(known), 2048):
        part = []
        for at, owner, rows in sides:
            i, j = np.searchsorted(at, (c, c + 2048))
            m = np.zeros((rows, 2048), np.float32)
            m[owner[i:j], at[i:j] - c] = 1
            part.append(m)
        both += part[0] @ part[1].T
    linked = (100 * both >= percent * (n[x][:, None] + n[y][None, :] - both)) & (label[x][:, None] != label[y][None, :])
    root = {v: v for v in label.tolist()}

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = v = root[root[v]]
        return v

    out = []
    for i in np.flatnonzero(linked.any(axis=1)):
        at, own = y[np.flatnonzero(linked[i])], int(label[x[i]])
        for k in at[np.unique(label[at], return_index=True)[1]]:
            p, q = find(own), find(int(label[k]))
            if p != q:
                root[p] = q
                out.append((cid[x[i]], cid[k]))
    return pa.table({"a": pa.array([int(a) for a, _ in out], pa.int64()), "b": pa.array([int(b) for _, b in out], pa.int64())})


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, size: int = SIZE) -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id.

    Two documents link when 100 * |A & B| >= percent * |A | B| over their sets of `size`-word shingles;
    component_id is the smallest id reachable by links, itself included.

    Null or empty texts, and texts without words: n_shingles 0, linked with nothing, component_id = doc_id.
    Rows with a null id keep their n_shingles, have a null component_id and take no part. Rows that share an
    id are one document with the links of all its texts. Sets hold 64-bit hashes of shingles. Other columns are ignored, an empty table gives none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = scratch.save(base.mapInArrow(partial(_digests, size=size), "kind int, doc_id long, n long, hi long, lo long, block binary"))
    rows = seen.where("kind = 0").select("doc_id", "n", "hi", "lo")

    blocks = 1 << (SKETCH_BITS - BLOCK_BITS)
    merged = seen.where("kind = 1").select("lo", "block").repartition(blocks, "lo").mapInArrow(_sum_blocks, "lo long, block binary")
    empty = bytes(1 << BLOCK_BITS)
    found = {r.lo: bytes(r.block) for r in merged.collect()}  # 2 ** SKETCH_BITS bytes, whatever the input
    sketch = spark.sparkContext.broadcast(b"".join(found.get(k, empty) for k in range(blocks)))

    filled = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy("n", "hi", "lo").agg(F.min("doc_id").alias("cid"), F.count("*").alias("c")).where("c > 1")
    # Copies of one text may be a third of all rows: their class goes to several tasks, each gets some of them.
    salted = filled.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    classes = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("c")
    member = scratch.save(salted.join(classes, ["n", "hi", "lo", "salt"], "left").select("doc_id", F.coalesce("cid", "doc_id").alias("cid")))
    copies = member.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("cid")).alias("stands")).where("NOT stands").select("doc_id")
    reps = base.where("doc_id IS NOT NULL").join(small(copies), "doc_id", "left_anti")

    sigs = scratch.save(reps.mapInArrow(partial(_prefixes, size=size, percent=percent, sketch=sketch), "cid long, n long, digest long, prefix binary"))
    lists = _lists(sigs, scratch, percent)

    verify = partial(_verify, base=base, scratch=scratch, size=size, percent=percent)
    labels, links = None, []
    repeated = member.groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a <> b")
    if not repeated.isEmpty():
        links = [scratch.save(member.join(repeated, "doc_id").where("cid <> a").select("a", F.col("cid").alias("b")).distinct())]
        labels = _relabel(None, links[0], scratch)
    tested, now = None, lists.withColumn("label", F.col("cid"))
    for k, pivots in enumerate((*PIVOTS, 0)):
        if labels is not None:
            old = labels.select(F.col("node").alias("cid"), F.col("label").alias("new"))
            now = now.join(small(old), "cid", "left").withColumn("label", F.coalesce("new", "label")).drop("new")
        most = None
        if k or labels is not None:
            # Lists under one label have nothing left to say.
            per_label = now.groupBy("token", "label").agg(F.count("*").alias("c"))
            most = per_label.groupBy("token").agg(F.sum("c").alias("total"), F.max(F.struct("c", "label")).alias("m"))
            most = most.select("token", "total", F.col("m.label").alias("main"), (F.col("total") - F.col("m.c")).alias("few"))
            most = scratch.save(most.where("few > 0"))
            now = now.join(small(most.select("token"), LIST_ROWS), "token", "left_semi")
        now = scratch.save(now.select("token", "cid", "n", "pos", "label"))
        if k:
            work, total = most.agg(F.sum(F.col("few") * F.col("total")), F.sum("total")).first()
            if not total:
                break
            pivots = 0 if work <= 8 * total else pivots
        pairs = _star_pairs(now, k, pivots, percent, scratch) if pivots else _short_pairs(now, most, percent)
        done = verify(pairs, tested)
        links.append(done.where("linked").select("a", "b"))
        if not pivots:
            links.append(_long_links(now, most, base, scratch, size, percent))
            break
        labels = _relabel(labels, links[-1], scratch)
        tested = done if tested is None else scratch.save(tested.unionByName(done))

    edges = reduce(DataFrame.unionByName, links)
    if labels is not None:
        at = labels.select("node", F.col("label").alias("to"))
        for side in ("a", "b"):
            edges = edges.join(small(at.withColumnRenamed("node", side)), side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
    found = connected_components(edges.where("a <> b").select("a", "b"), scratch)
    out = rows.join(member.groupBy("doc_id").agg(F.min("cid").alias("cid")), "doc_id", "left").withColumn("root", F.col("cid"))
    if labels is not None:
        out = out.join(small(labels.select(F.col("node").alias("root"), F.col("label").alias("first"))), "root", "left").withColumn("root", F.coalesce("first", "root"))
    out = out.join(small(found.select(F.col("node").alias("root"), F.col("component").alias("last"))), "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("last", "root", "doc_id").alias("component_id"))


def _lists(sigs: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """token, cid, n, pos: the classes behind each shingle that several groups post, and those of each larger group."""
    several = sigs.groupBy("n", "digest").agg(F.min("cid").alias("gid"), F.count("*").alias("c")).where("c > 1").drop("c")
    group = scratch.save(sigs.select("cid", "n", "digest").join(small(several), ["n", "digest"]).select("gid", "cid", "n").distinct())
    rest = group.where("cid <> gid").select("cid", F.col("n").alias("gn")).distinct()
    posting = sigs.join(small(rest), (sigs.cid == rest.cid) & (sigs.n == rest.gn), "left_anti").select("cid", "n", "prefix")
    # Postings shuffle in lists by place, which take half the room of rows; a place's rows are already where its windows need them.
    expected = (sigs.agg(F.sum("n")).first()[0] or 0) * (100 - percent) // 100
    places = max(PLACES, expected // PLACE_ROWS)
    posting = posting.mapInArrow(partial(_postings, places=places), "place int, keys array<int>, cids array<long>, ns array<int>, poss array<int>").repartition("place")
    posting = posting.select("place", F.explode(F.arrays_zip("keys", "cids", "ns", "poss")).alias("p")).select("place", F.col("p.keys").alias("key"), F.col("p.cids").alias("cid"), F.col("p.ns").alias("n"), F.col("p.poss").alias("pos"))
    # A row stays if some row of its list can pass the position filter with it, as far as the list's extremes tell.
    by_token = Window.partitionBy("place", "key")
    reach = (F.lit(100).cast("long") * F.col("n")) - (100 + percent) * F.col("pos").cast("long")
    told = posting.withColumn("reach", reach).withColumn("most", F.max("reach").over(by_token)).withColumn("least", F.min("n").over(by_token)).withColumn("c", F.count("*").over(by_token))
    told = told.where((F.col("c") > 1) & (F.col("most") >= percent * F.col("n").cast("long")) & (F.col("reach") >= percent * F.col("least").cast("long")))
    token = F.col("key").cast("long") * places + F.col("place")
    lists = scratch.save(told.withColumn("c", F.count("*").over(by_token)).where("c > 1").select(token.alias("token"), "cid", "n", "pos"))
    scratch.drop(sigs)
    others = group.where("cid <> gid").select(F.col("gid").alias("cid"), F.col("cid").alias("other"), F.col("n").cast("int").alias("n"))
    expanded = lists.join(small(others), ["cid", "n"]).select("token", F.col("other").alias("cid"), "n", "pos")
    whole = group.select(F.xxhash64(F.lit("group"), "gid", "n").alias("token"), "cid", F.col("n").cast("int").alias("n"), F.lit(0).alias("pos"))
    return lists.unionByName(expanded).unionByName(whole)


def _star_pairs(now: DataFrame, k: int, pivots: int, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs of a few pivots of each list with its other members.

    The members of a list fall into as many hash classes of this round; the least of each is a pivot. Pivots are
    aggregated before they shuffle, and lists meet them in a join, so a long list needn't lie in one task.
    """
    slot = F.pmod(F.xxhash64("cid", F.lit(-1 - k)), F.lit(pivots))
    first = F.min(F.struct(F.xxhash64("cid", F.lit(k)).alias("h"), "cid", "n", "pos", "label"))
    chosen = scratch.save(now.groupBy("token", slot.alias("slot")).agg(first.alias("p")).select("token", "p"))
    starred = now.join(small(chosen, LIST_ROWS), "token")
    starred = starred.where((F.col("label") != F.col("p.label")) & _fits(F.struct("n", "pos"), F.col("p"), percent))
    return starred.select(F.least("cid", "p.cid").alias("a"), F.greatest("cid", "p.cid").alias("b"))


def _short_pairs(now: DataFrame, most: DataFrame, percent: int) -> DataFrame:
    """All pairs of different labels in lists of LONG rows at most."""
    mine = now.join(most.where(F.col("total") <= LONG), "token")
    a, b = mine.where("label <> main").alias("a"), now.alias("b")
    differ = (F.col("a.label") != F.col("b.label")) & ((F.col("b.label") == F.col("a.main")) | (F.col("a.cid") < F.col("b.cid")))
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & differ & _fits(F.struct("a.n", "a.pos"), F.struct("b.n", "b.pos"), percent))
    return pairs.select(F.least("a.cid", "b.cid").alias("a"), F.greatest("a.cid", "b.cid").alias("b"))


def _long_links(now: DataFrame, most: DataFrame, base: DataFrame, scratch: Scratch, size: int, percent: int) -> DataFrame:
    """Links of different labels in longer lists: those outside its main label against all, block by block."""
    long = most.where(F.col("total") > LONG)
    rows = now.join(long, "token")
    parts = lambda n, block: F.ceil(F.col(n) / block).cast("int")
    place = lambda n, block: F.pmod(F.xxhash64("cid"), parts(n, block)).cast("int")
    other = lambda n, block: F.explode(F.sequence(F.lit(0), parts(n, block) - 1))
    few = rows.where("label <> main").select("token", "cid", "label", F.lit(True).alias("few"), place("few", FEW_BLOCK).alias("i"), other("total", ALL_BLOCK).alias("j"))
    every = rows.select("token", "cid", "label", F.lit(False).alias("few"), other("few", FEW_BLOCK).alias("i"), place("total", ALL_BLOCK).alias("j"))
    needed = scratch.save(rows.select(F.col("cid").alias("doc_id")).distinct())
    sets = base.join(small(needed), "doc_id", "left_semi").mapInArrow(partial(_whole_sets, size=size), "cid long, s binary")
    blocks = few.unionByName(every).join(sets, "cid").select("token", "i", "j", "cid", "label", "few", "s")

    def linked(table: pa.Table) -> pa.Table:
        return _block_links(table, percent)

    return scratch.save(blocks.groupBy("token", "i", "j").applyInArrow(linked, "a long, b long").distinct())


def _verify(pairs: DataFrame, tested: DataFrame | None, base: DataFrame, scratch: Scratch, size: int, percent: int) -> DataFrame:
    """a, b, linked: the pairs not tested yet; those that bitmaps leave are verified on whole sets."""
    pairs = pairs.distinct()
    pairs = scratch.save(pairs if tested is None else pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"))

    def texts(some: DataFrame) -> DataFrame:
        needed = some.select(F.col("a").alias("doc_id")).union(some.select("b")).distinct()
        return base.join(small(needed), "doc_id", "left_semi")

    marks = scratch.save(texts(pairs).mapInArrow(partial(_marks, size=size), "cid long, n long, m binary"))
    first, second = (marks.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("m").alias(f"m{x}")) for x in "ab")
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "na", "nb", "ma", "mb")
    near = scratch.save(both.mapInArrow(partial(_near, percent=percent), "a long, b long, near boolean").groupBy("a", "b").agg(F.max("near").alias("near")))
    scratch.drop(marks)
    left = near.where("near").select("a", "b")
    sets = scratch.save(texts(left).mapInArrow(partial(_whole_sets, size=size), "cid long, s binary"))
    first, second = (sets.select(F.col("cid").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    both = left.join(first, "a").join(second, "b").select("a", "b", "sa", "sb")
    done = both.mapInArrow(partial(_verified, percent=percent), "a long, b long, linked boolean")
    done = scratch.save(done.unionByName(near.where("NOT near").select("a", "b", F.lit(False).alias("linked"))))
    scratch.drop(sets)
    return done


def _relabel(labels: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label: labels that the links join take the smallest one in reach of two steps.

    Rows of one label are connected; the reverse holds only after the last step of the whole operator.
    """
    edges = links.select("a", "b")
    if labels is not None:
        for side in ("a", "b"):
            edges = edges.join(small(labels.select(F.col("node").alias(side), F.col("label").alias("to"))), side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
    edges = edges.where("a <> b").select("a", "b")
    near = edges.union(edges.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    near = scratch.save(near.select("node", F.least("node", "m").alias("to")))
    far = near.select(F.col("node").alias("to"), F.col("to").alias("next"))
    moved = near.join(small(far), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    if labels is None:
        return scratch.save(moved.select("node", F.col("to").alias("label")))
    kept = labels.join(small(moved.select(F.col("node").alias("label"), "to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    fresh = moved.join(small(labels.select("node")), "node", "left_anti").select("node", F.col("to").alias("label"))
    return scratch.save(kept.unionByName(fresh))


def _fits(x: Column, y: Column, percent: int) -> Column:
    """Size filter, and position filter: what overlap is still possible from this shared shingle on."""
    nx, ny, px, py = (t[c].cast("long") for t, c in ((x, "n"), (y, "n"), (x, "pos"), (y, "pos")))
    alike = (100 * F.least(nx, ny)) >= (percent * F.greatest(nx, ny))
    # overlap >= percent / (100 + percent) * (nx + ny), in integers
    return alike & ((100 + percent) * F.least(nx - px, ny - py) >= percent * (nx + ny))


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
rows AS (SELECT doc_id, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM rows a JOIN rows b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS d, doc_id AS m FROM sizes UNION SELECT e.b, r.m FROM reach r JOIN edges e ON r.d = e.a)
SELECT doc_id, n AS n_shingles, min(m) AS component_id FROM sizes JOIN reach ON doc_id = d GROUP BY ALL
"""
