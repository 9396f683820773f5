"""The trie of conversation prefixes by vertical bitmaps.

Conversations are dealt by ranges of their turns, so that few nodes have members in two shards. Each shard indexes
(position, turn) to the bitset of its conversations that have this turn there. A node is the bitset of its members;
its intersections with the postings of the next position are its children, depth first, and popcounts and end lists
come from the same bitsets. A node that only one shard has is finished there. Those that a neighbour may share lie on
the paths of a shard's first and last conversations: they are summed over shards, and subtree sums climb what really
is shared by pointer doubling.
"""

from __future__ import annotations

import hashlib
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import Scratch, small, tidied

#: Conversations and turns of a shard; turns by which conversations are dealt.
SHARD, SHARD_TURNS, DEALT = 2048, 1 << 17, 64
ROOT = bytes(16)

_LONG, _KEY = pa.int64(), pa.binary()
SUMS = ["children", "leaves", "saved"]
NODE = pa.schema(
    [("key", _KEY), ("parent", _KEY), ("parent_conv_id", _LONG), ("edge", pa.bool_())]
    + [(n, _LONG) for n in ("depth", "conv_id", "n_convs", "size", *SUMS, *(f"own_{x}" for x in SUMS), "n_ends", "first_end")]
    + [("ends", pa.string()), ("ends_sha256", pa.string())]
)


def bits(x: int):
    """Numbers of the set bits, ascending."""
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def shard_nodes(ids: list[int], turns: list[list[bytes]], sizes: list[list[int]]) -> list[tuple]:
    """Rows of NODE for the conversations of a shard, which stand in the order they are dealt by."""
    index: dict[tuple[int, bytes], int] = {}
    ending: dict[int, int] = {}
    for i, own in enumerate(turns):
        for place in enumerate(own):
            index[place] = index.get(place, 0) | 1 << i
        ending[len(own)] = ending.get(len(own), 0) | 1 << i
    low, high = turns[0][:DEALT], turns[-1][:DEALT]

    def along(path: list[bytes], depth: int, turn: bytes) -> bool:
        """Whether a path that has been followed so far goes on with this turn (behind the turns dealt by: any)."""
        return path[depth] == turn if depth < len(path) else len(path) == DEALT

    nodes, stack = [], [(0, (1 << len(ids)) - 1, ROOT, None, 0, True, True)]
    while stack:
        depth, members, key, parent, size, on_low, on_high = stack.pop()
        ends = members & ending.get(depth, 0)
        me = len(nodes)
        nodes.append((key, parent, depth, members.bit_count(), size, on_low or on_high, [ids[i] for i in bits(ends)]))
        rest = members & ~ends
        while rest:
            i = (rest & -rest).bit_length() - 1
            turn = turns[i][depth]
            posting = index[depth, turn]
            child = hashlib.sha256(key + turn).digest()[:16]
            stack.append((depth + 1, members & posting, child, me, sizes[i][depth], on_low and along(low, depth, turn), on_high and along(high, depth, turn)))
            rest &= ~posting
    # Children stand behind their parents: sums go from the last node to the first.
    total = [[0, 0, 0] for _ in nodes]
    inner = [[0, 0, 0] for _ in nodes]
    least = [min(n[6], default=None) for n in nodes]
    for me in range(len(nodes) - 1, -1, -1):
        _, parent, _, count, size, edge, _ = nodes[me]
        total[me][1] += total[me][0] == 0
        total[me][2] += (count - 1) * size
        if parent is not None:
            up = (1, total[me][1], total[me][2])
            for sums in (total[parent],) if edge else (total[parent], inner[parent]):
                for k in range(3):
                    sums[k] += up[k]
            least[parent] = least[me] if least[parent] is None else min(least[parent], least[me])
    out = []
    for me, (key, parent, depth, count, size, edge, ends) in enumerate(nodes):
        told = ",".join(map(str, sorted(ends)))
        above = None if parent is None else nodes[parent]
        out.append((
            key, above and above[0], least[parent] if above and not above[5] else None, edge, depth, least[me], count, size, *total[me], *inner[me],
            len(ends), min(ends, default=None), told if edge and ends else None, None if edge else hashlib.sha256(told.encode()).hexdigest(),
        ))
    return out


@tidied
def _shards(batches, most: int):
    """Sorted conversations to the nodes of their shards."""
    ids: list[int] = []
    turns: list[list[bytes]] = []
    sizes: list[list[int]] = []
    held = 0

    def batch() -> pa.RecordBatch:
        rows = shard_nodes(ids, turns, sizes)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), NODE.types, strict=True)], schema=NODE)

    for b in batches:
        for conv, own, size in zip(*[c.to_pylist() for c in b.columns], strict=True):
            ids.append(conv)
            turns.append(own)
            sizes.append(size)
            held += len(own)
            if len(ids) >= most or held >= SHARD_TURNS:
                yield batch()
                ids, turns, sizes, held = [], [], [], 0
    if ids:
        yield batch()


def _end_digests(batches):
    """Chunks of end lists, by node and in order, to the digest of each node's whole list."""
    schema = pa.schema([("key", _KEY), ("ends_sha256", pa.string())])
    key, sha = None, None
    for b in batches:
        for k, ends in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if k != key:
                if key is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([key], _KEY), pa.array([sha.hexdigest()])], schema=schema)
                key, sha = k, hashlib.sha256(ends.encode())
            else:
                sha.update(f",{ends}".encode())
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], _KEY), pa.array([sha.hexdigest()])], schema=schema)


def _shared(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes of possible edges, summed over shards: key, parent, depth, conv_id, n_convs, children, leaves, saved, ends_sha256."""
    sums = [F.sum(f"own_{x}").alias(f"own_{x}") for x in SUMS] + [F.max(x).alias(x) for x in SUMS]
    one = edges.groupBy("key").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("size").alias("size"),
        F.count("*").alias("shards"), F.sum("n_ends").alias("n_ends"), *sums,
    )
    one = scratch.save(one)
    # A node of one shard is whole there. The others take what hangs on them: inner sums, and children on possible edges.
    alone = F.col("shards") == 1
    hung = one.where("parent IS NOT NULL").groupBy(F.col("parent").alias("above")).agg(F.count("*").alias("n"), F.sum(F.when(alone, F.col("leaves"))).alias("l"), F.sum(F.when(alone, F.col("saved"))).alias("s"))
    parted = one.where("shards > 1").join(hung, F.col("key") == F.col("above"), "left")
    children = F.col("own_children") + F.coalesce("n", F.lit(0))
    leaves = F.col("own_leaves") + F.coalesce("l", F.lit(0)) + F.when(children == 0, 1).otherwise(0)
    saved = F.col("own_saved") + F.coalesce("s", F.lit(0)) + (F.col("n_convs") - 1) * F.col("size")
    spine = scratch.save(parted.select("key", F.col("parent").alias("up"), children.alias("children"), leaves.alias("leaves"), saved.alias("saved")))
    # A node knows the sums of its subtree down to some depth; those of its descendants just below double it.
    while not (below := spine.where("up IS NOT NULL").groupBy(F.col("up").alias("at")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))).isEmpty():
        further = spine.select(F.col("key").alias("k"), F.col("up").alias("further"))
        grown = spine.join(below, F.col("key") == F.col("at"), "left").join(further, F.col("up") == F.col("k"), "left")
        spine = scratch.save(grown.select("key", F.col("further").alias("up"), "children", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")))
    lists = edges.where("n_ends > 0").select("key", "first_end", "ends").repartition("key").sortWithinPartitions("key", "first_end").select("key", "ends")
    digests = lists.mapInArrow(_end_digests, "key binary, ends_sha256 string")
    totals = one.where(alone).select("key", *SUMS).unionByName(spine.select("key", *SUMS))
    joined = one.drop(*SUMS).join(totals, "key").join(digests, "key", "left")
    return scratch.save(joined.select("key", "parent", "depth", "conv_id", "n_convs", *SUMS, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))


def prefix_trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """conversations(conv_id, turns array<struct<digest: binary, size>>) -> a row for each distinct sequence of first turns.

    conv_id (smallest member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves (childless nodes of the
    subtree), saved_tokens (sum over the subtree of (n_convs - 1) * size of the last turn), ends_sha256 (members that end
    here, ascending, joined by commas). conv_id is unique and not null; turns may be empty, not null. Copies of one
    conversation, however many, are dealt to several shards. A task holds the digests of a conversation's turns, never
    its texts. An empty table gives no nodes.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    rows = conversations.select("conv_id", F.transform("turns", lambda t: t["digest"]).alias("turns"), F.transform("turns", lambda t: t["size"].cast("long")).alias("sizes"))
    order = [F.slice("turns", 1, DEALT), F.col("conv_id")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    nodes = scratch.save(dealt.mapInArrow(partial(_shards, most=shard), from_arrow_schema(NODE)))
    shared = _shared(nodes.where("edge"), scratch)
    ids = small(shared.select(F.col("key").alias("above"), F.col("conv_id").alias("above_id")))
    told = ["conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256"]
    own = nodes.where("NOT edge")
    inner = own.where("parent_conv_id IS NOT NULL").select(*told)
    outer = own.where("parent_conv_id IS NULL").drop("parent_conv_id").join(ids, F.col("parent") == F.col("above")).withColumnRenamed("above_id", "parent_conv_id").select(*told)
    top = shared.join(ids, F.col("parent") == F.col("above"), "left").withColumnRenamed("above_id", "parent_conv_id").select(*told)
    return inner.unionByName(outer).unionByName(top)


def conversation_turns(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) -> conv_id, turns: digest of role and text, and the text's code points, in order.

    Rows go by turn (nulls first), ties by role, then by digest. Null roles and texts are empty. Rows with a null
    conv_id are no conversation, as no id could tell their nodes.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256), 1, 32))
    told = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.length(text).cast("long").alias("size")).alias("t"))
    turns = told.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def rebuilt(turns: DataFrame, group: int = 100, longest: int = 6) -> DataFrame:
    """Conversations whose first turns (as many as the id's checksum says) are those of their group's first conversation."""
    conv = F.col("conv_id")
    heads = turns.where(conv % group == 0).select(conv.alias("head_id"), F.slice("turns", 1, longest - 1).alias("head"))
    h = (F.crc32(conv.cast("string")) % longest).cast("int")
    own = F.when(F.size("turns") > h, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).otherwise(F.slice("turns", 1, 0))
    lead = F.coalesce(F.slice("head", F.lit(1), h), F.slice("turns", 1, 0))
    return turns.join(heads, conv - conv % group == F.col("head_id"), "left").select("conv_id", F.concat(lead, own).alias("turns"))


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefix_trie(rebuilt(conversation_turns(rows)))


ORACLE = r"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
given AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), left(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32)) AS k,
    length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said, length(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT DISTINCT c, xor(list_reduce(list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h FROM given, crc),
turns AS (
  SELECT ids.c, k, said, size FROM ids JOIN given ON given.c = ids.c - ids.c % 100 AND k <= h
  UNION ALL SELECT c, k + 1000000, said, size FROM ids JOIN given USING (c) WHERE k > h),
paths AS (SELECT c, row_number() OVER w AS depth, size, string_agg(sha256(said), '') OVER w AS path FROM turns WINDOW w AS (PARTITION BY c ORDER BY k)),
members AS (SELECT c, 0 AS depth, 0 AS size, '' AS path FROM ids UNION ALL FROM paths),
last AS (SELECT c, max(depth) AS d FROM members GROUP BY c),
nodes AS (
  SELECT path, depth, min(c) AS conv_id, count(*) AS n, any_value(size) AS size, CASE WHEN depth > 0 THEN left(path, length(path) - 64) END AS up,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = depth), '')) AS ends_sha256
  FROM members JOIN last USING (c) GROUP BY path, depth),
kids AS (SELECT up, count(*) AS n_children FROM nodes GROUP BY up),
below AS (
  SELECT m.path, count(*) FILTER (kids.up IS NULL) AS n_leaves, sum((v.n - 1) * v.size)::BIGINT AS saved_tokens
  FROM nodes v LEFT JOIN kids ON kids.up = v.path JOIN members m ON m.c = v.conv_id AND m.depth <= v.depth GROUP BY m.path)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, v.ends_sha256
FROM nodes v JOIN below USING (path) LEFT JOIN kids ON kids.up = v.path LEFT JOIN nodes p ON p.path = v.up
"""
