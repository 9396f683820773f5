"""Chat formatting of reply trees with DataFrame functions only.

Messages point to their parents. Pointer doubling by self-joins (each round joins the reached ancestors with
their own ancestors) gives every leaf its whole path to the root in log2(depth) joins over ids; texts join last.
Branches rank by the sum of their messages' scores, then by their leaf; each chosen path is one conversation.

A turn is written ``<turn>ROLE<says>TEXT</turn>``. In roles and texts a backslash is doubled, and a backslash goes
between ``<`` and what would make a control string of it; dropping each first backslash restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

BEGIN, SAYS, END = "<turn>", "<says>", "</turn>"


def escape(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for control in (BEGIN, SAYS, END):
        text = F.replace(text, F.lit(control), F.lit("<\\" + control[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _on_tree(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Joins by tree and `key`; a null tree equals itself. Of both sides' keys the left ones stay."""
    right = right.withColumnsRenamed({"tree": "_tree", key: "_key"})
    joined = left.join(right, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col(key) == F.col("_key")), how)
    return joined.drop("_tree", "_key")


def reply_paths(messages: DataFrame, scratch: Scratch, branches: int | None) -> DataFrame:
    """messages(tree, node, parent, score) -> tree, leaf, node, depth: the best `branches` paths of each tree (None: all)."""
    links = scratch.save(messages.select("tree", "node", "parent", "score"))
    jump = links.where("parent IS NOT NULL").select("tree", "node", F.col("parent").alias("up"))
    reach = _on_tree(links, links.where("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct(), "node", "left_anti")
    reach = scratch.save(reach.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("up_steps")))
    jump, step = scratch.save(jump), 1
    while not jump.isEmpty():
        if step >= 64 and step > links.groupBy("tree").count().agg(F.max("count")).first()[0]:
            # Longer than any tree has nodes: what still goes up runs in a circle.
            reach = _on_tree(reach, jump.select("tree", F.col("node").alias("leaf")).distinct(), "leaf", "left_anti")
            break
        # A leaf knows its last `step` ancestors; those of each, `step` further up, are the next ones.
        ahead = jump.select("tree", "node", "up")
        more = _on_tree(reach, ahead, "node").select("tree", "leaf", F.col("up").alias("node"), (F.col("up_steps") + step).alias("up_steps"))
        reach = scratch.save(reach.unionByName(more))
        twice = ahead.alias("a").join(ahead.alias("b"), F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.up") == F.col("b.node")))
        jump = scratch.save(twice.select("a.tree", "a.node", "b.up"))
        step *= 2
    if branches is not None:
        scored = _on_tree(reach, links.select("tree", "node", "score"), "node").groupBy("tree", "leaf").agg(F.sum("score").alias("score"))
        place = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc_nulls_last("score"), "leaf"))
        chosen = scored.withColumn("place", place).where(F.col("place") <= branches).select("tree", "leaf")
        reach = _on_tree(reach, chosen, "leaf")
    depth = F.max("up_steps").over(Window.partitionBy("tree", "leaf")) - F.col("up_steps")
    return reach.select("tree", "leaf", "node", depth.alias("depth"))


def format_chats(messages: DataFrame, branches: int | None = 1, loss_role: str = "assistant") -> DataFrame:
    """messages(tree, node, parent, role, text, score) -> tree, leaf, formatted, loss(start, length).

    `loss` holds code point ranges of `formatted` to train on, the escaped texts of `loss_role`, in order.
    Null roles and texts are empty. A node id is unique in its tree; a parent that is null or not in the tree
    makes a root. Messages whose parents run in a circle are on no path. Repeated rows are repeated turns. Ties of score go to the smaller leaf, null scores come last.
    Messages without a tree (null) are one tree of their own. Texts may have any length, an empty table gives none.
    """
    scratch = Scratch(messages.sparkSession, "chats")
    own = messages.select("tree", "node", "parent", "role", "text", F.col("score").cast("double").alias("score"))
    known = own.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    rooted = _on_tree(own, known, "parent", "left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("parent"), "score")
    paths = reply_paths(rooted, scratch, branches)
    return _written(_on_tree(paths, own.select("tree", "node", "role", "text"), "node"), loss_role)


def _written(turns: DataFrame, loss_role: str) -> DataFrame:
    """turns(tree, leaf, depth, role, text) -> one row for each path."""
    head = F.concat(F.lit(BEGIN), escape(F.col("role")), F.lit(SAYS))
    parts = turns.select("tree", "leaf", "depth", (F.col("role") == loss_role).alias("trained"), head.alias("head"), escape(F.col("text")).alias("body"))
    sizes = parts.withColumn("n", F.length("head") + F.length("body") + len(END))
    before = F.sum("n").over(Window.partitionBy("tree", "leaf").orderBy("depth")) - F.col("n")
    placed = sizes.select("tree", "leaf", "depth", F.concat("head", "body", F.lit(END)).alias("turn"), F.when(F.col("trained"), F.struct((before + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"))).alias("loss"))
    rows = placed.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct("depth", "turn", "loss"))).alias("t"))
    loss = F.filter(F.transform("t", lambda x: x["loss"]), lambda x: x.isNotNull())
    return rows.select("tree", "leaf", F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"), loss.alias("loss"))


def read_chats(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, as an array."""
    turns = F.split(formatted, END)
    pieces = F.transform(F.slice(turns, 1, F.size(turns) - 1), lambda t: F.split(F.substring(t, len(BEGIN) + 1, 1 << 30), SAYS, 2))
    return F.transform(pieces, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def conversation_messages(rows: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as reply chains: each row answers the one before it.

    Rows go by turn (nulls first), then role and text, so ties and repeated rows have their place too. All rows
    with a null conv_id are one conversation, that of conv_id null.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    chained = rows.select("conv_id", "turn", "role", "text").withColumn("node", node)
    return chained.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


SAMPLE = r"\### Assistant: </turn> ok"


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SAMPLE).alias("text"))
    chats = format_chats(conversation_messages(rows.unionByName(extra)))
    turns = read_chats(F.col("formatted"))
    back = chats.select("tree", "formatted", turns.alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("learned"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = rf"""
WITH all_rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{SAMPLE}' UNION ALL SELECT -7, 1, 'assistant', '{SAMPLE}'),
sized AS (
  SELECT *, length(role) + length(text) + length('{BEGIN}{SAYS}{END}')
    + length(text) - length(replace(text, chr(92), '')) + length(role) - length(replace(role, chr(92), ''))
    + (length(text) - length(replace(replace(replace(text, '{BEGIN}', '{BEGIN[:-1]}'), '{SAYS}', '{SAYS[:-1]}'), '{END}', '{END[:-1]}'))) AS n
  FROM all_rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
