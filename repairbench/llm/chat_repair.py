"""Repair of conversations by weighted CYK interval parsing.

The role initials of a sound conversation are `(s?(ua)+)?`. Its grammar in Chomsky normal form has a symbol for every
pair of states of that pattern: N(p, q) -> N(p, r) N(r, q), terminals for the edits of one row, and N(p, q) for the
rows that may be inserted where there are none (the insertion closure, put around every row). A cell holds for each
symbol the least (cost, audit) of its span. Spans combine bottom-up by length, from single rows to whole
conversations; as the rule is associative, neighbours of equal length are enough, and a conversation may lie in
several blocks, in several tasks, whose cells combine by the same rule.
"""

from __future__ import annotations

import hashlib
from functools import cache, partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import Scratch, small, tidied

#: Rows and characters of a block of one conversation.
BLOCK_ROWS, BLOCK_CHARS = 1024, 1 << 22

START, SYSTEM, USER, WHOLE = range(4)  # nothing read, after s, after a u that waits, after a pair
READS = {(START, SYSTEM): "s", (START, USER): "u", (SYSTEM, USER): "u", (USER, WHOLE): "a", (WHOLE, USER): "u"}
NAMES = {"u": "user", "a": "assistant"}
SYMBOLS = [(p, q) for p in range(4) for q in range(4) if p == q or (p, q) in READS or (p, q) in ((START, WHOLE), (SYSTEM, WHOLE))]
RULES = {(p, q): [r for r in range(4) if (p, r) in SYMBOLS and (r, q) in SYMBOLS] for p, q in SYMBOLS}
#: What a row is, as the repair sees it.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)


def joined(left: dict, right: dict) -> tuple[dict, dict]:
    """The cell of two neighbouring spans, and the middle state of each symbol."""
    cell, middle = {}, {}
    for symbol, states in RULES.items():
        p, q = symbol
        best = None
        for r in states:
            a, b = left.get((p, r)), right.get((r, q))
            if a and b:
                found = (a[0] + b[0], a[1] + b[1])
                if best is None or found < best:
                    best, middle[symbol] = found, r
        if best:
            cell[symbol] = best
    return cell, middle


@cache
def inserted() -> dict:
    """The cell of no rows: what insertions alone can read."""
    cell = {s: (0, "") for s in SYMBOLS if s[0] == s[1]} | {s: (5, "I") for s, x in READS.items() if x in NAMES}
    while (more := joined(cell, cell)[0]) != cell:
        cell = more
    return cell


@cache
def row_cell(initial: str, fault: int) -> dict:
    """The cell of one row, with what may be inserted on its sides."""
    cell = {(p, p): (2, "D") for p in range(4)}
    if fault in (SOUND, TRUNCATED):
        more = 5 * (fault == TRUNCATED)
        for s, x in READS.items():
            if x == initial:
                cell[s] = (more, "K")
            elif x in NAMES:
                cell[s] = (more + 1, "R")
    return joined(joined(inserted(), cell)[0], inserted())[0]


def parse(cells: list[dict]) -> list[list]:
    """Levels of spans, from the given ones to the whole: pairs (cell, middle states); an odd one moves up as it is."""
    levels = [[(c, None) for c in cells]]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([joined(below[i][0], below[i + 1][0]) if i + 1 < len(below) else (below[i][0], None) for i in range(0, len(below), 2)])
    return levels


def best(cell: dict) -> tuple[tuple[int, str], tuple[int, int]]:
    """(cost, audit) of a whole conversation, and its symbol."""
    return min((cell[s], s) for s in ((START, START), (START, WHOLE)) if s in cell)


def pieces(levels: list[list], symbol: tuple[int, int]) -> list[tuple[int, str]]:
    """For each span of the lowest level the state before it and its part of the audit."""
    symbols = [symbol]
    for level, below in zip(levels[:0:-1], levels[-2::-1], strict=True):
        down = []
        for (_, middle), (p, q) in zip(level, symbols, strict=True):
            down += [(p, q)] if middle is None else [(p, middle[p, q]), (middle[p, q], q)]
        symbols = down[: len(below)]
    return [(s[0], cell[s][1]) for (cell, _), s in zip(levels[0], symbols, strict=True)]


def repaired(state: int, audit: str, roles: list[str], texts: list[str]) -> list[str]:
    """The lines `role:text` that an audit leaves of rows, read from a state on."""
    lines, i = [], 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        after = {x: q for (p, q), x in READS.items() if p == state}
        x = roles[i][:1] if edit == "K" else next(c for c in after if c in NAMES)
        lines.append(f"{roles[i] if edit == 'K' else NAMES[x]}:{'' if edit == 'I' else texts[i]}")
        state, i = after[x], i + (edit != "I")
    return lines


_SEP = "\n"
_LONG, _TEXT = pa.int64(), pa.string()
COUNTS = ["blank", "duplicate", "truncated", "illegal"]
BLOCK = pa.schema(
    [(n, _LONG) for n in ("conv_id", "block", "first_turn", "last_turn", "turns", *COUNTS)] + [("head", _TEXT), ("tail", _TEXT)]
    + [("cell", pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", _LONG), ("audit", _TEXT)])))]
    + [("cost", _LONG), ("audit", _TEXT), ("sha", _TEXT), ("roles", pa.list_(_TEXT)), ("texts", pa.list_(_TEXT))]
)
PIECE = pa.schema([("conv_id", _LONG), ("block", _LONG), ("state", pa.int32()), ("piece", _TEXT), ("whole", pa.struct([(n, _LONG) for n in ("gaps", *COUNTS, "cost")]))])
DIGEST = pa.schema([("conv_id", _LONG), ("audit", _TEXT), ("repaired_sha256", _TEXT)])


def _block(conv, number: int, rows: list) -> tuple:
    """A block of consecutive rows (turn, role, text, fault) of a conversation, parsed as if it were the whole."""
    turns = [r[0] for r in rows if r[0] is not None]
    roles, texts, faults = [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows]
    initials = [r[:1] for r in roles]
    levels = parse([row_cell(x, f) for x, f in zip(initials, faults, strict=True)])
    cell = levels[-1][0][0]
    (cost, audit), symbol = best(cell)
    sha = hashlib.sha256(_SEP.join(repaired(symbol[0], audit, roles, texts)).encode()).hexdigest()
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    told = [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in cell.items()]
    counts = [faults.count(k) for k in (BLANK, DUPLICATE, TRUNCATED)]
    return (conv, number, min(turns, default=None), max(turns, default=None), len(set(turns)), *counts, illegal, initials[0], initials[-1], told, cost, audit, sha, roles, texts)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


@tidied
def _blocks(batches, most: int):
    """Sorted rows to blocks; a conversation begins a new block at each task's start and at the limits."""
    number = TaskContext.get().partitionId() << 32
    rows, conv, chars, out, held = [], None, 0, [], 0
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for c, *row in zip(*columns, strict=True):
            if rows and (c != conv or len(rows) >= most or chars >= BLOCK_CHARS):
                out.append(_block(conv, number, rows))
                number, held = number + 1, held + chars
                rows, chars = [], 0
            conv, chars = c, chars + len(row[2])
            rows.append(row)
            if held >= BLOCK_CHARS:
                yield _batch(BLOCK, out)
                out, held = [], 0
    if rows:
        out.append(_block(conv, number, rows))
    if out:
        yield _batch(BLOCK, out)


def _whole(blocks: list[tuple]) -> list[tuple]:
    """The blocks of one conversation (without texts), parsed together: the state and audit of each, and the counts of all on the first."""
    levels = parse([{(x["p"], x["q"]): (x["cost"], x["audit"]) for x in b[11]} for b in blocks])
    (cost, _), symbol = best(levels[-1][0][0])
    span = [b for b in blocks if b[2] is not None]
    # A turn's rows may lie on both sides of a border.
    distinct = sum(b[4] for b in span) - sum(a[3] == b[2] for a, b in zip(span, span[1:], strict=False))
    gaps = span[-1][3] - span[0][2] + 1 - distinct if span else 0
    illegal = sum(b[8] for b in blocks) + sum(a[10] + b[9] not in ("su", "ua", "au") for a, b in zip(blocks, blocks[1:], strict=False))
    counts = {"gaps": gaps, **{n: sum(b[5 + k] for b in blocks) for k, n in enumerate(COUNTS[:3])}, "illegal": illegal, "cost": cost}
    return [(b[0], b[1], state, piece, counts if k == 0 else None) for k, (b, (state, piece)) in enumerate(zip(blocks, pieces(levels, symbol), strict=True))]


def _wholes(batches):
    """Sorted blocks to pieces, a conversation at a time."""
    held: list = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and row[0] != held[0][0]:
                yield _batch(PIECE, _whole(held))
                held = []
            held.append(row)
    if held:
        yield _batch(PIECE, _whole(held))


def _digests(batches):
    """Sorted blocks with their pieces to conversations; texts go through a running hash, block by block."""
    conv, sha, audit, some = None, None, [], False
    for batch in batches:
        for c, state, piece, roles, texts in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            if sha and c != conv:
                yield _batch(DIGEST, [(conv, "".join(audit), sha.hexdigest())])
                sha = None
            if not sha:
                conv, sha, audit, some = c, hashlib.sha256(), [], False
            lines = repaired(state, piece, roles, texts)
            if lines:
                sha.update((_SEP * some + _SEP.join(lines)).encode())
                some = True
            audit.append(piece)
    if sha:
        yield _batch(DIGEST, [(conv, "".join(audit), sha.hexdigest())])


def _faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault, digest, copy: each row with its first fault; equal rows are counted before they shuffle."""
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    distinct = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("digest", F.sha2("text", 256))
    seen = distinct.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("k")).where("k > 1")
    told = distinct.join(seen.drop("k"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    told = told.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    again = (F.col("copy") > 1) | F.coalesce(F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn")), F.lit(False))
    end = F.rtrim("text", F.lit(" \t\n\x0b\f\r"))
    fault = F.when(end == "", BLANK).when(again, DUPLICATE).when(~F.substring(end, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    return told.select("conv_id", "turn", "role", "text", fault.cast("int").alias("fault"), "digest", "copy")


def repair_chats(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows(conv_id, turn, role, text) -> a row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows go by turn (nulls first), ties by role, then by the digest of the text. Null roles and texts are one space; all
    rows with a null conv_id are one conversation. A row's first fault counts: blank, duplicate (its role and text were
    seen), truncated (its last character other than white space is none of ``.!?``). Edits: Keep 0, Rerole 1, Delete 2
    (blank and duplicate rows are always deleted), Insert 5, and 5 for a truncated row that stays. The audit is the
    initials of the cheapest edits, of equally cheap ones the least in ASCII. Texts may have any length, other columns
    and their names don't matter, an empty table gives none. A conversation of any length is parsed in blocks; its audit
    has to fit a string.
    """
    scratch = Scratch(rows.sparkSession, "repair")
    order = ["conv_id", "turn", "role", "digest", "copy"]
    placed = _faults(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = scratch.save(placed.select("conv_id", "turn", "role", "text", "fault").mapInArrow(partial(_blocks, most=block_rows), from_arrow_schema(BLOCK)))
    parted = scratch.save(blocks.groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("k")).where("k > 1").drop("k"))
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    alone = blocks.join(small(parted), same, "left_anti")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    counts = [*COUNTS, "cost"]
    out = alone.select("conv_id", gaps.alias("gaps"), *counts, "audit", F.col("sha").alias("repaired_sha256"))
    if parted.isEmpty():
        return out
    several = blocks.join(small(parted), same, "left_semi")
    ordered = several.drop("audit", "sha", "roles", "texts").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    told = scratch.save(ordered.mapInArrow(_wholes, from_arrow_schema(PIECE)))
    own = told.select(F.col("block").alias("b"), "state", "piece")
    read = several.select("conv_id", "block", "roles", "texts").join(own, F.col("block") == F.col("b"))
    read = read.repartition("conv_id").sortWithinPartitions("conv_id", "block").select("conv_id", "state", "piece", "roles", "texts")
    digests = read.mapInArrow(_digests, from_arrow_schema(DIGEST))
    whole = told.where("whole IS NOT NULL").select(F.col("conv_id").alias("c"), "whole.*")
    return out.unionByName(digests.join(whole, same).select("conv_id", "gaps", *counts, "audit", "repaired_sha256"))


def damage(rows: DataFrame) -> DataFrame:
    """Rows of conversations, damaged by the checksum of `conv_id:turn`; nulls are one space there and in role and text."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    hit = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return hit.withColumn("time", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select("conv_id", "turn", role.alias("role"), text.alias("text"))


def op12_chat_repair(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    done = repair_chats(damage(rows)).withColumnRenamed("conv_id", "c")
    whole = rows.select("conv_id").distinct().join(done, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    zero = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


# Independent of the parser: an automaton reads row by row, with the least (cost, audit) of each state.
ORACLE = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM keyed, range(2) r(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS k, left(role, 1) AS x,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged),
told AS (
  SELECT *, CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'n' END AS fault,
    lead(x) OVER (PARTITION BY conv_id ORDER BY k) AS y FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (y IS NOT NULL AND x || y NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY conv_id),
ins(p, q, cost, audit, t) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
  (0, 2, 5, 'I', E'\nuser:'), (1, 2, 5, 'I', E'\nuser:'), (3, 2, 5, 'I', E'\nuser:'), (2, 3, 5, 'I', E'\nassistant:'),
  (0, 3, 10, 'II', E'\nuser:\nassistant:'), (1, 3, 10, 'II', E'\nuser:\nassistant:')),
moves(p, q, x, name) AS (VALUES (0, 1, 's', NULL), (0, 2, 'u', 'user'), (1, 2, 'u', 'user'), (2, 3, 'a', 'assistant'), (3, 2, 'u', 'user')),
edits AS (
  SELECT conv_id, k, p, q, CASE WHEN told.x = moves.x THEN 0 ELSE 1 END + CASE WHEN fault = 't' THEN 5 ELSE 0 END AS cost, CASE WHEN told.x = moves.x THEN 'K' ELSE 'R' END AS audit,
    E'\n' || CASE WHEN told.x = moves.x THEN role ELSE name END || ':' || text AS t
  FROM told, moves WHERE fault IN ('n', 't') AND (told.x = moves.x OR name IS NOT NULL)
  UNION ALL SELECT conv_id, k, p, p, 2, 'D', '' FROM told, range(4) s(p)),
state AS (
  SELECT conv_id, 0::BIGINT AS k, q::INT AS q, {'cost': cost::BIGINT, 'audit': audit, 't': t} AS s FROM counts, ins WHERE p = 0
  UNION ALL
  SELECT z.conv_id, z.k + 1, i.q::INT, min({'cost': (z.s.cost + e.cost + i.cost)::BIGINT, 'audit': z.s.audit || e.audit || i.audit, 't': z.s.t || e.t || i.t})
  FROM state z JOIN edits e ON z.conv_id IS NOT DISTINCT FROM e.conv_id AND e.k = z.k + 1 AND e.p = z.q JOIN ins i ON i.p = e.q GROUP BY ALL),
ends AS (
  SELECT conv_id, min(s) AS s FROM state SEMI JOIN (SELECT conv_id AS c, max(k) AS k FROM told GROUP BY 1) l ON state.conv_id IS NOT DISTINCT FROM l.c AND state.k = l.k WHERE q IN (0, 3) GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(s.cost, 0) AS cost, coalesce(s.audit, '') AS audit, sha256(coalesce(substr(s.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts ON a.conv_id IS NOT DISTINCT FROM counts.conv_id LEFT JOIN ends ON a.conv_id IS NOT DISTINCT FROM ends.conv_id
"""
