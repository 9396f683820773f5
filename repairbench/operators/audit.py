"""Hash-chained audit events of a claim."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repairbench.operators.carried import State, carried


class _Seal(State):
    """The hash of a claim's last event."""

    def __init__(self, key: tuple):
        super().__init__(key)
        self.last = None

    def step(self, row: tuple):
        created, event, payload, text = row
        before, self.last = self.last, hashlib.sha256(f"{text}|{self.last or ''}".encode()).hexdigest()
        return [(self.key[0], event, created, payload, before, self.last)]


def seal_audit(events: DataFrame) -> DataFrame:
    """events(case_id, event_id, created_at, payload) with previous_hash and event_hash.

    The hash is sha256 of ``case|event|payload|previous``, nulls left out as in `verify_audit`. A chain follows created_at, then
    event_id; a task carries a claim's last hash, never its events.
    """
    text = F.concat_ws("|", F.col("case_id").cast("string"), F.col("event_id").cast("string"), "payload")
    rows = events.select("case_id", "created_at", "event_id", F.col("payload").cast("string").alias("payload"), text.alias("text"))
    kind = dict(rows.dtypes)
    return carried(rows, ["case_id"], ["created_at", "event_id"], f"case_id {kind['case_id']}, event_id {kind['event_id']}, created_at {kind['created_at']}, payload string, previous_hash string, event_hash string", _Seal)


def verify_audit(sealed: DataFrame) -> DataFrame:
    """sealed events with `valid`: the hash is that of its content, and the previous one is that of the event before."""
    before = F.lag("event_hash").over(Window.partitionBy("case_id").orderBy("created_at", "event_id"))
    text = F.concat_ws("|", F.col("case_id").cast("string"), F.col("event_id").cast("string"), "payload", F.coalesce("previous_hash", F.lit("")))
    return sealed.withColumn("valid", F.col("previous_hash").eqNullSafe(before) & (F.col("event_hash") == F.sha2(text, 256)))
