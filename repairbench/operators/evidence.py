"""Evidence of a comparison and of research: comparables, known identities, allowed hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repairbench.functions.rules import Policy
from repairbench.operators.history import derived, exclusion_reason, recency_weight


def comparables(pairs: DataFrame, policy: Policy = Policy(), stale_days: int = 1095, any_invoice: bool = False) -> DataFrame:
    """line_id, obs_id, original, normalised (pence), weight, stale: the observations that a line's history rests on.

    pairs as `past_history` gives them, with the columns that `historical_statistics` takes. original is the total as it was
    given, normalised the one that counts (unit price times quantity where none was given). any_invoice: see `exclusion_reason`.
    """
    good = derived(pairs).where(exclusion_reason(any_invoice).isNull() & (F.col("observed_at") < F.col("as_of")))
    weight = (recency_weight(F.col("observed_at"), F.col("as_of"), policy) * F.least("comparability", F.lit(1)).cast("decimal(10,6)")).cast("decimal(28,18)")
    stale = F.datediff("as_of", "observed_at") > stale_days
    return good.select("line_id", "obs_id", F.col("total").alias("original"), F.col("used_total").alias("normalised"), weight.alias("weight"), stale.alias("stale"))


def reject_known(new: DataFrame, items: DataFrame, open_items: DataFrame, hashes: DataFrame) -> DataFrame:
    """new(identity, content_hash, ...) with `rejected`: why a suggestion is none, or null.

    An identity that an approved item or an open suggestion has, or content that an open or approved task holds.
    items(identity, status), open_items(identity), hashes(content_hash).
    """
    approved = items.where("status = 'approved'").select("identity").distinct().withColumn("in_items", F.lit(True))
    waiting = open_items.select("identity").distinct().withColumn("in_open", F.lit(True))
    held = hashes.select("content_hash").distinct().withColumn("in_hashes", F.lit(True))
    rows = new.join(approved, "identity", "left").join(waiting, "identity", "left").join(held, "content_hash", "left")
    why = F.when(F.col("in_items"), "ONTOLOGY_ITEM_ALREADY_APPROVED").when(F.col("in_open"), "RESEARCH_IDENTITY_ALREADY_OPEN").when(F.col("in_hashes"), "EVIDENCE_CONTENT_ALREADY_RESEARCHED")
    return rows.select(*new.columns, why.alias("rejected"))


def host_allowed(rows: DataFrame, patterns: DataFrame, host_col: str = "host") -> DataFrame:
    """rows with `allowed`: whether the host is a pattern, or ends with the domain of a pattern that begins with ``*.``.

    patterns(pattern). Hosts meet patterns by equality of their domain suffixes, not pair by pair.
    """
    host = F.lower(F.rtrim(F.trim(host_col), F.lit(".")))
    known = patterns.select(F.lower(F.rtrim(F.trim("pattern"), F.lit("."))).alias("pattern"))
    known = known.select(F.regexp_replace("pattern", r"^\*\.", "").alias("domain"), F.startswith("pattern", F.lit("*.")).alias("below")).where("domain <> '' AND domain <> '*'").distinct()
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = rows.select(F.col(host_col).alias("given"), host.alias("host")).where("host <> ''").distinct()
    suffixes = hosts.select("given", "host", F.explode(tails).alias("domain"))
    good = suffixes.join(known, "domain").where("below OR domain = host").select(F.col("given").alias(host_col)).distinct().withColumn("allowed", F.lit(True))
    return rows.join(good, host_col, "left").select(*rows.columns, F.coalesce("allowed", F.lit(False)).alias("allowed"))
