"""Human decisions on mappings and challenges, and what they change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repairbench.functions.exact import half_up
from repairbench.functions.rules import percent_of, type_compatible
from repairbench.functions.text import normalise_description


def apply_overrides(mappings: DataFrame, overrides: DataFrame, items: DataFrame) -> DataFrame:
    """mappings(line_id, line_kind, item_id, confidence, decision) with valid overrides(line_id, item_id) put first.

    An override counts if its item is known and of a compatible type; it has confidence 1 and is approved.
    """
    known = overrides.select("line_id", F.col("item_id").alias("wanted")).join(items.select(F.col("item_id").alias("wanted"), "item_type"), "wanted")
    rows = mappings.join(known, "line_id", "left")
    manual = F.coalesce(F.col("wanted").isNotNull() & type_compatible(F.col("line_kind"), F.col("item_type")), F.lit(False))
    pick = lambda new, old: F.when(manual, new).otherwise(F.col(old)).alias(old)
    status = F.when(manual | (F.col("confidence") > 0.95), "approved").when(F.col("item_id").isNull(), "no_match").otherwise("pending")
    return rows.select("line_id", pick(F.col("wanted"), "item_id"), pick(F.lit(1.0), "confidence"), pick(F.lit("manual"), "decision"), status.alias("status"))


def apply_decisions(challenges: DataFrame) -> DataFrame:
    """challenges with the handler's decision applied, and `error` where it isn't allowed.

    challenges(line_id, billed, net, vat_rate, vatable, approved, edited, comparables, item_approved): pence. An
    edited price lies above zero and below the line; approval needs three comparables or an approved item.
    """
    bad_edit = F.col("edited").isNotNull() & ~F.col("approved")
    bad_price = F.col("edited").isNotNull() & ((F.col("edited") <= 0) | (F.col("edited") >= F.col("billed")))
    net = F.coalesce(F.col("billed") - F.col("edited"), F.col("net"))
    thin = F.col("approved") & (net > 0) & (F.coalesce("comparables", F.lit(0)) < 3) & ~F.coalesce("item_approved", F.lit(False))
    error = F.when(bad_edit, "INVALID_CHALLENGE_EDIT").when(bad_price, "INVALID_CHALLENGE_PRICE").when(thin, "PROVISIONAL_EVIDENCE")
    rows = challenges.withColumn("error", error).withColumn("net", F.when(F.col("error").isNull(), net).otherwise(F.col("net")))
    vat = F.when(F.col("vatable"), half_up(F.col("net") * F.col("vat_rate"), F.lit(100))).otherwise(F.lit(0))
    status = F.when(F.col("error").isNotNull(), "pending").when(F.col("approved"), "approved").otherwise("rejected")
    return rows.withColumn("vat", vat).withColumn("percent", percent_of(F.col("net"), F.col("billed"))).withColumn("status", status)


def financial_summary(lines: DataFrame, key: str, invoices: DataFrame | None = None) -> DataFrame:
    """Totals of approved lines: lines(key, billed, price, vat_rate, mot, approved), in pence; MOT carries no VAT.

    With invoices(key, vat, gross) also original_vat, original_gross (what was billed and its VAT, where no gross is told) and
    proposed_gross, what is left of it.
    """
    gap = F.greatest(F.col("billed") - F.col("price"), F.lit(0))
    rows = lines.where("approved").withColumn("gap", gap).withColumn("vat", F.when(F.col("mot"), F.lit(0)).otherwise(half_up(gap * F.col("vat_rate"), F.lit(100))))
    out = rows.groupBy(key).agg(F.sum("billed").alias("billed"), F.sum("gap").alias("challenge_net"), F.sum("vat").alias("vat"), F.sum(F.when(F.col("mot"), F.col("billed")).otherwise(0)).alias("mot_total"), F.sum((F.col("gap") > 0).cast("int")).alias("challenged"))
    out = out.withColumn("percent", percent_of(F.col("challenge_net"), F.col("billed"))).withColumn("challenge_gross", F.col("challenge_net") + F.col("vat"))
    if invoices is None:
        return out
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    told = invoices.groupBy(key).agg(zero(F.sum("vat")).alias("original_vat"), zero(F.sum("gross")).alias("_gross"))
    out = out.join(told, key, "left").withColumn("original_vat", zero("original_vat"))
    out = out.withColumn("original_gross", F.when(zero("_gross") == 0, F.col("billed") + F.col("original_vat")).otherwise(F.col("_gross"))).drop("_gross")
    return out.withColumn("proposed_gross", F.greatest(F.col("original_gross") - F.col("challenge_gross"), F.lit(0)))


def workspace_status(lines: DataFrame) -> DataFrame:
    """mapping_status and comparison_status of lines(line_id, excluded, item_id, mapping_approved, benchmark, billed, gate_passed)."""
    mapping = F.when(F.col("excluded"), "excluded").when(F.col("item_id").isNull(), "no_match").when(F.col("mapping_approved"), "match").otherwise("provisional")
    comparison = F.when(F.col("excluded"), "excluded").when(F.col("benchmark").isNull(), "missing").when(F.col("gate_passed"), "challenge").when(F.col("billed") > F.col("benchmark"), "below_gate").otherwise("within")
    return lines.select("line_id", mapping.alias("mapping_status"), comparison.alias("comparison_status"))


def learn_synonyms(reviews: DataFrame, items: DataFrame, synonyms: DataFrame) -> DataFrame:
    """item_id, normalised, action: approved descriptions that become synonyms (learned), or that approve one (promoted), one item each.

    reviews(item_id, description, approved), items(item_id, name), synonyms(item_id, synonym, approved). Left out: those that equal
    an item's name, those that another item has as a synonym, and approved synonyms of the item itself.
    """
    wanted = reviews.where("approved").select("item_id", normalise_description(F.col("description")).alias("normalised")).where("normalised <> ''")
    names = items.select(normalise_description(F.col("name")).alias("normalised")).distinct()
    held = synonyms.select(F.col("item_id").alias("owner"), normalise_description(F.col("synonym")).alias("normalised"), F.coalesce("approved", F.lit(False)).alias("known"))
    held = held.groupBy("normalised").agg(F.min_by("owner", F.struct(~F.col("known"), "owner")).alias("owner"), F.max("known").alias("known"))
    rows = wanted.groupBy("item_id", "normalised").agg(F.count("*").alias("n")).join(names, "normalised", "left_anti").join(held, "normalised", "left")
    rows = rows.where("owner IS NULL OR (owner = item_id AND NOT known)")
    first = F.row_number().over(Window.partitionBy("normalised").orderBy(F.desc("n"), "item_id"))
    action = F.when(F.col("owner").isNull(), "learned").otherwise("promoted")
    return rows.withColumn("k", first).where("k = 1").select("item_id", "normalised", action.alias("action"))
