"""Governed comparison of lines: reference price, history, gates, summary of invoices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repairbench.functions.exact import half_up
from repairbench.functions.rules import Policy, challenge, challenge_score, expected_amount, lineage_independence, percent_of, severity


def source_agreement(reference: Column, history: Column, independent: Column) -> Column:
    """How near two independent prices (pence) lie, 0 to 1 with six digits; 0 if they aren't independent."""
    larger = F.greatest(reference, history)
    share = half_up((larger - F.abs(reference - history)) * 1000000, larger).cast("decimal(20,0)") / F.lit(1000000).cast("decimal(20,0)")
    return F.when(independent & (larger > 0) & reference.isNotNull() & history.isNotNull(), F.greatest(share, F.lit(0))).otherwise(F.lit(0)).cast("decimal(20,6)")


def compare_lines(lines: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """lines with benchmark, its source, challenge amounts (pence), severity, evidence score, lineages and review flags.

    lines(line_id, billed, quantity, unit, vat_rate, vatable, reference, scope, approved, eligible_count,
    median_line): money in pence, history columns as historical_statistics gives them (null: no history). If there:
    reference_lineage and lineages (where the reference price and the history come from), mapping_confidence (0 if not).
    """
    given = {c.lower() for c in lines.columns}
    told = lambda name, kind: F.col(name).cast(kind) if name in given else F.lit(None).cast(kind)
    amount, flag = expected_amount(F.col("reference"), F.col("scope"), F.col("quantity"), F.col("unit"))
    rows = lines.withColumn("reference_expected", amount).withColumn("reference_flag", F.when(F.col("reference").isNotNull(), flag))
    rows = rows.withColumn("history_count", F.coalesce("eligible_count", F.lit(0)))
    unsure = F.coalesce(F.regexp_like("reference_flag", F.lit("^(EXPECTED_QUANTITY_|INVOICE_UNIT_|UNIT_MISMATCH)")), F.lit(False))
    by_reference = F.coalesce(F.col("approved") & F.col("reference_expected").isNotNull(), F.lit(False))
    by_history = F.col("median_line").isNotNull() & (F.col("history_count") >= policy.least_history) & ~unsure
    blend = half_up(F.col("reference_expected") * int(policy.reference_weight * 100) + F.col("median_line") * int(policy.history_weight * 100), F.lit(100))
    alone = by_history & F.lit(policy.history_alone)
    source = F.when(by_reference & by_history, "weighted_consensus").when(by_reference, "ontology").when(alone, "history").otherwise("none")
    rows = rows.withColumn("source", source)
    rows = rows.withColumn("benchmark", F.when(F.col("source") == "weighted_consensus", blend).when(F.col("source") == "ontology", F.col("reference_expected")).when(F.col("source") == "history", F.col("median_line")))
    if policy.floor_pence is not None:
        rows = rows.withColumn("benchmark", F.when(F.col("benchmark").isNotNull(), F.greatest("benchmark", F.lit(policy.floor_pence))))
    sources = lineage_independence(F.when(F.col("reference").isNotNull(), told("reference_lineage", "string")), told("lineages", "array<string>"))
    rows = rows.withColumn("lineage_known", sources["known"]).withColumn("independent", sources["independent"]).withColumn("all_lineages", sources["lineages"])
    flags = F.array(
        F.col("reference_flag"),
        F.when(F.col("reference").isNotNull() & ~F.coalesce("approved", F.lit(False)), "ONTOLOGY_EVIDENCE_NOT_APPROVED"),
        F.when((F.col("history_count") > 0) & (F.col("history_count") < policy.least_history), "HISTORY_SAMPLE_WEAK"),
        F.when(unsure, "HISTORY_QUANTITY_NOT_VERIFIABLE"),
        F.when(F.col("lineage_known") & ~F.col("independent"), "SOURCE_LINEAGE_NOT_INDEPENDENT"),
        F.when(F.col("source") == "history", "HISTORY_ONLY_REVIEW_REQUIRED"),
        F.when(F.col("source") == "none", "NO_RELIABLE_APPROVED_BENCHMARK"),
    )
    amounts = challenge(F.col("billed"), F.coalesce("benchmark", "billed"), F.col("vat_rate"), F.col("vatable"), policy)
    rows = rows.withColumn("review_flags", F.array_compact(flags)).withColumns(amounts)
    rows = rows.withColumn("severity", severity(F.col("gate_passed"), F.col("challenge_net"), F.col("challenge_percent"), policy))
    price = F.when(F.col("reference").isNull(), F.lit(0.55)).when(F.col("approved"), F.lit(0.90)).otherwise(F.lit(0.65))
    sample = F.least("history_count", F.lit(policy.strong_history)) / F.lit(policy.strong_history)
    agreement = source_agreement(F.col("reference_expected"), F.col("median_line"), F.col("independent"))
    one = F.lit(1)
    score, label = challenge_score(F.coalesce(told("mapping_confidence", "decimal(20,6)"), F.lit(0)), price, one, sample, one, agreement, F.col("independent"), F.lit(0))
    rows = rows.withColumn("score", score).withColumn("score_label", label)
    return rows.withColumn("review_required", F.size(F.array_except("review_flags", F.array(F.lit("HISTORY_SAMPLE_WEAK")))) > 0)


def invoice_summary(compared: DataFrame, key: str = "invoice_ref") -> DataFrame:
    """Sums of positive challenges for each invoice; lines below their benchmark never offset them.

    With the mean evidence score (whole, half up), its label, and the challenge in hundredths of a percent of what was billed.
    """
    positive = lambda c: F.sum(F.greatest(F.col(c), F.lit(0)))
    level = lambda name: F.sum(F.when(F.col("severity") == name, 1).otherwise(0)).alias(f"{name}_count")
    rows = compared.groupBy(key).agg(
        F.sum("billed").alias("billed"), positive("challenge_net").alias("challenge_net"), positive("vat_impact").alias("vat_impact"),
        F.sum(F.col("gate_passed").cast("int")).alias("challenged_lines"), level("neutral"), level("amber"), level("red"),
        F.sum((F.col("score") * 100).cast("long")).alias("points"), F.count("score").alias("scored"),
    )
    mean = half_up(F.col("points"), 100 * F.col("scored"))
    label = F.when(F.col("points") >= 8000 * F.col("scored"), "Strong").when(F.col("points") >= 6000 * F.col("scored"), "Moderate").otherwise("Weak")
    rows = rows.withColumn("challenge_gross", F.col("challenge_net") + F.col("vat_impact")).withColumn("challenge_price", F.col("billed") - F.col("challenge_net"))
    rows = rows.withColumn("mean_score", mean).withColumn("label", label).withColumn("percent", percent_of(F.col("challenge_net"), F.col("billed")))
    return rows.drop("points", "scored")
