"""Repairers, items and their edges, from P90 exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repairbench.functions.exact import pounds
from repairbench.functions.text import repairer_key


def _first(found: DataFrame) -> Column:
    """The spelling of the first exception by (invoice date, ref, line); if lines have no line_id, the first spelling of that invoice."""
    return F.min_by(F.trim("repairer"), F.struct("invoice_date", "invoice_ref", "line_id" if "line_id" in found.columns else F.trim("repairer")))


def repairer_item_trends(found: DataFrame) -> DataFrame:
    """One row for each repairer and item: challenges, distinct invoices, total and largest difference and percent.

    The shown repairer is the spelling of its first exception.
    """
    first = _first(found)
    return found.withColumn("repairer_key", repairer_key(F.col("repairer"))).groupBy("repairer_key", "item_name").agg(
        first.alias("repairer"), F.count("*").alias("challenge_count"), F.countDistinct("invoice_ref").alias("invoice_count"),
        F.sum("difference").alias("total"), F.max("difference").alias("largest"), F.max("percent_above").alias("maximum_percent"),
    )


def repairer_trends(found: DataFrame) -> DataFrame:
    """One row for each repairer; ordered by invoices, challenges and name where shown."""
    first = _first(found)
    rows = found.withColumn("repairer_key", repairer_key(F.col("repairer"))).groupBy("repairer_key").agg(
        first.alias("repairer"), F.count("*").alias("challenge_count"), F.countDistinct("invoice_ref").alias("invoice_count"),
        F.sum("difference").alias("total"), F.max("difference").alias("largest"), F.countDistinct("item_name").alias("item_count"),
    )
    return rows.select("repairer", "challenge_count", "invoice_count", pounds(F.col("total")).alias("total_difference"), pounds(F.col("largest")).alias("maximum_difference"), "item_count")


def shown_exceptions(found: DataFrame, repairers: int = 8, items: int = 10) -> DataFrame:
    """The exceptions of the largest repairers, of the most challenged items among them: by distinct invoices, challenges, name."""
    keyed = found.withColumn("repairer_key", repairer_key(F.col("repairer")))
    size = [F.countDistinct("invoice_ref").alias("invoices"), F.count("*").alias("challenges")]
    order = lambda name: [F.desc("invoices"), F.desc("challenges"), F.asc(name)]
    top = keyed.groupBy("repairer_key").agg(*size).orderBy(*order("repairer_key")).limit(repairers).select("repairer_key")
    shown = keyed.join(F.broadcast(top), "repairer_key", "left_semi")
    most = shown.groupBy("item_name").agg(*size).orderBy(*order("item_name")).limit(items).select("item_name")
    return shown.join(F.broadcast(most), "item_name", "left_semi")


def repairer_graph(found: DataFrame, repairers: int = 8, items: int = 10) -> DataFrame:
    """Edges between the repairers and items that are shown."""
    return repairer_item_trends(shown_exceptions(found, repairers, items).drop("repairer_key"))


def graph_totals(found: DataFrame, repairers: int = 8, items: int = 10) -> DataFrame:
    """One row over the shown edges: distinct invoices, challenges, the difference in all (pence), first repairer and item."""
    shown = shown_exceptions(found, repairers, items)
    whole = shown.agg(F.countDistinct("invoice_ref").alias("invoice_count"), F.count("*").alias("challenge_count"), F.sum("difference").alias("total"))
    keyed = found.withColumn("repairer_key", repairer_key(F.col("repairer")))
    size = [F.countDistinct("invoice_ref").alias("i"), F.count("*").alias("c")]
    first = lambda df, key, out: df.groupBy(key).agg(*size).agg(F.min_by(key, F.struct(-F.col("i"), -F.col("c"), key)).alias(out))
    return whole.join(first(keyed, "repairer_key", "top_repairer")).join(first(shown, "item_name", "top_item"))
