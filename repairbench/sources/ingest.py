"""Imports with rejects, idempotent versions, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repairbench.functions.text import normalise_description, vehicle_name_key


def import_ontology(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and rejects: texts trimmed, lists split at ``;``, rate means labour, unknown confidence is low.

    A priced item needs an effective date; a single part-number example becomes the part number.
    """
    split = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    rows = raw.withColumn("synonyms", split("synonyms")).withColumn("part_number_examples", split("part_number_examples"))
    rows = rows.withColumn("item_type", F.when(F.trim("item_type") == "rate", "labour").otherwise(F.trim("item_type"))).withColumn("unit", F.lower(F.trim("unit")))
    rows = rows.withColumn("confidence_level", F.when(F.coalesce(F.lower(F.trim("confidence_level")), F.lit("none")).isin("low", "medium", "high"), F.lower(F.trim("confidence_level"))).otherwise("low"))
    rows = rows.withColumn("part_number", F.when(F.size("part_number_examples") == 1, F.get("part_number_examples", 0)))
    bad = F.col("ontology_id").isNull() | F.col("canonical_name").isNull() | (F.col("reference_price").isNotNull() & F.col("effective_date").isNull())
    return rows.where(~bad), rows.where(bad)


def explode_synonyms(items: DataFrame) -> DataFrame:
    """One row for each item and normalised synonym, the first spelling by position; empty ones are left out."""
    rows = items.select("ontology_id", F.posexplode("synonyms").alias("position", "synonym")).withColumn("normalised", normalise_description(F.col("synonym"))).where("normalised <> ''")
    first = F.row_number().over(Window.partitionBy("ontology_id", "normalised").orderBy("position"))
    return rows.withColumn("k", first).where("k = 1").drop("k")


def import_history(raw: DataFrame, items: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected history lines; lines of the gold set are in neither."""
    rows = raw.join(gold.select("claim_line_id"), "claim_line_id", "left_anti")
    known = items.select(F.col("ontology_id").alias("mapped_ontology_id")).distinct().withColumn("known", F.lit(True))
    told = rows.join(known, "mapped_ontology_id", "left")
    reason = F.when(F.col("invoice_date").isNull(), "missing_date").when(F.col("line_total").isNull(), "missing_total").when(F.col("known").isNull(), "unknown_item")
    told = told.withColumn("reason", reason).drop("known")
    return told.where("reason IS NULL").drop("reason"), told.where("reason IS NOT NULL")


def import_external_prices(raw: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Provisional prices of known items, and for each provider the rows, accepted and rejected."""
    known = items.select(F.col("ontology_id").alias("ontology_code")).distinct().withColumn("known", F.lit(True))
    told = raw.join(known, "ontology_code", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    report = told.groupBy("provider_name").agg(F.count("*").alias("rows"), F.sum(F.col("known").cast("int")).alias("accepted"), F.sum((~F.col("known")).cast("int")).alias("rejected"))
    return told.where("known").drop("known").withColumn("status", F.lit("provisional")), report


def new_versions(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """Datasets (role, schema, content) not imported yet; a version is role:schema:sha256."""
    version = F.concat_ws(":", "role", "schema", F.sha2("content", 256))
    return incoming.withColumn("version", version).join(registry.select("version"), "version", "left_anti")


def upsert_catalogue(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The catalogue with matches on the (make, model) keys updated and others added; `change` says which.

    incoming has a column `position`: of repeated keys the last row wins.
    """
    keyed = lambda df: df.withColumn("mk", vehicle_name_key(F.col("make"))).withColumn("md", vehicle_name_key(F.col("model")))
    last = F.row_number().over(Window.partitionBy("mk", "md").orderBy(F.desc("position")))
    new = keyed(incoming).withColumn("k", last).where("k = 1").drop("k", "position").alias("n")
    old = keyed(current).alias("o")
    both = old.join(new, ["mk", "md"], "full_outer")
    columns = [F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in current.columns]
    change = F.when(F.col("o.make").isNull(), "created").when(F.col("n.make").isNull(), "kept").otherwise("updated")
    return both.select(*columns, change.alias("change"))


def import_report(items: DataFrame, history: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: what an import holds. items(reference_price), history(document_role), gold(invoice_number), kept out of it."""
    rows = items.select(F.lit("item").alias("kind"), F.col("reference_price").isNotNull().alias("priced"))
    rows = rows.unionByName(history.select(F.lit("history").alias("kind"), F.col("document_role").alias("role")), allowMissingColumns=True)
    rows = rows.unionByName(gold.select(F.lit("gold").alias("kind"), F.col("invoice_number").alias("number")), allowMissingColumns=True)
    count = lambda test, name: F.count(F.when(F.expr(test), True)).alias(name)
    return rows.agg(
        count("kind = 'item'", "item_rows"), count("kind = 'item' AND priced", "priced"), count("kind = 'item' AND NOT priced", "missing_price"),
        count("kind = 'history'", "history_rows"), count("role = 'invoice'", "invoice_rows"), count("role = 'estimate'", "estimate_rows"), count("kind = 'gold'", "gold_rows"), F.countDistinct("number").alias("gold_invoices"),
    )
