"""Rows that documents gave: merging two extractions, manual corrections, what may be benchmarked, bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FILLED = ("part_number", "quantity", "unit", "unit_price", "vat_rate", "vat_amount", "gross_amount")


def merge_headers(primary: DataFrame, secondary: DataFrame, key: str = "invoice_ref") -> DataFrame:
    """The primary header or totals row with null (or empty) fields filled from the secondary one of the same key."""
    fields = [c for c in primary.columns if c != key]
    kinds = dict(primary.dtypes)
    both = primary.alias("p").join(secondary.alias("s"), key, "left")
    own = lambda c: F.nullif(F.col(f"p.{c}"), F.lit("")) if kinds[c] == "string" else F.col(f"p.{c}")
    return both.select(key, *[F.coalesce(own(c), F.col(f"s.{c}")).alias(c) if c in secondary.columns else F.col(f"p.{c}") for c in fields])


def merge_lines(primary: DataFrame, secondary: DataFrame, take_lines: bool = True, key: str = "invoice_ref") -> DataFrame:
    """The priced primary lines, filled and followed by what only the secondary extraction has.

    Both: (invoice_ref, sequence_no, description, total, item_kind, and any of FILLED). The n-th primary line of a
    description and total meets the n-th secondary one of them, which fills its nulls and an unknown kind; secondary
    lines beyond those are appended, numbered on. Without `take_lines` the secondary lines count only for an invoice
    whose primary has no priced line. A column `origin` says where a line is from.
    """
    fields = [c for c in FILLED if c in primary.columns]
    same = ["description", "total"]
    priced = primary.where("total > 0")
    if not take_lines:
        rest = secondary.join(priced.select(key).distinct(), key, "left_anti")
        columns = [key, "sequence_no", *same, "item_kind", *fields]
        return priced.select(*columns, F.lit("primary").alias("origin")).unionByName(rest.select(*columns, F.lit("secondary").alias("origin")))
    nth = F.row_number().over(Window.partitionBy(key, *same).orderBy("sequence_no"))
    p = priced.withColumn("nth", nth).withColumn("mine", F.lit(True)).alias("p")
    s = secondary.withColumn("nth", nth).alias("s")
    on = (F.col(f"p.{key}") == F.col(f"s.{key}")) & F.col("p.description").eqNullSafe(F.col("s.description")) & F.col("p.total").eqNullSafe(F.col("s.total")) & (F.col("p.nth") == F.col("s.nth"))
    both = p.join(s, on, "full_outer")
    mine = F.col("mine").isNotNull()
    kind = F.when(mine & (F.col("p.item_kind") != "unknown"), F.col("p.item_kind")).otherwise(F.coalesce("s.item_kind", "p.item_kind"))
    rows = both.select(
        F.coalesce(f"p.{key}", f"s.{key}").alias(key), F.col("p.sequence_no").alias("own"), F.col("s.sequence_no").alias("other"), *[F.coalesce(f"p.{c}", f"s.{c}").alias(c) for c in same],
        kind.alias("item_kind"), *[F.coalesce(f"p.{c}", f"s.{c}").alias(c) for c in fields], F.when(mine, "primary").otherwise("secondary").alias("origin"),
    )
    place = F.row_number().over(Window.partitionBy(key).orderBy("origin", "other"))
    # Primary rows come first in the window, so appended lines are numbered on from them.
    number = F.when(F.col("origin") == "primary", F.col("own")).otherwise(place)
    return rows.withColumn("sequence_no", number.cast("long")).select(key, "sequence_no", *same, "item_kind", *fields, "origin")


def benchmarkable(invoices: DataFrame, lines: DataFrame, key: str = "invoice_ref") -> DataFrame:
    """Invoices with at least one priced part line: a description, and the kind part or a part number."""
    part = (F.lower("item_kind") == "part") | (F.coalesce("part_number", F.lit("")) != "")
    good = lines.where((F.trim(F.coalesce("description", F.lit(""))) != "") & F.coalesce(part, F.lit(False)) & (F.col("total") > 0))
    return invoices.join(good.select(key), key, "left_semi")


def add_mot_line(totals: DataFrame, lines: DataFrame, key: str = "invoice_ref") -> DataFrame:
    """The lines, and a test line without VAT for invoices with an amount exempt from VAT and no such service line.

    totals(invoice_ref, exempt), lines(invoice_ref, sequence_no, description, item_kind, total, vat_rate).
    """
    known = lines.where((F.col("item_kind") == "service") & F.contains("description", F.lit("mot"))).select(key)
    last = lines.groupBy(key).agg(F.count("*").alias("n"))
    missing = totals.where("exempt IS NOT NULL").join(known, key, "left_anti").join(last, key, "left")
    own = {"sequence_no": F.coalesce("n", F.lit(0)) + 1, "description": F.lit("mot test"), "item_kind": F.lit("service"), "total": F.col("exempt"), "vat_rate": F.lit(0)}
    kinds = dict(lines.dtypes)
    return lines.unionByName(missing.select(key, *[own.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in lines.columns if c != key]))


def apply_page_corrections(pages: DataFrame, fixes: DataFrame, page_types: list[str]) -> DataFrame:
    """pages with page_type, rotation and group_key as corrected by hand, and review_status.

    pages(document_id, page_number, page_type, rotation, group_key, confidence), fixes with the same keys and any of
    the three values (null: left as it is). A type that isn't known becomes "other".
    """
    keys = ["document_id", "page_number"]
    f = fixes.select(*keys, *[F.col(c).alias(f"new_{c}") for c in ("page_type", "rotation", "group_key")], F.lit(True).alias("fixed"))
    rows = pages.join(f, keys, "left")
    kind = F.coalesce("new_page_type", "page_type")
    status = F.when(F.col("fixed"), "corrected").when(F.col("confidence") < 0.7, "needs_review").otherwise("pending")
    return rows.select(*keys, F.when(kind.isin(page_types), kind).otherwise("other").alias("page_type"), F.coalesce("new_rotation", "rotation").alias("rotation"), F.coalesce("new_group_key", "group_key").alias("group_key"), "confidence", status.alias("review_status"))


def bundle_allocations(lines: DataFrame, components: DataFrame) -> DataFrame:
    """line_id, n_components, allocated (pence), state: "resolved", "unresolved" (nothing allocated) or why it is refused.

    lines(line_id, billed), components(line_id, allocated): at least two components, all or none of them allocated,
    and together the line's net amount.
    """
    sums = components.groupBy("line_id").agg(F.count("*").alias("n_components"), F.count("allocated").alias("given"), F.sum("allocated").alias("allocated"))
    state: Column = (
        F.when(F.col("n_components") < 2, "too_few_components").when(F.col("given") == 0, "unresolved")
        .when(F.col("given") < F.col("n_components"), "partly_allocated").when(F.col("allocated") != F.col("billed"), "sum_differs").otherwise("resolved")
    )
    return lines.select("line_id", "billed").join(sums, "line_id").select("line_id", "n_components", "allocated", state.alias("state"))


def bundle_summary(compared: DataFrame) -> DataFrame:
    """One row for each line of compared components (as `compare_lines` gives them, line_id the whole line): sums of
    positive challenges, of references and histories if every component has one, flags, review."""
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.sum(c))
    rows = compared.groupBy("line_id").agg(
        F.sum("billed").alias("billed"), F.sum(F.greatest("challenge_net", F.lit(0))).alias("challenge_net"), F.sum(F.greatest("vat_impact", F.lit(0))).alias("vat_impact"),
        whole("reference_expected").alias("reference_total"), whole("median_line").alias("history_total"), F.sum("history_count").alias("comparables"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("review_flags")))), ",").alias("flags"), F.max("review_required").alias("review_required"),
    )
    return rows.withColumn("challenge_price", F.col("billed") - F.col("challenge_net"))
