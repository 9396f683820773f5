"""Arithmetic checks of invoices, duplicates and findings against the claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repairbench.functions.exact import half_up
from repairbench.functions.text import registration_key, supplier_key


def _check(code: str, expected: Column, found: Column, tolerance: int) -> Column:
    status = F.when(expected.isNull() | found.isNull(), "not_applicable").when(F.abs(expected - found) <= tolerance, "pass").otherwise("fail")
    shown = F.when(expected.isNull() | found.isNull(), F.lit("MISSING_VALUE")).otherwise(F.lit(code))
    return F.struct(shown.alias("code"), expected.alias("expected"), found.alias("found"), status.alias("status"))


def validate_lines(lines: DataFrame, tolerance: int = 2) -> DataFrame:
    """line_id, code, expected, found, status: quantity times unit price (pence) against the line total."""
    product = half_up(F.col("unit_cost") * (F.col("quantity") * 10000).cast("long"), F.lit(10000))
    return lines.select("line_id", _check("LINE_MATH_MISMATCH", product, F.col("billed"), tolerance).alias("c")).select("line_id", "c.*")


def validate_invoices(invoices: DataFrame, lines: DataFrame, tolerance: int = 5, vat_tolerance: int = 2) -> DataFrame:
    """One row for each invoice and check. invoices(invoice_ref, labour, parts, subtotal, vat_rate, vat, exempt, gross) in pence.

    lines(invoice_ref, billed, kind, vatable). Labour stated only in the summary can't be checked, but counts.
    """
    labour = F.col("kind") == "labour"
    sums = lines.where("billed IS NOT NULL").groupBy("invoice_ref").agg(
        F.sum(F.when(labour, F.col("billed"))).alias("line_labour"), F.sum(F.when(F.col("vatable") & ~labour, F.col("billed"))).alias("line_parts"), F.sum(F.when(F.col("vatable"), F.col("billed"))).alias("line_all"),
    )
    rows = invoices.join(sums, "invoice_ref", "left")
    summary_only = F.col("line_labour").isNull() & F.col("labour").isNotNull() & (F.col("labour") != 0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    subtotal = zero("line_all") + F.when(summary_only, F.col("labour")).otherwise(0)
    labour_check = _check("LABOUR_TOTAL_MISMATCH", F.when(~summary_only, zero("line_labour")), F.col("labour"), tolerance)
    labour_check = labour_check.withField("code", F.when(summary_only, "LABOUR_TOTAL_MISMATCH").otherwise(labour_check["code"]))
    checks = F.array(
        labour_check,
        _check("PARTS_TOTAL_MISMATCH", zero("line_parts"), F.col("parts"), tolerance),
        _check("SUBTOTAL_MISMATCH", subtotal, F.col("subtotal"), tolerance),
        _check("VAT_MISCALC", half_up(F.col("subtotal") * F.col("vat_rate"), F.lit(100)), F.col("vat"), vat_tolerance),
        _check("TOTAL_MISMATCH", F.col("subtotal") + F.col("vat") + zero("exempt"), F.col("gross"), tolerance),
    )
    return rows.select("invoice_ref", F.explode(checks).alias("c")).select("invoice_ref", "c.*")


def duplicate_invoices(invoices: DataFrame) -> DataFrame:
    """Invoices of a claim that another document of it repeats: the same content, or the same number and supplier.

    invoices(case_id, document_id, sha256, number, supplier). Null numbers and hashes repeat nothing. Groups are
    counted, not joined with themselves, so a hot number makes no pairs.
    """
    keyed = invoices.withColumn("supplier_key", supplier_key(F.col("supplier")))
    by_hash = keyed.where("sha256 IS NOT NULL").groupBy("case_id", "sha256").agg(F.min("document_id").alias("a"), F.max("document_id").alias("b")).where("a <> b").select("case_id", "sha256", F.lit(True).alias("same_content"))
    by_name = keyed.where("number IS NOT NULL AND number <> ''").groupBy("case_id", "number", "supplier_key").agg(F.min("document_id").alias("a"), F.max("document_id").alias("b")).where("a <> b").select("case_id", "number", "supplier_key", F.lit(True).alias("same_number"))
    rows = keyed.join(by_hash, ["case_id", "sha256"], "left").join(by_name, ["case_id", "number", "supplier_key"], "left")
    return rows.where("same_content OR same_number").select("case_id", "document_id", F.coalesce("same_content", F.lit(False)).alias("same_content"), F.coalesce("same_number", F.lit(False)).alias("same_number"))


def consistency_findings(rows: DataFrame) -> DataFrame:
    """One row for each finding of an invoice against its claim: code, status, severity.

    rows(invoice_ref, accident_date, invoice_date, claim_registration, registration, claim_vehicle, vehicle, duplicate, damage, descriptions).
    """
    finding = lambda code, status, severity: F.struct(F.lit(code).alias("code"), F.lit(status).alias("status"), F.lit(severity).alias("severity"))
    want, have = registration_key(F.col("claim_registration")), registration_key(F.col("registration"))
    car, seen = supplier_key(F.col("claim_vehicle")), supplier_key(F.col("vehicle"))
    both_cars, like = (car != "") & (seen != ""), F.contains(seen, car) | F.contains(car, seen)
    dated = F.col("accident_date").isNotNull() & F.col("invoice_date").isNotNull()
    found = F.array(
        F.when((want == "") | (have == ""), finding("CLAIM_INVOICE_VRM_MISSING", "REVIEW", "AMBER")).when(want == have, finding("CLAIM_INVOICE_VRM_MATCH", "PASS", "INFO")).otherwise(finding("CLAIM_INVOICE_VRM_MISMATCH", "FAIL", "HIGH")),
        F.when(dated, F.when(F.col("invoice_date") >= F.col("accident_date"), finding("INVOICE_AFTER_ACCIDENT", "PASS", "INFO")).otherwise(finding("INVOICE_BEFORE_ACCIDENT", "FAIL", "HIGH"))),
        F.when(both_cars, F.when(like, finding("CLAIM_INVOICE_VEHICLE_MATCH", "PASS", "INFO")).otherwise(finding("CLAIM_INVOICE_VEHICLE_MISMATCH", "REVIEW", "AMBER"))),
        F.when(F.coalesce("duplicate", F.lit(False)), finding("DUPLICATE_INVOICE", "FAIL", "HIGH")).otherwise(finding("NO_DUPLICATE_INVOICE_FOUND", "PASS", "INFO")),
        F.when((F.coalesce("damage", F.lit("")) != "") & (F.coalesce("descriptions", F.lit("")) != ""), finding("DAMAGE_REPAIR_CAUSATION_REVIEW", "REVIEW", "AMBER")),
    )
    return rows.select("invoice_ref", F.explode(F.array_compact(found)).alias("f")).select("invoice_ref", "f.*")
