"""Engineers' assessment reports: labelled fields and operation rows out of page texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The labels of a report, the field of each, and what stands behind it.
FIELDS = (
    ("Assessment Number", "assessment_number", "text"),
    ("Claim Reference", "claim_reference", "text"),
    ("Policy Number", "policy_number", "text"),
    ("Created", "created_date", "date"),
    ("Date of Incident", "incident_date", "date"),
    ("Authorisation Status", "authorisation_status", "text"),
    ("Registration", "registration", "text"),
    ("VIN", "vin", "text"),
    ("Manufacturer", "vehicle_make", "text"),
    ("Model", "vehicle_model", "text"),
    ("Variant", "vehicle_variant", "text"),
    ("Odometer", "mileage", "count"),
    ("Pre-Accident Condition", "pre_accident_condition", "text"),
    ("Severity of Impact", "impact_severity", "text"),
    ("Vehicle Status on Inspection", "roadworthiness", "text"),
    ("Damage Areas", "damage_areas", "list"),
    ("Labour Rate", "labour_rate", "money"),
    ("Paint Rate", "paint_rate", "money"),
    ("Total Labour", "labour_net", "money"),
    ("Total Paint/Material Costs", "paint_net", "money"),
    ("Total Parts", "parts_net", "money"),
    ("Total Additional Costs", "extras_net", "money"),
    ("Grand Total Excl VAT", "subtotal_net", "money"),
    ("VAT Rate", "vat_rate", "percent"),
    ("^VAT", "vat_total", "money"),
    ("Grand Total Incl VAT", "gross_total", "money"),
)
VALUES = {"text": r"([^\n]+)", "date": r"([^\n]+)", "list": r"([^\n]+)", "count": r"([\d,]+)", "money": r"£?([\d,.]+)", "percent": r"([\d.]+)%"}
REQUIRED = ("assessment_number", "claim_reference", "registration", "gross_total")
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def number(c: Column) -> Column:
    """A decimal written with thousands commas and perhaps a pound sign; ``-``, ``N/A`` and anything else give null."""
    return F.regexp_replace(c, "[,£]", "").try_cast("decimal(20,4)")


def _day(c: Column) -> Column:
    shape = lambda p, f: F.when(F.regexp_like(c, F.lit(p)), F.try_to_timestamp(c, F.lit(f)).cast("date"))
    return F.coalesce(shape(r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), shape(r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"))


def _value(kind: str, found: Column) -> Column:
    if kind == "date":
        return _day(found)
    if kind in ("money", "percent"):
        return number(found)
    if kind == "count":
        return F.regexp_replace(found, ",", "").try_cast("long")
    if kind == "list":
        return F.filter(F.transform(F.split(found, ","), _strip), lambda x: x != "")
    return found


def report_operations(pages: DataFrame) -> DataFrame:
    """document_id, sequence_no, category, code, description, work_units, hours, quantity, unit_price, total, page_number.

    pages(document_id, page_number, text). An operation is a line ``OP|…`` of exactly nine parts; null texts have none.
    """
    rows = pages.select("document_id", "page_number", F.posexplode(F.split(F.coalesce("text", F.lit("")), LINE_BREAK)).alias("place", "line"))
    rows = rows.where(F.regexp_like("line", F.lit(r"(?i)^\s*OP\|"))).withColumn("p", F.transform(F.split("line", r"\|", -1), _strip)).where(F.size("p") == 9)
    order = Window.partitionBy("document_id").orderBy("page_number", "place", "line")
    p = lambda i: F.col("p")[i]
    return rows.select(
        "document_id", F.row_number().over(order).alias("sequence_no"), F.lower(p(1)).alias("category"), F.nullif(p(2), F.lit("")).alias("code"), p(3).alias("description"),
        *[number(p(i)).alias(name) for i, name in enumerate(("work_units", "hours", "quantity", "unit_price", "total"), 4)], "page_number",
    )


def _operations_of(text: str) -> Column:
    """How many operations (see `report_operations`) a page has."""
    lines = F.filter(F.split(text, LINE_BREAK), lambda x: F.regexp_like(x, F.lit(r"(?i)^\s*OP\|")) & (F.size(F.split(x, r"\|", -1)) == 9))
    return F.when(F.contains(F.lower(text), F.lit("op|")), F.size(lines)).otherwise(0)


def joined_labels(text: Column) -> Column:
    """The text with each label that is alone on its line joined with the next line: label by label, in the order of FIELDS.

    Where no two such lines follow each other, the order doesn't matter and one pass finds them all.
    """
    labels = "|".join(label for label, _, _ in FIELDS)
    chain = F.regexp_like(text, F.lit(rf"(?imd)^(?:{labels})[ \t]*\n[ \t]*(?:{labels})[ \t]*$"))
    pattern = r"(?imd)^({})[ \t]*\n[ \t]*([^\n]+)$"
    one_by_one = reduce(lambda c, f: F.regexp_replace(c, pattern.format(f[0]), "$1: $2"), FIELDS, text)
    return F.when(chain, one_by_one).otherwise(F.regexp_replace(text, pattern.format(labels), "$1: $2"))


def parse_assessments(pages: DataFrame) -> DataFrame:
    """One row for each document_id: every field of FIELDS, operations (count), confidence (hundredths), error.

    pages(document_id, page_number, text), joined in page order. A label alone on its line takes the next line as its
    value. A missing gross total is net and VAT together. Without a number or any operation the row has an error.
    """
    page = pages.select("document_id", "page_number", F.coalesce("text", F.lit("")).alias("text"))
    one = F.sort_array(F.collect_list(F.struct("page_number", "text")))
    docs = page.withColumn("n", _operations_of("text")).groupBy("document_id").agg(F.array_join(F.transform(one, lambda x: x["text"]), "\n").alias("text"), F.sum("n").alias("operations"))
    docs = docs.select("document_id", F.concat(F.lit("\n"), joined_labels(F.col("text"))).alias("text"), "operations")
    # Labels are found in a copy in lower case, character by character in the same places; patterns begin where their label
    # does. The lambdas keep Spark from generating one method for all steps, which would be too long to be compiled.
    low = F.get(F.transform(F.array(F.replace("text", F.lit("\u0130"), F.lit("?"))), F.lower), F.lit(0))
    docs = docs.withColumn("low", low)
    docs = docs.select("document_id", "text", "operations", *[F.instr("low", label.lower().replace("^", "\n")).alias(f"at_{name}") for label, name, _ in FIELDS])
    value = lambda at, label, kind: F.when(at > 0, F.regexp_extract(F.substr("text", at), rf"(?imd){label}\s*:\s*{VALUES[kind]}", 1))
    filled = lambda c: F.get(F.filter(F.array(_strip(c)), lambda x: x != ""), F.lit(0))
    docs = docs.select("document_id", "operations", *[filled(value(F.col(f"at_{name}"), label, kind)).alias(name) for label, name, kind in FIELDS])
    docs = docs.select("document_id", *[_value(kind, F.col(name)).alias(name) for _, name, kind in FIELDS], "operations")
    docs = docs.withColumn("gross_total", F.coalesce("gross_total", (F.col("subtotal_net") + F.col("vat_total")).cast("decimal(20,4)")))
    known = sum((F.col(name).isNotNull().cast("int") for name in REQUIRED), F.lit(0))
    docs = docs.withColumn("confidence", F.least(F.lit(70) + known * 5 + F.least("operations", F.lit(5)) * 2, F.lit(99)))
    lacking = F.col("assessment_number").isNull() | (F.col("operations") == 0)
    return docs.withColumn("error", F.when(lacking, "missing_identifier_or_operations"))
