"""Pages of documents: classes, invoice units, rotated runs, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Phrases that decide a page's class, tried in this order.
STRONG = [
    ("engineer_assessment", ["engineer assessment report", "engineer report", "audatex system using manufacturer times", "assessment number"]),
    ("credit_note", ["credit note"]),
    ("estimate", ["estimate/order", "estimate / order", "quotation"]),
    ("invoice", ["sales invoice", "tax invoice", "invoice total"]),
    ("mot", ["mot test certificate", "ministry of transport"]),
    ("vehicle_document", ["v5c", "vehicle registration certificate", "dvla"]),
    ("service_history", ["service history", "work history", "service record"]),
]


def classify_page(text: Column, image_only: Column | None = None) -> Column:
    """struct(page_type, confidence, signals) of a page's text."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    image_only = F.lit(False) if image_only is None else image_only

    def said(kind: Column, confidence: Column, signals: Column) -> Column:
        return F.struct(kind.alias("page_type"), confidence.cast("double").alias("confidence"), signals.alias("signals"))

    hits = lambda words: F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(lower, w))
    amounts = F.regexp_count(lower, F.lit(r"£?\d+[,.]\d{2}"))
    out = None
    for kind, words in STRONG:
        found = hits(words)
        case = said(F.lit(kind), F.least(F.lit(0.72) + F.lit(0.08) * F.size(found), F.lit(0.99)), found)
        out = F.when(F.size(found) > 0, case) if out is None else out.when(F.size(found) > 0, case)
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    out = out.when(F.contains(lower, F.lit("invoice")), said(F.lit("invoice"), F.lit(0.78), words("invoice")))
    quoted = hits(["estimate", "quote"])
    out = out.when(F.size(quoted) > 0, said(F.lit("estimate"), F.lit(0.72), quoted))
    out = out.when(F.length(F.trim(lower)) < 5, said(F.when(image_only, "photo").otherwise("blank"), F.lit(0.62), words("no readable text")))
    table = (amounts >= 4) & F.regexp_like(lower, F.lit("vat|total|qty"))
    out = out.when(table, said(F.lit("invoice"), F.lit(0.72), F.array(F.lit("financial table"), F.concat(amounts.cast("string"), F.lit(" amounts")))))
    return out.otherwise(said(F.lit("other"), F.lit(0.55), words("no decisive document keywords")))


def group_key(page_type: Column, text: Column, page_number: Column) -> Column:
    """Invoice unit of a page: its class with a printed number that has a digit, else with the page number."""
    numbers = [F.upper(F.regexp_extract(text, p, 1)) for p in (r"(?i)Invoice\s*(?:No\.?|Number)?\s*[:#]?\s*([A-Z0-9][A-Z0-9/-]{2,})", r"(?i)Document No\.?\s*[:#]?\s*([A-Z0-9/-]{3,})")]
    printed = F.coalesce(*[F.when(F.regexp_like(n, F.lit("[0-9]")), n) for n in numbers])
    key = F.concat_ws(":", page_type, F.coalesce(printed, F.concat(F.lit("page-"), page_number.cast("string"))))
    return F.when(page_type.isin("invoice", "estimate", "credit_note"), key)


def label_rotated_runs(pages: DataFrame) -> DataFrame:
    """Other pages in runs of two or more rotated pages that speak of service become service history.

    pages(document_id, page_number, rotation, text, page_type, confidence).
    """
    by = Window.partitionBy("document_id").orderBy("page_number")
    turned = F.coalesce(F.col("rotation").isin(90, 270), F.lit(False))
    follows = F.lag(F.when(turned, F.col("page_number"))).over(by) == F.col("page_number") - 1
    rows = pages.withColumn("_turned", turned).withColumn("_run", F.sum(F.when(turned & F.coalesce(follows, F.lit(False)), 0).otherwise(1)).over(by))
    run = Window.partitionBy("document_id", "_run")
    speaks = F.max(F.regexp_like(F.lower("text"), F.lit("service|workshop|inspection|maintenance")).cast("int")).over(run)
    hit = F.col("_turned") & (F.count("*").over(run) >= 2) & (speaks == 1) & (F.col("page_type") == "other")
    rows = rows.withColumn("_hit", hit)
    return rows.withColumn("page_type", F.when(F.col("_hit"), "service_history").otherwise(F.col("page_type"))).withColumn("confidence", F.when(F.col("_hit"), F.greatest("confidence", F.lit(0.68))).otherwise(F.col("confidence"))).drop("_turned", "_run", "_hit")


def carry_section(lines: DataFrame, keys: list[str], order: str, heading: str) -> DataFrame:
    """lines with `section`: the latest heading at or before each line, unknown before the first."""
    last = F.last(heading, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("section", F.coalesce(last, F.lit("unknown")))


def text_lines(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """page id, position and text of each line of a page that has a money amount and a word, but is no total."""
    rows = pages.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), r"\r?\n")).alias("position", "line"))
    priced = F.regexp_like("line", F.lit(r"\d+\.\d{2}(?!\d)")) & F.regexp_like("line", F.lit("[A-Za-z]{3}"))
    total = F.regexp_like(F.lower("line"), F.lit("subtotal|total|vat|balance|payment|terms and conditions|all repairs are undertaken|receipt"))
    return rows.where(priced & ~total)
