"""Invoices read from page texts and tables: lines, header fields and totals, on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repairbench.functions.rules import item_kind
from repairbench.functions.text import clean_identifier, normalise_description, normalise_unit
from repairbench.operators.pages import carry_section

# An amount of money; words of table headers; words of headings; what makes a priced row none; patterns of fields.
MONEY = r"(?:£\s*)?([0-9][0-9,]*\.\d{2})"
COLUMNS = {
    "description": ["description", "operation", "item"],
    "quantity": ["qty", "quantity"],
    "unit_price": ["unit price", "unit cost", "rate", "price"],
    "line_total": ["line total", "subtotal", "sub total", "amount"],
    "part_number": ["part number", "part no", "part #"],
}
GOVERNED = ["parts", "labour", "service"]
PARTS_TABLE = ["qty", "quantity", "unit", "value", "total"]
LABOUR_HEADINGS = ["work performed", "labour work carried out"]
NO_LINE = ["subtotal", "total", "vat", "balance", "payment", "terms and conditions", "all repairs are undertaken", "receipt"]
NUMBER = [r"(?i)Invoice\s*(?:No\.?|Number)?\s*[:#]?\s*([A-Z0-9][A-Z0-9/-]{2,})", r"(?i)SALES INVOICE.*?Invoice No\s*[:#]?\s*([A-Z0-9/-]+)"]
DATE = r"(?i)(?:Invoice Date|Date of Work|Date)\s*:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"
REGISTRATION = r"(?i)(?<!VAT\s)(?:Registration|Reg\.?\s*No\.?)\s*:?\s*([A-Z]{1,3}[0-9]{1,3}\s?[A-Z]{1,3})"
MILEAGE = r"(?i)Mileage\s*:?\s*([0-9,]{3,})"
VAT_NUMBER = r"(?i)VAT\s*(?:Reg(?:istration)?\s*(?:No\.)?|Number)\s*[:.]?\s*([0-9 ]{8,15})"
SUPPLIER = r"(?i)(clinic|garage|autosolutions|mot centre|mini service)"
CUSTOMER = r"(?i)(?:Clinic|Garage|Autosolutions|MOT Centre)\s+(.+?)\s+Invoice\s+[A-Z0-9/-]+"
VEHICLE = r"(?i)^([A-Z]{1,3}[0-9]{1,3}\s?[A-Z]{1,3})\s+(.+?)\s+([A-Z0-9]{12,20})\s+([0-9]{3,5})\s+([0-9,]{3,})$"
SHORT_VEHICLE = r"(?i)^([A-Z]{1,3}[0-9]{1,3}\s?[A-Z]{1,3})\s*[-–—]\s*([A-Z][A-Z0-9 .'-]+)$"
TOTALS = {"labour": "Labour", "parts": "Parts", "subtotal": r"Sub\s*Total", "vat": r"VAT\s*(?:\([^)]*\))?", "non_vatable": "MOT"}
GROSS = rf"(?i)(?<!Sub)\bTotal\b\s*[:£]?\s*{MONEY}"
VAT_RATE = r"(?i)VAT\s*\((\d+(?:\.\d+)?)%\)"
_BREAKS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def clean(c: Column) -> Column:
    """Without blocks of a scan, runs of white space as one space, trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[█▉▊▋▌▍▎▏]+", " "), r"(?U)\s+", " "))


#: White space that `quick_clean` turns into one space, of ASCII texts.
_WHITE = ["  ", "\t", "\n", "\u000b", "\f", "\r"]


def quick_clean(c: Column) -> Column:
    """As `clean`; texts of ASCII and pound signs without such white space, as most are, pass no regular expression. Dearer than `clean` in lambdas, which aren't compiled."""
    text = F.coalesce(c, F.lit(""))
    bare = F.replace(text, F.lit("£"), F.lit(""))
    odd = (F.octet_length(bare) != F.length(bare)) | _has(text, _WHITE)
    return F.when(odd, clean(text)).otherwise(F.trim(text))


def _decimal(c: Column) -> Column:
    return F.trim(F.replace(F.replace(c, F.lit(","), F.lit("")), F.lit("£"), F.lit(""))).try_cast("decimal(30,10)")


def _money(c: Column) -> Column:
    return F.round(_decimal(c), 2).cast("decimal(20,2)")


def _has(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _taxed(rows: DataFrame, section: Column) -> DataFrame:
    """Rows with normalised description, kind, unit, VAT and gross, from section, description, line_total and vat_rate."""
    rows = rows.withColumn("item_kind", item_kind(section, F.col("description"))).withColumn("normalised_description", normalise_description(F.col("description")))
    rows = rows.withColumn("unit", normalise_unit(F.lit(None).cast("string"), F.col("item_kind")))
    rows = rows.withColumn("vat_amount", F.round(F.col("line_total") * F.col("vat_rate") / 100, 2).cast("decimal(20,2)"))
    return rows.withColumn("gross_amount", (F.col("line_total") + F.col("vat_amount")).cast("decimal(20,2)"))


LINE = ["sequence_no", "description", "normalised_description", "item_kind", "part_number", "quantity", "unit", "unit_price", "line_total", "vat_rate", "vat_amount", "gross_amount"]


def table_lines(tables: DataFrame, keys: list[str], table_no: str = "table_no", cells: str = "cells") -> DataFrame:
    """keys and the lines of tables(keys, table_no, cells array<array<string>>), numbered through the tables of a key.

    A table's first row chooses columns by what its cells contain, the leftmost for each: it needs a description, a quantity
    and a total. Or it names a sub total and parts, labour or service, then cells count by place (parts: description, number,
    quantity, unit price, any, total; labour without the number). Rows whose first cell is empty, that are too short, hold
    something else than a number or have no total are no lines. A missing unit price is total by quantity. Null tables and
    cells are empty.
    """
    rows = tables.select(*keys, F.col(table_no).alias("_table"), F.transform(F.coalesce(cells, F.array().cast("array<array<string>>")), lambda r: F.transform(F.coalesce(r, F.array().cast("array<string>")), clean)).alias("_rows")).where(F.size("_rows") > 1)
    rows = rows.withColumn("_head", F.transform(F.get("_rows", F.lit(0)), F.lower))
    place = lambda words: F.nullif(F.array_position(F.transform("_head", lambda h: _has(h, words)), True), F.lit(0)).cast("int")
    at = {n: place(words) for n, words in COLUMNS.items()}
    at["line_total"] = F.coalesce(at["line_total"], place(["total"]))
    rows = rows.withColumn("_at", F.struct(*[c.alias(n) for n, c in at.items()])).withColumn("_text", F.array_join(F.filter("_head", lambda h: h != ""), " "))
    chosen = F.col("_at.description").isNotNull() & F.col("_at.quantity").isNotNull() & F.col("_at.line_total").isNotNull()
    section = F.when(F.contains("_text", F.lit("labour")), "labour").otherwise("parts")
    rows = rows.withColumn("_chosen", chosen).withColumn("_section", section).where(F.col("_chosen") | (F.contains("_text", F.lit("sub total")) & _has(F.col("_text"), GOVERNED)))
    places = {"description": (1, 1), "part_number": (2, 0), "quantity": (3, 2), "unit_price": (4, 3), "line_total": (6, 5)}  # from 1, in tables of parts and of labour; 0: none
    by_place = [F.when(F.col("_section") == "labour", b).otherwise(a).alias(n) for n, (a, b) in places.items()]
    named = [F.coalesce(F.col(f"_at.{n}"), F.lit(0)).alias(n) for n in places]
    rows = rows.withColumn("_use", F.when(F.col("_chosen"), F.struct(*named)).otherwise(F.struct(*by_place)))
    need = F.when(F.col("_chosen"), F.greatest("_use.description", "_use.quantity", "_use.line_total")).when(F.col("_section") == "labour", 5).otherwise(6)
    rows = rows.withColumn("_need", need).select(*keys, "_table", "_use", "_need", "_section", F.posexplode(F.slice("_rows", 2, 1 << 30)).alias("_row", "_cells"))
    rows = rows.where((F.size("_cells") >= F.col("_need")) & (F.get("_cells", F.lit(0)) != ""))
    told = rows.select(*keys, "_table", "_row", "_section", *[F.coalesce(F.get("_cells", F.col(f"_use.{n}") - 1), F.lit("")).alias(f"_{n}") for n in places])
    number = lambda n: (F.col(f"_{n}") == "") | _decimal(F.col(f"_{n}")).isNotNull()
    told = told.where((F.col("_description") != "") & number("quantity") & number("unit_price") & _decimal(F.col("_line_total")).isNotNull())
    told = told.select(*keys, "_table", "_row", "_section", F.col("_description").alias("description"), F.nullif("_part_number", F.lit("")).alias("part_number"), _decimal(F.col("_quantity")).cast("decimal(20,4)").alias("quantity"), _money(F.col("_unit_price")).alias("_unit"), _money(F.col("_line_total")).alias("line_total"))
    derived = F.when(F.col("quantity") > 0, F.round(F.col("line_total") / F.col("quantity"), 2))
    told = told.withColumn("unit_price", F.coalesce("_unit", derived).cast("decimal(20,2)")).withColumn("vat_rate", F.lit(20).cast("decimal(20,4)"))
    told = told.withColumn("sequence_no", F.row_number().over(Window.partitionBy(*keys).orderBy("_table", "_row")))
    return _taxed(told, F.col("_section")).select(*keys, *LINE)


def heading_words(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), "[^a-z]+", " "))


def heading(token: Column) -> Column:
    """The section that a line without an amount opens by its `heading_words`, or null."""
    words = F.split(token, " ")
    first, n = F.get(words, F.lit(0)), F.size(words)
    table = F.array_contains(words, "parts") & F.arrays_overlap(words, F.array(*[F.lit(w) for w in PARTS_TABLE]))
    found = (
        F.when((first.isin("parts", "part") & (n <= 6)) | table, "parts").when((first == "labour") & (n <= 7), "labour")
        .when((first == "service") & (n <= 6), "service").when(token.isin(*LABOUR_HEADINGS), "labour")
    )
    return F.when(token != "", found)


def text_invoice_lines(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and the invoice lines of page texts, each page (keys) numbered from 1, under the latest heading above.

    A line has an amount and three letters in a row and is no total, tax, payment or condition. Its last amount is the total,
    the one before the unit price (else the total); their ratio is the quantity, if at most 50, else 1. What is left
    without amounts and numbers describes it and has three characters at least. Lines that speak of an MOT bear no VAT.
    """
    rows = pages.select(*keys, F.posexplode(F.split(F.coalesce(text, F.lit("")), _BREAKS)).alias("_no", "_raw")).withColumn("_line", quick_clean(F.col("_raw")))
    amounts = F.when(F.contains("_line", F.lit(".")), F.regexp_extract_all("_line", F.lit(MONEY), 1)).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("_amounts", amounts).withColumn("_lower", F.lower("_line"))
    priced = F.size("_amounts") > 0
    rows = rows.withColumn("_words", F.when(~priced, heading_words(F.col("_line")))).withColumn("_heading", heading(F.col("_words")))
    # What describes a line is made below the window, which no filter passes, so that it is made once.
    words = F.regexp_replace(F.regexp_replace("_line", MONEY, " "), r"(?U)\b\d+(?:\.\d+)?\b", " ")
    rows = rows.withColumn("_described", F.when(priced & ~_has(F.col("_lower"), NO_LINE) & F.regexp_like("_line", F.lit("[A-Za-z]{3}")), words)).withColumn("description", F.when(F.col("_described").isNotNull(), quick_clean(F.col("_described"))))
    rows = carry_section(rows.drop("_raw", "_line", "_words", "_described"), keys, "_no", "_heading").where(F.length("description") >= 3)
    rows = rows.withColumn("line_total", _money(F.element_at("_amounts", -1))).withColumn("unit_price", _money(F.when(F.size("_amounts") > 1, F.get("_amounts", F.size("_amounts") - 2)).otherwise(F.element_at("_amounts", -1))))
    sound = (F.col("unit_price") > 0) & (F.col("line_total") > 0) & (F.col("line_total") <= 50 * F.col("unit_price"))
    rows = rows.withColumn("quantity", F.when(sound, F.round(F.col("line_total") / F.nullif("unit_price", F.lit(0)), 4)).otherwise(1).cast("decimal(20,4)"))
    rows = rows.withColumn("vat_rate", F.when(F.contains("_lower", F.lit("mot")), 0).otherwise(20).cast("decimal(20,4)")).withColumn("part_number", F.lit(None).cast("string"))
    rows = rows.withColumn("sequence_no", F.row_number().over(Window.partitionBy(*keys).orderBy("_no")))
    return _taxed(rows, F.col("section")).select(*keys, *LINE)


def page_lines(pages: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """The lines of a page's tables; those of its text, if its tables give none."""
    found = table_lines(tables, keys)
    rest = pages.join(found.select(*keys).distinct(), keys, "left_anti")
    return found.unionByName(text_invoice_lines(rest, keys))


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def header_fields(invoices: DataFrame, text: str = "text") -> DataFrame:
    """invoices with invoice_number, invoice_date, registration, vin, vehicle_make, vehicle_model, engine_cc, mileage, supplier_vat_number, supplier_name, customer_name.

    A vehicle's row (registration, make and model, VIN, engine, mileage) goes before single fields; where there is none, a
    row of registration and make. Numbers and names that stand for none are null. Dates have the day first; years of two
    digits from 69 on are of the last century.
    """
    rows = invoices.withColumn("_lines", F.transform(F.split(F.coalesce(text, F.lit("")), _BREAKS), clean)).withColumn("_flat", clean(F.col(text)))
    line = lambda p: F.get(F.filter("_lines", lambda x: F.regexp_like(x, F.lit(p))), F.lit(0))
    rows = rows.withColumn("_long", line(VEHICLE)).withColumn("_short", F.when(F.col("_long").isNull(), line(SHORT_VEHICLE))).withColumn("_day", _first(F.col("_flat"), DATE))
    vehicle = lambda group: _first(F.col("_long"), VEHICLE, group)
    model = F.when(F.col("_long").isNotNull(), clean(vehicle(2))).when(F.col("_short").isNotNull(), clean(_first(F.col("_short"), SHORT_VEHICLE, 2)))
    flat = F.col("_flat")
    number = [_first(flat, p) for p in NUMBER]
    number = [F.when(~F.lower(n).isin("date", "name"), n) for n in number]
    parts = [F.regexp_extract("_day", r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4}|\d{2})$", g) for g in (1, 3, 4)]
    two = F.length(parts[2]) == 2
    century = F.when(two, F.when(parts[2] >= "69", "19").otherwise("20")).otherwise("")
    dashed = F.contains("_day", F.lit("-")) & two
    day = F.when((parts[0] != "") & ~dashed, F.try_to_date(F.concat_ws("-", F.concat(century, parts[2]), F.lpad(parts[1], 2, "0"), F.lpad(parts[0], 2, "0")), "yyyy-MM-dd"))
    whole = lambda c: F.regexp_replace(c, ",", "").try_cast("long")
    return rows.select(
        *invoices.columns, clean_identifier(F.coalesce(*number), "number").alias("invoice_number"), day.alias("invoice_date"),
        F.coalesce(F.upper(vehicle(1)), F.upper(_first(F.col("_short"), SHORT_VEHICLE)), F.trim(_first(flat, REGISTRATION))).alias("registration"),
        vehicle(3).alias("vin"), F.nullif(F.substring_index(model, " ", 1), F.lit("")).alias("vehicle_make"), F.nullif(F.regexp_replace(model, r"^\S* ?", ""), F.lit("")).alias("vehicle_model"), vehicle(4).cast("int").alias("engine_cc"),
        F.coalesce(whole(vehicle(5)), whole(_first(flat, MILEAGE))).alias("mileage"), F.trim(_first(flat, VAT_NUMBER)).alias("supplier_vat_number"),
        clean_identifier(line(SUPPLIER), "supplier").alias("supplier_name"), _first(flat, CUSTOMER).alias("customer_name"),
    )


def total_fields(invoices: DataFrame, text: str = "text") -> DataFrame:
    """invoices with labour, parts, subtotal, vat, non_vatable, gross (decimal pounds) and vat_rate (percent, 20 if not told).

    Each is the first amount behind its label, the gross the last one behind "Total". A missing subtotal is labour and parts.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    found = {n: _money(_first(body, rf"(?i){label}\s*[:£]?\s*([0-9][0-9,]*\.\d{{2}})")) for n, label in TOTALS.items()}
    rows = invoices.withColumns({n: c for n, c in found.items()} | {"gross": _money(F.try_element_at(F.regexp_extract_all(body, F.lit(GROSS), 1), F.lit(-1))), "vat_rate": F.coalesce(_first(body, VAT_RATE).try_cast("decimal(20,4)"), F.lit(20)).cast("decimal(20,4)")})
    zero = lambda c: F.coalesce(c, F.lit(0).cast("decimal(20,2)"))
    return rows.withColumn("subtotal", F.coalesce("subtotal", F.when(F.coalesce("labour", "parts").isNotNull(), (zero("labour") + zero("parts")).cast("decimal(20,2)"))))
