"""Assessment reports and invoices read from page texts that the order tables make; the SQL reads the same texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from repairbench.functions.exact import pence
from repairbench.operators import invoices_read as I
from repairbench.operators import reports_read as R

from .binding import table
from .registered import register

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = register(QUERIES, ORACLES)

#: One page for the head of an order's report and one for each of its lines, in SQL that both engines read.
HEAD = """concat(CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE concat('Assessment Number: A-', o_orderkey, chr(10)) END, 'Claim Reference', chr(10), '  CL-', o_custkey, chr(10),
 'Created: ', {day}, chr(10), 'registration : AB', o_custkey, ' XY', chr(10), 'Manufacturer: ', o_orderpriority, chr(10), 'Odometer:', chr(10), '1', o_custkey % 10, ',', 100 + o_custkey % 900, ' miles', chr(10),
 'Damage Areas: front, ', o_orderstatus, ' ,, rear', chr(10), 'Labour Rate: £4', o_orderkey % 10, '.50', chr(10), 'VAT Rate: 20.0%', chr(10), 'Grand Total Excl VAT', chr(10), '1,', 100 + o_orderkey % 900, '.2', chr(10),
 CASE WHEN o_orderkey % 11 = 0 THEN 'VAT : -' ELSE concat('VAT: £', o_orderkey % 500, '.5') END, chr(10), CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('Grand Total Incl VAT: ', CAST(o_totalprice AS DECIMAL(20, 2))) END)"""
BODY = """concat('Repairs', chr(10), CASE WHEN l_partkey % 17 = 0 THEN 'OP|short|row' ELSE concat(' op|', l_returnflag, '|', CASE WHEN l_partkey % 3 = 0 THEN '' ELSE concat('C', l_partkey) END, '| ', concat('Part ', l_linenumber), ' |10|',
 CASE WHEN l_suppkey % 4 = 0 THEN 'N/A' ELSE '1.5' END, '|', CAST(l_quantity AS INT), '|-|£', CAST(l_extendedprice AS DECIMAL(20, 2))) END)"""


def _pages(spark, sf_dir):
    order, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    head = order.select(F.col("o_orderkey").alias("document_id"), F.lit(0).alias("page_number"), F.expr(HEAD.format(day="date_format(o_orderdate, 'dd/MM/yyyy')")).alias("text"))
    return head.unionByName(line.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("int").alias("page_number"), F.expr(BODY).alias("text")))


PAGES = f"""WITH pages AS (SELECT o_orderkey AS document_id, 0 AS page_number, {HEAD.format(day="strftime(o_orderdate, '%d/%m/%Y')")} AS text FROM orders
 UNION ALL SELECT l_orderkey, l_linenumber, {BODY} FROM lineitem),
ops AS (SELECT *, string_split(line, '|') AS p FROM (SELECT document_id, page_number, unnest(string_split(text, chr(10))) AS line FROM pages) WHERE upper(trim(line)) LIKE 'OP|%' AND len(string_split(line, '|')) = 9)
"""
_joined = reduce(lambda c, f: rf"regexp_replace({c}, '(?im)^({f[0]})[ \t]*\n[ \t]*([^\n]+)$', '\1: \2', 'g')", R.FIELDS, "string_agg(text, chr(10) ORDER BY page_number, text)")
_found = {name: rf"nullif(trim(regexp_extract(t, '(?im){label}\s*:\s*{R.VALUES[kind]}', 1)), '')" for label, name, kind in R.FIELDS}
_number = "TRY_CAST(replace(replace({}, ',', ''), '£', '') AS DECIMAL(20,4))"


@query(PAGES + f""", docs AS (SELECT document_id, {_joined} AS t FROM pages GROUP BY 1),
f AS (SELECT document_id, {', '.join(f'{v} AS {k}' for k, v in _found.items())} FROM docs),
v AS (SELECT f.* REPLACE ({', '.join(f'{_number.format(name)} AS {name}' for _, name, kind in R.FIELDS if kind in ('money', 'percent'))}), coalesce(n, 0) AS operations FROM f LEFT JOIN (SELECT document_id, count(*) AS n FROM ops GROUP BY 1) o USING (document_id)),
g AS (SELECT v.* REPLACE (coalesce(gross_total, subtotal_net + vat_total) AS gross_total) FROM v)
SELECT document_id, assessment_number, claim_reference, registration, vehicle_make, strptime(created_date, '%d/%m/%Y')::DATE AS created_date, replace(mileage, ',', '')::BIGINT AS mileage,
 array_to_string(list_filter(list_transform(string_split(damage_areas, ','), lambda x: trim(x)), lambda x: x <> ''), ',') AS damage_areas, labour_rate::DOUBLE AS labour_rate, vat_rate::DOUBLE AS vat_rate, subtotal_net::DOUBLE AS subtotal_net,
 vat_total::DOUBLE AS vat_total, gross_total::DOUBLE AS gross_total, operations, least(70 + 5 * ((assessment_number IS NOT NULL)::INT + (claim_reference IS NOT NULL)::INT + (registration IS NOT NULL)::INT + (gross_total IS NOT NULL)::INT) + 2 * least(operations, 5), 99) AS confidence,
 CASE WHEN assessment_number IS NULL OR operations = 0 THEN 'missing_identifier_or_operations' END AS error FROM g""")
def x7_assessment_reports(spark, sf_dir):
    rows = R.parse_assessments(_pages(spark, sf_dir))
    money = [F.col(c).cast("double").alias(c) for c in ("labour_rate", "vat_rate", "subtotal_net", "vat_total", "gross_total")]
    return rows.select("document_id", "assessment_number", "claim_reference", "registration", "vehicle_make", "created_date", "mileage", F.array_join("damage_areas", ",").alias("damage_areas"), *money, F.col("operations").cast("long").alias("operations"), F.col("confidence").cast("long").alias("confidence"), "error")


@query(PAGES + """SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number, line) AS sequence_no, lower(trim(p[2])) AS category, nullif(trim(p[3]), '') AS code, trim(p[4]) AS description,
 """ + ", ".join(f"{_number.format(f'trim(p[{i}])')}::DOUBLE AS {name}" for i, name in enumerate(("work_units", "hours", "quantity", "unit_price", "total"), 5)) + ", page_number FROM ops")
def x7_report_operations(spark, sf_dir):
    rows = R.report_operations(_pages(spark, sf_dir))
    return rows.select("document_id", F.col("sequence_no").cast("long").alias("sequence_no"), "category", "code", "description", *[F.col(c).cast("double").alias(c) for c in ("work_units", "hours", "quantity", "unit_price", "total")], "page_number")


#: Invoices made of orders, their shapes chosen by a digest, in SQL that both engines read.
_SHAPE = "md5(CAST({key} AS STRING))"
INVOICE = """concat(CASE WHEN substring(h, 1, 1) < '6' THEN concat('Customer ', o_custkey, ' Service Garage ', chr(10)) WHEN substring(h, 1, 1) < 'a' THEN concat('Unit 4', chr(10), '  North  MOT Centre', chr(10)) ELSE '' END,
 CASE WHEN substring(h, 2, 1) < '8' THEN concat('Invoice No: INV/', o_orderkey) WHEN substring(h, 2, 1) < 'b' THEN concat('SALES Invoice Date ', chr(10), 'Invoice No ', o_orderkey) WHEN substring(h, 2, 1) < 'd' THEN 'Invoice Number unknown' ELSE 'Receipt' END, chr(10),
 CASE WHEN substring(h, 3, 1) < '8' THEN concat('Date of Work: ', {day}) WHEN substring(h, 3, 1) < 'c' THEN concat('date ', {short}) ELSE 'undated' END, chr(10), 'VAT Reg No. 12', o_custkey % 10, ' 4567 8', o_orderkey % 10, chr(10),
 CASE WHEN substring(h, 4, 1) < '6' THEN concat('ab', o_custkey % 90 + 10, ' cde  Ford  Focus ST  WF0DXXGAKDFJ', o_orderkey % 90000 + 10000, ' 998 1', o_custkey % 10, ',', o_orderkey % 900 + 100) WHEN substring(h, 4, 1) < 'a' THEN concat('AB', o_custkey % 90 + 10, ' CDE - Skoda Octavia')
  ELSE concat('VAT Registration AA1 A Registration : XY', o_custkey % 90 + 10, ' ZZZ Mileage: ', o_orderkey % 9000 + 1000) END, chr(10),
 CASE WHEN substring(h, 5, 1) < '8' THEN concat('Labour ', o_orderkey % 500, '.50', chr(10)) ELSE '' END, CASE WHEN substring(h, 6, 1) < '8' THEN concat('Parts:', chr(10), '1,', o_custkey % 900 + 100, '.25', chr(10)) ELSE '' END,
 CASE WHEN substring(h, 7, 1) < '8' THEN concat('Sub Total £', o_orderkey % 700, '.75', chr(10)) ELSE '' END, CASE WHEN substring(h, 8, 1) < 'a' THEN concat('VAT (17.5%) ', o_orderkey % 90, '.05', chr(10)) ELSE concat('VAT: ', chr(10), o_orderkey % 90, '.15', chr(10)) END,
 CASE WHEN substring(h, 9, 1) < '4' THEN concat('MOT 54.', o_custkey % 90 + 10, chr(10)) ELSE '' END, 'Total paid 1.00', chr(10), CASE WHEN substring(h, 10, 1) < 'c' THEN concat('TOTAL: £ ', CAST(o_totalprice AS DECIMAL(20, 2))) ELSE '' END)"""
_INVOICES = "SELECT o_orderkey, " + INVOICE + " AS text FROM (SELECT *, " + _SHAPE.format(key="o_orderkey") + " AS h FROM orders) shaped"


def _invoices(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("h", F.expr(_SHAPE.format(key="o_orderkey")))
    return orders.select("o_orderkey", F.expr(INVOICE.format(day="date_format(o_orderdate, 'd/M/yyyy')", short="date_format(o_orderdate, 'dd/MM/yy')")).alias("text"))


_TEXTS = _INVOICES.format(day="strftime(o_orderdate, '%-d/%-m/%Y')", short="strftime(o_orderdate, '%d/%m/%y')")


@query(f"""WITH t AS ({_TEXTS}), f AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS rows FROM t),
v AS (SELECT *, list_filter(rows, lambda x: regexp_matches(x, '^(?i:ab)\\d\\d (?i:cde) [A-Z].* WF0')) AS long, list_filter(rows, lambda x: regexp_matches(x, '^AB\\d\\d CDE - ')) AS short, list_filter(rows, lambda x: regexp_matches(lower(x), 'garage|mot centre'))[1] AS supplier,
  regexp_extract(flat, '(?i)(?:date of work|date)\\s*:?\\s*(\\d+/\\d+/\\d+)', 1) AS day, CASE WHEN contains(flat, 'INV/') THEN regexp_extract(flat, 'INV/\\d+') WHEN contains(flat, 'SALES Invoice') THEN regexp_extract(flat, 'Invoice No (\\d+)', 1) END AS invoice_number FROM f)
SELECT o_orderkey, invoice_number, CASE WHEN day <> '' THEN make_date(CASE WHEN length(string_split(day, '/')[3]) = 4 THEN string_split(day, '/')[3]::BIGINT WHEN string_split(day, '/')[3] >= '69' THEN 1900 + string_split(day, '/')[3]::BIGINT ELSE 2000 + string_split(day, '/')[3]::BIGINT END, string_split(day, '/')[2]::BIGINT, string_split(day, '/')[1]::BIGINT) END AS invoice_date,
 CASE WHEN len(long) > 0 THEN upper(left(long[1], 8)) WHEN len(short) > 0 THEN left(short[1], 8) ELSE regexp_extract(flat, 'XY\\d\\d ZZZ') END AS registration, CASE WHEN len(long) > 0 THEN regexp_extract(long[1], 'WF0\\w+') END AS vin,
 CASE WHEN len(long) > 0 THEN 'Ford' WHEN len(short) > 0 THEN 'Skoda' END AS vehicle_make, CASE WHEN len(long) > 0 THEN 'Focus ST' WHEN len(short) > 0 THEN 'Octavia' END AS vehicle_model, CASE WHEN len(long) > 0 THEN 998 END AS engine_cc,
 CASE WHEN len(long) > 0 THEN replace(string_split(long[1], ' ')[-1], ',', '')::BIGINT WHEN contains(flat, 'Mileage') THEN regexp_extract(flat, 'Mileage: (\\d+)', 1)::BIGINT END AS mileage, regexp_extract(flat, 'No. (12\\d 4567 8\\d)', 1) AS supplier_vat_number, supplier AS supplier_name FROM v""")
def x6_header_fields(spark, sf_dir):
    rows = I.header_fields(_invoices(spark, sf_dir))
    return rows.select("o_orderkey", "invoice_number", "invoice_date", "registration", "vin", "vehicle_make", "vehicle_model", "engine_cc", "mileage", "supplier_vat_number", "supplier_name")


@query(f"""WITH t AS ({_TEXTS}), r AS (SELECT o_orderkey, unnest(list_filter(string_split(regexp_replace(text, ':\\s*\\n', ': ', 'g'), chr(10)), lambda x: regexp_matches(x, '\\.\\d\\d$'))) AS row FROM t),
a AS (SELECT o_orderkey, row, round(replace(regexp_extract(row, '[\\d,]+\\.\\d\\d$'), ',', '')::DECIMAL(20, 2) * 100)::BIGINT AS p FROM r),
s AS (SELECT o_orderkey, max(p) FILTER (row LIKE 'Labour%') AS labour, max(p) FILTER (row LIKE 'Parts%') AS parts, max(p) FILTER (row LIKE 'VAT%') AS vat, max(p) FILTER (row LIKE 'MOT%') AS non_vatable, max(p) FILTER (row LIKE 'TOTAL%') AS gross,
  bool_or(row LIKE 'VAT (17%') AS told FROM a GROUP BY 1)
SELECT t.o_orderkey, labour, parts, CASE WHEN labour IS NOT NULL OR parts IS NOT NULL THEN coalesce(labour, 0) + coalesce(parts, 0) END AS derived, CASE WHEN regexp_matches(text, 'Sub Total') THEN regexp_extract(text, 'Sub Total £(\\d+)', 1)::BIGINT * 100 + 75 ELSE derived END AS subtotal, vat, non_vatable,
 coalesce(gross, CASE WHEN contains(text, 'Sub Total') THEN regexp_extract(text, 'Sub Total £(\\d+)', 1)::BIGINT * 100 + 75 END) AS gross, CASE WHEN told THEN 17.5 ELSE 20.0 END::DOUBLE AS vat_rate FROM t LEFT JOIN s USING (o_orderkey)""".replace(" AS derived, CASE WHEN regexp", " AS derived_sum, CASE WHEN regexp").replace("ELSE derived END", "ELSE derived_sum END"))
def x6_total_fields(spark, sf_dir):
    """A labour and parts sum stands beside the subtotal; an amount behind Sub Total is also one behind Total."""
    rows = I.total_fields(_invoices(spark, sf_dir))
    zero = lambda c: F.coalesce(pence(F.col(c)), F.lit(0))
    whole = F.when(F.coalesce("labour", "parts").isNotNull(), zero("labour") + zero("parts"))
    return rows.select("o_orderkey", *[pence(F.col(c)).alias(c) for c in ("labour", "parts", "subtotal", "vat", "non_vatable", "gross")], whole.alias("derived_sum"), F.col("vat_rate").cast("double").alias("vat_rate"))


#: Lines of invoice pages, headings and other rows among them; their shapes are chosen by a digest.
ROW = """concat(CASE WHEN substring(h, 1, 1) < '2' THEN concat('Parts  Qty Unit Total', chr(10)) WHEN substring(h, 1, 1) < '5' THEN concat('LABOUR:', chr(10)) WHEN substring(h, 1, 1) = '5' THEN concat('Service items', chr(10)) ELSE '' END,
 CASE WHEN substring(h, 2, 1) < '8' THEN concat(p_name, ' ', CAST(l_quantity AS INT), ' £', CAST(p_retailprice AS DECIMAL(20, 2)), '  £ ', CAST(l_extendedprice AS DECIMAL(20, 2))) WHEN substring(h, 2, 1) < 'b' THEN concat('Replace ', p_name, ' 1,0', CAST(l_tax * 100 + 10 AS INT), '.50')
 WHEN substring(h, 2, 1) = 'b' THEN concat('Annual MOT check ', CAST(l_tax * 100 + 40 AS INT), '.85') WHEN substring(h, 2, 1) = 'c' THEN concat('Subtotal ', CAST(l_extendedprice AS DECIMAL(20, 2))) WHEN substring(h, 2, 1) = 'd' THEN p_name WHEN substring(h, 2, 1) = 'e' THEN '12 34.00' ELSE 'Card payment 9.99' END)"""
_LINES = """SELECT l_orderkey AS page, concat(l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(l_extendedprice AS DECIMAL(20, 2))) AS k, {row} AS line FROM (SELECT *, md5(concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)) AS h FROM {lines} JOIN {part} ON l_partkey = p_partkey) shaped"""
_PAGES = f"SELECT page, string_agg(line, chr(10) ORDER BY k, line) AS text FROM ({_LINES.format(row=ROW, lines='lineitem', part='part')}) GROUP BY page"


def _line_pages(spark, sf_dir):
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    shaped = line.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("h", F.expr("md5(concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey))"))
    rows = shaped.select(F.col("l_orderkey").alias("page"), F.expr("concat(l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(l_extendedprice AS DECIMAL(20, 2)))").alias("k"), F.expr(ROW).alias("line"))
    return rows.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("text"))


@query(f"""WITH p AS ({_PAGES}), r AS (SELECT page, i, rows[i] AS row FROM (SELECT page, string_split(text, chr(10)) AS rows FROM p), range(1, 1000) t(i) WHERE i <= len(rows)),
s AS (SELECT *, last_value(CASE WHEN row LIKE 'Parts  %' THEN 'parts' WHEN row = 'LABOUR:' THEN 'labour' WHEN row = 'Service items' THEN 'service' END IGNORE NULLS) OVER (PARTITION BY page ORDER BY i ROWS UNBOUNDED PRECEDING) AS section,
  list_transform(regexp_extract_all(row, '[\\d,]+\\.\\d\\d'), lambda x: (replace(x, ',', '')::DECIMAL(20, 2) * 100)::BIGINT) AS money FROM r),
g AS (SELECT page, i, row, coalesce(section, 'unknown') AS section, money[-1] AS total, CASE WHEN len(money) > 1 THEN money[-2] ELSE money[-1] END AS unit_cost FROM s WHERE len(money) > 0 AND row NOT LIKE 'Subtotal%' AND row NOT LIKE '12 %' AND row NOT LIKE 'Card payment%')
SELECT page, row_number() OVER (PARTITION BY page ORDER BY i) AS sequence_no, CASE WHEN row LIKE 'Annual MOT%' THEN 'Annual MOT check' ELSE regexp_extract(row, '^[^\\d£]*[a-z]') END AS description,
 CASE WHEN section = 'labour' OR row LIKE 'Replace %' THEN 'labour' WHEN section = 'service' THEN 'service' WHEN section = 'parts' THEN 'part' ELSE 'unknown' END AS item_kind, unit_cost, total,
 CASE WHEN total <= 50 * unit_cost THEN (total * 20000 + unit_cost) // (2 * unit_cost) ELSE 10000 END AS quantity, CASE WHEN row LIKE '%MOT%' THEN total ELSE total + (2 * total + 5) // 10 END AS gross FROM g""")
def x3_text_lines(spark, sf_dir):
    """quantity in ten-thousandths, money in pence; a unit price beyond the total still gives a part of one."""
    rows = I.text_invoice_lines(_line_pages(spark, sf_dir), ["page"])
    return rows.select("page", "sequence_no", "description", "item_kind", pence(F.col("unit_price")).alias("unit_cost"), pence(F.col("line_total")).alias("total"), (F.col("quantity") * 10000).cast("long").alias("quantity"), pence(F.col("gross_amount")).alias("gross"))


def _tables(spark, sf_dir):
    """Two tables an order: its lines of even parts under chosen headers, those of odd parts by place."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    cents = lambda c: F.col(c).cast("decimal(20,2)").cast("string")
    text, empty = (lambda c: F.col(c).cast("string")), F.lit("")
    quantity, kind = F.col("l_quantity").cast("int"), F.col("l_orderkey") % 3
    generic = F.when(kind == 0, F.array("p_name", F.when(quantity % 9 != 0, quantity.cast("string")).otherwise("n/a"), F.when(quantity % 4 != 0, F.concat(F.lit("£"), F.round(F.col("l_extendedprice").cast("decimal(20,2)") / F.col("l_quantity").cast("decimal(20,4)"), 2).cast("decimal(20,2)").cast("string"))).otherwise(empty), cents("l_extendedprice"), text("l_partkey")))
    generic = generic.otherwise(F.array(text("l_partkey"), F.when(quantity % 8 != 0, quantity.cast("string")).otherwise(empty), F.concat(F.lit(" █ "), F.col("p_name"), F.lit("\n")), F.when(quantity % 11 != 0, cents("l_extendedprice")).otherwise(empty)))
    placed = F.when(kind == 1, F.array("p_name", text("l_partkey"), quantity.cast("string"), empty, F.lit("20%"), cents("l_extendedprice"))).when(kind == 2, F.array("p_name", quantity.cast("string"), F.lit("40.00"), F.lit("x"), cents("l_extendedprice"))).otherwise(F.array("p_name", text("l_partkey"), F.lit("1")))
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", (F.col("l_partkey") % 2).alias("table_no"), F.struct("l_linenumber", "l_partkey", "l_suppkey", cents("l_extendedprice").alias("x")).alias("k"), F.when(F.col("l_partkey") % 2 == 0, generic).otherwise(placed).alias("row"))
    heads = {(0, 0): ["Item Description", "QTY", "Unit  Price", "Line Total", "Part No."], (0, 1): ["Part Number", "Quantity", "Operation", "Total"], (0, 2): ["Part Number", "Quantity", "Operation", "Total"], (1, 0): ["Parts", "No", "Pieces", "Each", "VAT", "Sub Total"], (1, 1): ["Parts", "No", "Pieces", "Each", "VAT", "Sub Total"], (1, 2): ["Labour", "Hours", "", "VAT", "Sub Total"]}
    head = F.coalesce(*[F.when((F.col("table_no") == t) & (F.col("page") % 3 == m), F.array(*[F.lit(x) for x in h])) for (t, m), h in heads.items()])
    grouped = rows.groupBy(F.col("l_orderkey").alias("page"), "table_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "row"))), lambda x: x["row"]).alias("rows"))
    return grouped.select("page", "table_no", F.concat(F.array(head), "rows").alias("cells"))


@query("""WITH l AS (SELECT *, l_orderkey % 3 AS kind, l_partkey % 2 AS t, l_quantity::BIGINT AS q, (l_extendedprice::DECIMAL(20,2) * 100)::BIGINT AS total FROM lineitem JOIN part ON l_partkey = p_partkey),
k AS (SELECT *, CASE WHEN t = 0 AND kind = 0 THEN q % 9 <> 0 WHEN t = 0 THEN q % 11 <> 0 ELSE kind <> 0 END AS kept, CASE WHEN t = 0 AND kind > 0 AND q % 8 = 0 THEN NULL ELSE q END AS quantity,
  CASE WHEN t = 1 AND kind = 2 THEN 4000 WHEN t = 0 AND kind > 0 AND q % 8 = 0 THEN NULL ELSE (2 * total + q) // (2 * q) END AS unit_cost, CASE WHEN t = 0 OR kind = 1 THEN l_partkey::VARCHAR END AS part_number FROM l)
SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY t, l_linenumber, l_partkey, l_suppkey, l_extendedprice::DECIMAL(20,2)::VARCHAR) AS sequence_no, p_name AS description, part_number, quantity, unit_cost, total, t = 1 AND kind = 2 AS labour FROM k WHERE kept""")
def x4_table_lines(spark, sf_dir):
    rows = I.table_lines(_tables(spark, sf_dir), ["page"])
    return rows.select("page", "sequence_no", "description", "part_number", F.col("quantity").cast("long").alias("quantity"), pence(F.col("unit_price")).alias("unit_cost"), pence(F.col("line_total")).alias("total"), (F.col("item_kind") == "labour").alias("labour"))
