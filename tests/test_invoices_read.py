"""Invoices read from texts and tables: known invoices, and the rules one by one."""

import datetime as dt
from decimal import Decimal as D

import pytest

from pyspark.sql import functions as F

from repairbench.operators import invoices_read as R

NATIVE = """Sunny Garage Ltd
Customer One Invoice No: {number} Invoice Date: 7/3/24
VAT Registration No. 123 4567 89
Reg No Make / Model VIN Engine Mileage
{row}
Sub Total £{subtotal}
VAT (20%) {vat}
MOT {non_vat}
Total {gross}
"""


@pytest.mark.parametrize(
    ("number", "row", "registration", "mileage", "subtotal", "vat", "non_vat", "gross"),
    [
        ("90538", "KU65 EOK FORD FIESTA ZETEC WF0DXXGAKDFJ12345 998 100,340", "KU65 EOK", 100340, "486.03", "97.21", "54.85", "638.09"),
        ("91283", "PX64 XCU VAUXHALL CORSA W0L0SDL08E4012345 1229 56914", "PX64 XCU", 56914, "588.41", "117.68", "54.85", "760.94"),
    ],
)
def test_known_invoices(spark, number, row, registration, mileage, subtotal, vat, non_vat, gross):
    text = NATIVE.format(number=number, row=row, subtotal=subtotal, vat=vat, non_vat=non_vat, gross=gross)
    r = R.total_fields(R.header_fields(spark.createDataFrame([(text,)], "text string"))).first()
    assert (r.invoice_number, r.registration, r.mileage, r.invoice_date, r.supplier_name, r.supplier_vat_number) == (number, registration, mileage, dt.date(2024, 3, 7), "Sunny Garage Ltd", "123 4567 89")
    assert (r.subtotal, r.vat, r.non_vatable, r.gross, r.vat_rate) == (D(subtotal), D(vat), D(non_vat), D(gross), 20)


def test_fields_one_by_one(spark):
    texts = ["", None, "Invoice Date 31-12-1999 Registration: ab12 CDE Mileage 1,234", "Invoice Number: claim", "AB1 CD - Ford Focus ST\nInvoice #X-99/1", "Date 1/2-2024", "Date 30/02/2024", "Date 01-02-24", "Date 1/1/69", "VAT Registration AB1 C", "Labour 10.00\nParts: 2.50 Total 1.00 Sub Total: £9.00 TOTAL £ 13.00", "VAT (17.5%): 3.00"]
    rows = R.total_fields(R.header_fields(spark.createDataFrame(list(enumerate(texts)), "i int, text string"))).orderBy("i").collect()
    assert [rows[i].invoice_number for i in (0, 1, 2, 3, 4)] == [None, None, None, None, "X-99/1"]
    assert (rows[2].invoice_date, rows[2].registration, rows[2].mileage) == (dt.date(1999, 12, 31), "ab12 CDE", 1234)
    assert (rows[4].registration, rows[4].vehicle_make, rows[4].vehicle_model, rows[4].vin) == ("AB1 CD", "Ford", "Focus ST", None)
    assert [rows[i].invoice_date for i in (5, 6, 7, 8)] == [None, None, None, dt.date(1969, 1, 1)] and rows[9].registration is None
    assert (rows[10].subtotal, rows[10].gross, rows[10].labour, rows[10].parts) == (D("12.50"), D("13.00"), D("10.00"), D("2.50"))
    assert (rows[11].vat, rows[11].vat_rate, rows[0].subtotal) == (D("3.00"), D("17.5"), None)


def test_lines_of_a_text(spark):
    text = "Parts Qty Unit Price Total\n2 x Brake pads front £20.00 £40.00\nTotal parts 40.00\n\nLabour\r\nFit pads 45.50\nService of 1999 car 10.00 600.00\nMOT test 54.85\n12 34.00\nab 1.00\nPayment received 5.00\nwork performed\n█ Diagnose fault  1,000.00 2,500.00"
    rows = R.text_invoice_lines(spark.createDataFrame([(1, text), (2, None), (3, "no price")], "page int, text string"), ["page"]).orderBy("sequence_no").collect()
    got = [(r.description, r.item_kind, r.quantity, r.unit_price, r.line_total, r.vat_rate, r.gross_amount) for r in rows]
    assert got == [
        ("x Brake pads front", "part", 2, D("20.00"), D("40.00"), 20, D("48.00")), ("Fit pads", "labour", 1, D("45.50"), D("45.50"), 20, D("54.60")),
        ("Service of car", "labour", 1, D("10.00"), D("600.00"), 20, D("720.00")), ("MOT test", "labour", 1, D("54.85"), D("54.85"), 0, D("54.85")), ("Diagnose fault", "labour", D("2.5"), D("1000.00"), D("2500.00"), 20, D("3000.00")),
    ]
    assert [r.sequence_no for r in rows] == [1, 2, 3, 4, 5] and {r.page for r in rows} == {1}


def test_texts_are_cleaned_and_described_once(spark):
    texts = [None, "", "a", " £1.00 ", "a  b", "\ta", "a\n", "a\u000bb", "a\fb", "a\rb", "a\u00a0 b", "é  x", "█ a▏", "a\u2003b", "£ £", "\u00a0", "a\u001fb", "  "]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(R.clean(F.col("text")).alias("a"), R.quick_clean(F.col("text")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]
    plan = R.text_invoice_lines(spark.createDataFrame([(1, "Wiper 2.00")], "page int, text string"), ["page"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(?U)\b\d+") == 1


def test_lines_of_tables(spark):
    tables = [
        (1, 1, [["Item description", "Part No", "QTY", "Rate", "Line Total"], ["Oil filter", "OF-1", "2", "", "£30.00"], ["", "x", "1", "1", "1"], ["Odd", "", "one", "1", "2"], ["Short", "y"], ["No total", "", "1", "1", ""], ["Wiper", None, "", "5", "1,005.005"]]),
        (1, 2, [["Labour", "Hours", "Rate", "VAT", "Sub Total"], ["Fit filter", "1.5", "40", "z", "60.00"]]),
        (2, 1, [["Parts used", "No", "Number", "Each", "VAT", "Sub Total"], ["Bulb", "B1", "1", "3.10", "", "3.10"]]),
        (2, 2, [["Name", "Value"], ["a", "1"]]),
        (3, 1, None),
        (4, 1, []),
    ]
    df = spark.createDataFrame(tables, "page int, table_no int, cells array<array<string>>")
    got = [(r.page, r.sequence_no, r.description, r.part_number, r.quantity, r.unit_price, r.line_total, r.item_kind, r.unit) for r in R.table_lines(df, ["page"]).orderBy("page", "sequence_no").collect()]
    assert got == [
        (1, 1, "Oil filter", "OF-1", 2, D("15.00"), D("30.00"), "part", "each"), (1, 2, "Wiper", None, None, D("5.00"), D("1005.01"), "part", "each"),
        (1, 3, "Fit filter", None, D("1.5"), D("40.00"), D("60.00"), "labour", "hour"), (2, 1, "Bulb", "B1", 1, D("3.10"), D("3.10"), "part", "each"),
    ]
    pages = spark.createDataFrame([(1, "Other 1.00"), (3, "Tyre 50.00"), (9, "Seal kit 2.00")], "page int, text string")
    assert sorted((r.page, r.description) for r in R.page_lines(pages, df, ["page"]).collect()) == [(1, "Fit filter"), (1, "Oil filter"), (1, "Wiper"), (2, "Bulb"), (3, "Tyre"), (9, "Seal kit")]
