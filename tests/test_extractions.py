"""Extractions, evidence, vehicles and imports on small hand-made rows."""

import hashlib
import json

from pyspark.sql import functions as F

from repairbench.functions.text import evidence_hash
from repairbench.operators.checks import validate_invoices
from repairbench.operators.evidence import comparables, host_allowed, reject_known
from repairbench.operators.extractions import add_mot_line, apply_page_corrections, benchmarkable, bundle_allocations, merge_headers, merge_lines
from repairbench.operators.vehicles import lookup_vehicle, vehicle_label
from repairbench.sources.ingest import import_report

LINE = "invoice_ref long, sequence_no long, description string, total long, item_kind string, part_number string, quantity long"


def test_merge_lines_by_multiset(spark):
    p = spark.createDataFrame([(1, 1, "oil", 500, "unknown", None, None), (1, 2, "oil", 500, "part", None, 2), (1, 3, "free", 0, "part", None, None)], LINE)
    s = spark.createDataFrame([(1, 1, "oil", 500, "service", "A", 7), (1, 2, "oil", 500, "service", "B", 8), (1, 3, "oil", 500, "service", "C", 9), (1, 4, "free", 0, "labour", None, None), (2, 1, "x", 5, "part", None, 1)], LINE)
    got = sorted(tuple(r) for r in merge_lines(p, s).collect())
    assert got == [
        (1, 1, "oil", 500, "service", "A", 7, "primary"), (1, 2, "oil", 500, "part", "B", 2, "primary"),
        (1, 3, "oil", 500, "service", "C", 9, "secondary"), (1, 4, "free", 0, "labour", None, None, "secondary"), (2, 1, "x", 5, "part", None, 1, "secondary"),
    ]
    fallback = sorted((r.invoice_ref, r.description, r.origin) for r in merge_lines(p, s, take_lines=False).collect())
    assert fallback == [(1, "oil", "primary"), (1, "oil", "primary"), (2, "x", "secondary")]
    heads = merge_headers(spark.createDataFrame([(1, "", None), (2, "n", 4)], "invoice_ref long, number string, gross long"), spark.createDataFrame([(1, "m", 9), (2, "k", 5)], "invoice_ref long, number string, gross long"))
    assert sorted(tuple(r) for r in heads.collect()) == [(1, "m", 9), (2, "n", 4)]


def test_filters_and_corrections(spark):
    lines = spark.createDataFrame([(1, 1, "pads", 5, "Part", None, 1), (2, 1, "work", 5, "labour", None, 1), (3, 1, "x", 5, "labour", "P1", 1), (4, 1, " ", 5, "part", None, 1), (5, 1, "pads", None, "part", None, 1)], LINE)
    assert sorted(r.invoice_ref for r in benchmarkable(spark.range(1, 7).select(F.col("id").alias("invoice_ref")), lines).collect()) == [1, 3]
    mot = spark.createDataFrame([(1, 1, "mot test", "service", 5485, 0), (2, 1, "pads", "part", 100, 20)], "invoice_ref long, sequence_no long, description string, item_kind string, total long, vat_rate int")
    totals = spark.createDataFrame([(1, 5485), (2, 5485), (3, None)], "invoice_ref long, exempt long")
    assert sorted(tuple(r) for r in add_mot_line(totals, mot).collect())[-1] == (2, 2, "mot test", "service", 5485, 0) and add_mot_line(totals, mot).count() == 3
    pages = spark.createDataFrame([(1, 1, "invoice", 0, "g", 0.9), (1, 2, "invoice", 0, "g", 0.5), (1, 3, "letter", 0, "g", 0.9)], "document_id long, page_number int, page_type string, rotation int, group_key string, confidence double")
    fixes = spark.createDataFrame([(1, 1, "estimate", 90, None)], "document_id long, page_number int, page_type string, rotation int, group_key string")
    got = [(r.page_type, r.rotation, r.group_key, r.review_status) for r in apply_page_corrections(pages, fixes, ["invoice", "estimate", "other"]).orderBy("page_number").collect()]
    assert got == [("estimate", 90, "g", "corrected"), ("invoice", 0, "g", "needs_review"), ("other", 0, "g", "pending")]


def test_bundles(spark):
    lines = spark.createDataFrame([(i, 100) for i in range(5)], "line_id long, billed long")
    parts = [(0, 60), (0, 40), (1, 60), (1, None), (2, None), (2, None), (3, 100), (4, 60), (4, 50)]
    got = {r.line_id: r.state for r in bundle_allocations(lines, spark.createDataFrame(parts, "line_id long, allocated long")).collect()}
    assert got == {0: "resolved", 1: "partly_allocated", 2: "unresolved", 3: "too_few_components", 4: "sum_differs"}


def test_hosts_hashes_and_known_identities(spark):
    rows = spark.createDataFrame([(h,) for h in ("a.b.example.org", "example.org", "badexample.org", "Shop.example.net.", "x.shop.example.net", "", None)], "host string")
    patterns = spark.createDataFrame([("*.example.org",), ("shop.example.net",), ("*",)], "pattern string")
    assert {r.host: r.allowed for r in host_allowed(rows, patterns).collect()} == {"a.b.example.org": True, "example.org": True, "badexample.org": False, "Shop.example.net.": True, "x.shop.example.net": False, "": False, None: False}
    one = spark.range(1).select(evidence_hash(*[F.lit(x) for x in ("HTTPS://A.com", None, "Oil-Filter", "The price", "a-1", "12.5", None, "gbp", "net", "each", None)]).alias("h")).first().h
    want = {"source_uri": "https://a.com/", "source_record_id": None, "title": "oil filter", "minimal_excerpt": "the price", "part_number": "a1", "price_net": "12.50", "original_price": None, "currency": "GBP", "vat_basis": "net", "unit": "each", "fitment": None}
    assert one == hashlib.sha256(json.dumps(want, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), (None, None)], "identity string, content_hash string")
    items = spark.createDataFrame([("a", "approved"), ("d", "provisional")], "identity string, status string")
    got = reject_known(new, items, spark.createDataFrame([("b",)], "identity string"), spark.createDataFrame([("3",)], "content_hash string"))
    assert {r.identity: r.rejected for r in got.collect()} == {"a": "ONTOLOGY_ITEM_ALREADY_APPROVED", "b": "RESEARCH_IDENTITY_ALREADY_OPEN", "c": "EVIDENCE_CONTENT_ALREADY_RESEARCHED", "d": None, None: None}


def test_vehicles(spark):
    catalogue = spark.createDataFrame(
        [(1, "Ford", "Fiesta", [], "6-10", None, "Small"), (2, "Vauxhall", "Corsa", ["Adam Glam"], "6-10", "Hatchback", "Small"), (3, "Volkswagen", "Polo", [], "11-15", None, "Family"), (4, "BMW", "3 Series", ["320d"], "26-30", "Saloon", "Large")],
        "position int, make string, model string, aliases array<string>, group_range string, body_type string, group_category string",
    )
    cars = [("Ford", "Fiesta 1.0 Zetec"), ("Vauxhall", "Adam Glam"), ("VW", "Polo 1.0 TSI"), ("BMW", "320d Sport"), ("Acme", "One"), (None, None)]
    rows = spark.createDataFrame([(*c, None, None, None, None) for c in cars] + [("Ford", "Fiesta 1.0 Zetec", "N1", None, None, "register")], "make string, model string, official string, bodywork string, segment string, source string")
    found = {(r.make, r.model): (r.group_range, r.match_status) for r in lookup_vehicle(rows, catalogue).collect() if r.make}
    assert found[cars[0]] == ("6-10", "model_family") and found[cars[1]] == ("6-10", "alias") and found[cars[2]][0] == "11-15" and found[cars[3]] == ("26-30", "alias_family") and found[cars[4]] == (None, "manual_review")
    labels = sorted((str(r.make), r.vehicle_label) for r in vehicle_label(rows, catalogue).collect())
    assert labels == [("Acme", "Unclassified"), ("BMW", "Saloon"), ("Ford", "Insurance group 6-10 \u2014 Small"), ("Ford", "N1 Light Commercial Vehicle (LCV)"), ("None", "Unclassified"), ("VW", "Insurance group 11-15 \u2014 Family"), ("Vauxhall", "Hatchback")]


def test_report_comparables_and_missing_values(spark):
    items = spark.createDataFrame([(1.0,), (None,)], "reference_price double")
    history = spark.createDataFrame([("invoice",), ("invoice",), ("estimate",), (None,)], "document_role string")
    gold = spark.createDataFrame([("a",), ("a",), ("b",)], "invoice_number string")
    assert tuple(import_report(items, history, gold).first()) == (2, 1, 1, 4, 2, 1, 3, 2)
    pairs = spark.sql("""SELECT 1 AS line_id, id AS obs_id, DATE '2024-01-01' AS as_of, CASE id WHEN 0 THEN DATE '2020-12-31' WHEN 1 THEN DATE '2021-01-01' ELSE DATE '2024-01-01' END AS observed_at, 'Invoice' AS document_type,
        true AS eligible, true AS unit_compatible, true AS scope_equivalent, CAST(1 AS decimal(10,4)) AS comparability, CAST(CASE id WHEN 0 THEN 100 END AS long) AS total, CAST(7 AS long) AS unit, CAST(2 AS decimal(20,4)) AS quantity FROM range(3)""")
    assert sorted((r.obs_id, r.original or 0, r.normalised, r.stale) for r in comparables(pairs).collect()) == [(0, 100, 100, True), (1, 0, 14, False)]
    invoices = spark.createDataFrame([("i", None, None, 100, 20, None, None, 120)], "invoice_ref string, labour long, parts long, subtotal long, vat_rate int, vat long, exempt long, gross long")
    lines = spark.createDataFrame([("i", 100, "part", True)], "invoice_ref string, billed long, kind string, vatable boolean")
    assert sorted((r.code, r.status) for r in validate_invoices(invoices, lines).collect()) == [("MISSING_VALUE", "not_applicable")] * 4 + [("SUBTOTAL_MISMATCH", "pass")]
