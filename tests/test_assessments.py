"""Reports of engineers, and their operations against invoice lines."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from repairbench.operators.assessments import match_operations, match_score, pair_assessments
from repairbench.operators.reports_read import parse_assessments, report_operations

HEAD = "Assessment Number: A-1\nClaim Reference\n  CL 9 \nCreated: 05/03/2024\nDate of Incident: 2024-02-30\nRegistration : AB12 CDE\nOdometer: 12,345 miles\nDamage Areas: front,, rear left\nGrand Total Excl VAT\n£1,200.50\nVAT: 240.10"


def test_report_fields_and_operations(spark):
    pages = [(1, 1, HEAD), (1, 2, "OP|Labour|L1| Remove bumper |10|1.5|-|N/A|£1,060.00\r\nop|PART||Bumper|||2|50|100\nOP|too|short"), (2, 1, None), (3, 1, "Assessment Number: A-3")]
    docs = {r.document_id: r for r in parse_assessments(spark.createDataFrame(pages, "document_id long, page_number int, text string")).collect()}
    one = docs[1]
    assert (one.assessment_number, one.claim_reference, one.registration, one.mileage) == ("A-1", "CL 9", "AB12 CDE", 12345)
    assert (one.created_date, one.incident_date, one.damage_areas) == (datetime.date(2024, 3, 5), None, ["front", "rear left"])
    assert (float(one.subtotal_net), float(one.vat_total), float(one.gross_total)) == (1200.5, 240.1, 1440.6)
    assert (one.operations, one.confidence, one.error) == (2, 94, None)
    assert docs[2].error == docs[3].error == "missing_identifier_or_operations" and docs[2].confidence == 70
    ops = report_operations(spark.createDataFrame(pages, "document_id long, page_number int, text string")).orderBy("sequence_no").collect()
    assert [(o.sequence_no, o.category, o.code, o.description) for o in ops] == [(1, "labour", "L1", "Remove bumper"), (2, "part", None, "Bumper")]
    assert ops[0].quantity is None and float(ops[0].total) == 1060 and float(ops[1].unit_price) == 50


def test_operations_are_matched_in_their_order(spark):
    ops = spark.createDataFrame([(1, "op-10", 10, "front door paint"), (1, "op-2", 2, "front door paint")], "group_id long, op_id string, op_no int, description string")
    lines = spark.createDataFrame([(1, "b", 1, "front door"), (1, "a", 2, "front door paint"), (1, "c", 3, "mirror")], "group_id long, line_id string, line_no int, description string")
    found = {r.op_id: (r.line_id, round(r.score, 2)) for r in match_operations(ops, lines).collect()}
    assert found == {"op-2": ("a", 1.0), "op-10": ("b", 0.67)}


def test_operations_equal_greedy_pairs_and_meet_no_pairs(spark):
    random.seed(5)
    some = ["fit", "front", "bumper", "door", "r and r", "remove-refit", "", "Radiator grille", "paint"]
    name = lambda: random.choice([None, " ".join(random.choice(some) for _ in range(random.randint(0, 3)))])
    ops = [(random.choice([1, 2, 3, None]), f"o{random.randint(0, 40)}", random.randint(0, 4), name()) for _ in range(90)]
    lines = [(random.choice([1, 2, 3, None]), random.randint(0, 50), random.randint(0, 9), name()) for _ in range(90)]
    o, i = spark.createDataFrame(ops, "group_id long, op_id string, op_no int, description string"), spark.createDataFrame(lines, "group_id long, line_id long, line_no long, description string")
    pairs = o.withColumnRenamed("description", "d").join(i, "group_id").where("d IS NOT NULL AND description IS NOT NULL").withColumn("score", match_score(F.col("d"), F.col("description")))
    for least in (0.34, 0.0):
        want, taken, done = set(), set(), set()
        rows = pairs.where(F.col("score") >= least).collect()
        for group, number, op in sorted({(r.group_id, r.op_no, r.op_id) for r in rows}):
            free = [(-r.score, r.line_no, r.line_id) for r in rows if (r.group_id, r.op_no, r.op_id) == (group, number, op) and (group, r.line_id) not in taken]
            if free:
                score, _, line = min(free)
                taken.add((group, line))
                want.add((group, op, line, -score))
                done.add((group, number, op))
        found = match_operations(o, i, least)
        assert {tuple(r) for r in found.collect()} == want
        assert len(done) == found.count() and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_a_claim_are_never_formed(spark):
    random.seed(3)
    word = lambda most: "".join(random.choice("a1") for _ in range(random.randint(0, most)))
    pick = lambda *some: random.choice([None, *some])
    a = [(n, pick(1, 1, 2), pick("", "ab 1", "AB-2", "c3"), pick(word(3), word(5))) for n in range(150)]
    i = [(n, pick(1, 1, 2), pick("", "AB1", "ab 2"), pick(word(6), word(6))) for n in range(25)]
    df = pair_assessments(spark.createDataFrame(a, "assessment_id long, case_id long, registration string, reference string"), spark.createDataFrame(i, "invoice_id long, case_id long, registration string, number string"))
    clean = lambda r: (r or "").upper().replace(" ", "").replace("-", "")
    got = {r.assessment_id: (r.invoice_id, r.score, r.status) for r in df.collect()}
    for n, case, own, wanted in a:
        found = [((70 if clean(own) and clean(own) == clean(theirs) else 0) + (25 if wanted and number and wanted.upper() in number.upper() else 0), -k) for k, of, theirs, number in i if case is not None and of == case]
        score, k = max(found, default=(0, 0))
        assert got.pop(n) == (-k if score >= 70 else None, score, "paired" if score >= 70 else "unpaired")
    assert not got
    many = pair_assessments(spark.range(100_000).selectExpr("id AS assessment_id", "1 AS case_id", "'AB1' AS registration", "string(id) AS reference"), spark.range(100_000).selectExpr("id AS invoice_id", "1 AS case_id", "'AB1' AS registration", "'x' AS number"))
    assert many.where("invoice_id = 0 AND score = 70").count() == 100_000


def test_reports_read_their_pages_once_and_join_labels_in_order(spark):
    from functools import reduce

    from pyspark.sql import functions as F

    from repairbench.operators.reports_read import FIELDS, joined_labels

    pages = spark.createDataFrame([(1, 1, "Vin\nModel\nFocus\nVAT \n £20.00\nİstanbul VAT Rate: 20%\nop|a|b|c|1|2|3|4|5")], "document_id long, page_number int, text string")
    found = parse_assessments(pages)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    row = found.first()
    assert (row.vin, row.vehicle_model, str(row.vat_total), str(row.vat_rate), row.operations) == ("Model", None, "20.0000", "20.0000", 1)
    texts = spark.createDataFrame([(t,) for t in ("Model\nVIN\nFoo", "VIN\nModel\n\nFoo", "created\nVAT\nVAT Rate\n20", "Odometer\n \n12", "xVIN\nq\nVIN\nq")], "text string")
    one_by_one = reduce(lambda c, f: F.regexp_replace(c, rf"(?imd)^({f[0]})[ \t]*\n[ \t]*([^\n]+)$", "$1: $2"), FIELDS, F.col("text"))
    for r in texts.select(joined_labels(F.col("text")).alias("a"), one_by_one.alias("b")).collect():
        assert r.a == r.b
