"""Pairing of assessments, learnt synonyms and what is left of a claim's gross."""

from repairbench.operators.assessments import pair_assessments
from repairbench.operators.reviews import financial_summary, learn_synonyms


def test_pairing_with_reasons(spark):
    a = spark.createDataFrame([(1, 7, "ab 12-cde", "CL9"), (2, 7, None, "cl9"), (3, 7, "ZZ1 ZZZ", None), (4, None, "AB12CDE", "CL9")], "assessment_id long, case_id long, registration string, reference string")
    i = spark.createDataFrame([(10, 7, "AB12CDE", "INV-1"), (11, 7, "AB12 CDE", "x-cl9/2"), (12, 7, "", "CL9"), (13, 8, "AB12CDE", "CL9")], "invoice_id long, case_id long, registration string, number string")
    got = {r.assessment_id: (r.invoice_id, r.score, r.status, r.reasons) for r in pair_assessments(a, i).collect()}
    assert got == {
        1: (11, 95, "paired", ["registration exact match", "claim reference found in invoice number"]),
        2: (None, 25, "unpaired", ["claim reference found in invoice number"]),
        3: (None, 0, "unpaired", ["no safe identifier match"]),
        4: (None, 0, "unpaired", ["no safe identifier match"]),
    }


def test_synonyms_learnt_and_promoted(spark):
    reviews = spark.createDataFrame([(1, "New Pads", True), (2, "new  pads", True), (1, "new pads", True), (1, "Waiting", True), (1, "Known", True), (1, "Theirs", True), (1, "Lamp", True), (1, "no", False)], "item_id long, description string, approved boolean")
    items = spark.createDataFrame([(1, "Lamp"), (2, "Disc")], "item_id long, name string")
    held = spark.createDataFrame([(1, "waiting", False), (1, "known", True), (2, "theirs", False)], "item_id long, synonym string, approved boolean")
    assert sorted((r.item_id, r.normalised, r.action) for r in learn_synonyms(reviews, items, held).collect()) == [(1, "new pads", "learned"), (1, "waiting", "promoted")]


def test_proposed_gross(spark):
    lines = spark.createDataFrame([(1, 1000, 400, 20, False, True), (1, 500, 100, 20, True, True), (2, 100, 90, 20, False, True), (3, 9, 9, 20, False, False)], "case_id long, billed long, price long, vat_rate int, mot boolean, approved boolean")
    invoices = spark.createDataFrame([(1, 200, 1700), (1, 20, None), (2, 20, None)], "case_id long, vat long, gross long")
    got = {r.case_id: (r.challenge_gross, r.original_vat, r.original_gross, r.proposed_gross) for r in financial_summary(lines, "case_id", invoices).collect()}
    assert got == {1: (1120, 220, 1700, 580), 2: (12, 20, 120, 108)}


def test_lineages_are_told_without_lambdas_and_decimals(spark):
    from repairbench.plans.review_queries import QUERIES

    plan = QUERIES["c7_lineage"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().lower()
    assert "lambda" not in plan and "decimal(20,4)) % " not in plan
