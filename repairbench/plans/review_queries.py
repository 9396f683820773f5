"""Decisions, assessments, imports and reports on the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repairbench.functions import rules as R
from repairbench.functions import text as T
from repairbench.functions.exact import pence
from repairbench.operators import assessments as E
from repairbench.operators import checks as K
from repairbench.operators import reviews as V
from repairbench.sources import ingest as I
from repairbench.sources import reports as P
from repairbench.sources.shared import shared_folder

from .binding import OBS, observations, table
from .registered import register

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = register(QUERIES, ORACLES)


def _lines(spark, sf_dir):
    rows = observations(spark, sf_dir)
    return rows.withColumn("billed", pence(F.col("line_total"))).withColumn("reference", pence(F.col("reference_price")) * F.col("quantity").cast("long"))


@query(OBS + """SELECT line_id, vat_rate % 3 <> 0 AND quantity % 4 <> 0 AS known, vat_rate % 3 <> 0 AND quantity % 4 NOT IN (0, 1) AS independent,
 CASE WHEN vat_rate % 3 = 0 AND quantity % 4 = 0 THEN '' WHEN quantity % 4 = 0 THEN 'seed' WHEN quantity % 4 = 1 THEN CASE WHEN vat_rate % 3 = 0 THEN 'seed' ELSE 'seed' END WHEN vat_rate % 3 = 0 THEN 'import' ELSE 'import,seed' END AS lineages FROM obs""")
def c7_lineage(spark, sf_dir):
    reference, k = F.when(F.col("vat_rate") % 3 != 0, "seed"), F.col("quantity").cast("long") % 4
    history = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("seed"))).otherwise(F.array(F.lit("import"), F.lit("import")))
    rows = observations(spark, sf_dir).select("line_id", R.lineage_independence(reference, history).alias("l"))
    return rows.select("line_id", "l.known", "l.independent", F.array_join("l.lineages", ",").alias("lineages"))


CLASS = "CASE c_custkey % 5 WHEN 0 THEN 'm1' WHEN 1 THEN 'N1 ' WHEN 2 THEN 'M2' WHEN 3 THEN 'X9' ELSE NULL END"
BODY = "CASE WHEN c_custkey % 10 IN (0, 1) THEN 'ab' END"
SOURCE = "CASE WHEN c_custkey % 7 <> 0 THEN 'dvla' END"


@query(f"""WITH c AS (SELECT c_custkey, upper(trim({CLASS})) AS o, upper({BODY}) AS b, c_mktsegment AS s, {SOURCE} AS src FROM customer),
e AS (SELECT *, CASE WHEN o = 'X9' THEN 'unsupported_class' WHEN b IS NOT NULL AND o IS DISTINCT FROM 'M1' THEN 'bodywork_needs_m1' WHEN src IS NULL THEN 'source_required' END AS error FROM c)
SELECT c_custkey, error, CASE WHEN error IS NULL THEN CASE WHEN o = 'M1' AND b = 'AB' THEN 'M1 / AB Hatchback' WHEN o = 'M1' THEN 'M1 Passenger Vehicle' WHEN o = 'N1' THEN 'N1 Light Commercial Vehicle (LCV)' WHEN o IS NOT NULL THEN o ELSE 'Segment: ' || s END END AS label FROM e""")
def c11_vehicle_class(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", R.vehicle_class(F.expr(CLASS), F.expr(BODY), F.col("c_mktsegment"), F.expr(SOURCE)).alias("v"))
    return rows.select("c_custkey", "v.error", "v.label")


@query(OBS + """, d AS (SELECT *, status = 'approved' AS ok, CASE WHEN quantity % 3 = 0 THEN reference * quantity END AS edited, greatest(cost - 10000, 0) AS net0 FROM obs),
e AS (SELECT *, CASE WHEN edited IS NOT NULL AND NOT ok THEN 'INVALID_CHALLENGE_EDIT' WHEN edited IS NOT NULL AND (edited <= 0 OR edited >= cost) THEN 'INVALID_CHALLENGE_PRICE'
  WHEN ok AND coalesce(cost - edited, net0) > 0 AND quantity % 5 < 3 AND vat_rate % 2 = 1 THEN 'PROVISIONAL_EVIDENCE' END AS error FROM d),
f AS (SELECT *, CASE WHEN error IS NULL THEN coalesce(cost - edited, net0) ELSE net0 END AS net FROM e)
SELECT line_id, error, net, (2 * net * vat_rate + 100) // 200 AS vat, (20000 * net + cost) // (2 * cost) AS percent, CASE WHEN error IS NOT NULL THEN 'pending' WHEN ok THEN 'approved' ELSE 'rejected' END AS status FROM f""")
def c14_decisions(spark, sf_dir):
    rows = _lines(spark, sf_dir).select(
        "line_id", "billed", F.greatest(F.col("billed") - 10000, F.lit(0)).alias("net"), "vat_rate", F.lit(True).alias("vatable"), (F.col("status") == "approved").alias("approved"),
        F.when(F.col("quantity") % 3 == 0, F.col("reference")).alias("edited"), (F.col("quantity") % 5).cast("int").alias("comparables"), (F.col("vat_rate") % 2 == 0).alias("item_approved"),
    )
    return V.apply_decisions(rows).select("line_id", "error", "net", "vat", "percent", "status")


@query(OBS + """, m AS (SELECT line_id, CASE WHEN quantity % 4 <> 0 THEN item_id END AS item_id, CASE WHEN quantity % 2 = 0 THEN 0.97 ELSE 0.6 END AS confidence, vat_rate % 2 = 0 AND quantity % 3 = 0 AS manual FROM obs)
SELECT line_id, CASE WHEN manual THEN 1 ELSE item_id END AS item_id, CASE WHEN manual THEN 1.0 ELSE confidence END::DOUBLE AS confidence, CASE WHEN manual THEN 'manual' ELSE 'fuzzy' END AS decision,
 CASE WHEN manual OR confidence > 0.95 THEN 'approved' WHEN item_id IS NULL THEN 'no_match' ELSE 'pending' END AS status FROM m""")
def j5_overrides(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    mappings = rows.select("line_id", F.when(F.col("vat_rate") % 2 == 0, "part").otherwise("labour").alias("line_kind"), F.when(F.col("quantity") % 4 != 0, F.col("item_id")).alias("item_id"), F.when(F.col("quantity") % 2 == 0, 0.97).otherwise(0.6).alias("confidence"), F.lit("fuzzy").alias("decision"))
    overrides = rows.where("quantity % 3 = 0").select("line_id", F.lit(1).cast("long").alias("item_id"))
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.lit("part").alias("item_type"))
    return V.apply_overrides(mappings, overrides, items)


@query("""WITH r AS (SELECT o_orderkey, c_name, o_orderdate::DATE AS day, o_orderkey % 3 AS k, o_orderkey % 4 <> 0 AND count(*) FILTER (o_orderkey % 4 <> 0) OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus) > 1 AS twice FROM orders JOIN customer ON o_custkey = c_custkey),
f AS (SELECT o_orderkey, CASE k WHEN 0 THEN 'CLAIM_INVOICE_VRM_MATCH' WHEN 1 THEN 'CLAIM_INVOICE_VRM_MISMATCH' ELSE 'CLAIM_INVOICE_VRM_MISSING' END AS code, CASE k WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' ELSE 'REVIEW' END AS status FROM r
 UNION ALL SELECT o_orderkey, CASE WHEN day >= DATE '1998-01-01' THEN 'INVOICE_AFTER_ACCIDENT' ELSE 'INVOICE_BEFORE_ACCIDENT' END, CASE WHEN day >= DATE '1998-01-01' THEN 'PASS' ELSE 'FAIL' END FROM r
 UNION ALL SELECT o_orderkey, 'CLAIM_INVOICE_VEHICLE_MATCH', 'PASS' FROM r WHERE k <> 2
 UNION ALL SELECT o_orderkey, CASE WHEN twice THEN 'DUPLICATE_INVOICE' ELSE 'NO_DUPLICATE_INVOICE_FOUND' END, CASE WHEN twice THEN 'FAIL' ELSE 'PASS' END FROM r
 UNION ALL SELECT o_orderkey, 'DAMAGE_REPAIR_CAUSATION_REVIEW', 'REVIEW' FROM r WHERE k = 1)
SELECT o_orderkey::VARCHAR AS invoice_ref, code, status FROM f""")
def j12_consistency(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    numbered = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority"))
    invoices = rows.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("document_id"), F.lit(None).cast("string").alias("sha256"), numbered.alias("number"), F.col("o_orderstatus").alias("supplier"))
    twice = K.duplicate_invoices(invoices).select(F.col("document_id").alias("o_orderkey"), F.lit(True).alias("twice"))
    rows, k = rows.join(twice, "o_orderkey", "left"), F.col("o_orderkey") % 3
    facts = rows.select(
        F.col("o_orderkey").cast("string").alias("invoice_ref"), F.lit("1998-01-01").cast("date").alias("accident_date"), F.col("o_orderdate").cast("date").alias("invoice_date"),
        F.concat(F.lit("ab "), F.col("c_custkey").cast("string")).alias("claim_registration"), F.when(k == 0, F.concat(F.lit("AB-"), F.col("c_custkey").cast("string"))).when(k == 1, "ZZ9").alias("registration"),
        F.col("c_name").alias("claim_vehicle"), F.when(k != 2, F.concat("c_name", F.lit(" 1.2 TDI"))).alias("vehicle"), F.col("twice").alias("duplicate"), F.when(k == 1, "dent").alias("damage"), F.lit("bumper").alias("descriptions"),
    )
    return K.consistency_findings(facts).select("invoice_ref", "code", "status")


@query(OBS + """, v AS (SELECT line_id, reference * quantity AS a, cost AS b, cost - reference * quantity AS d FROM obs)
SELECT line_id, d AS difference, (CASE WHEN d < 0 THEN -1 ELSE 1 END) * ((20000 * abs(d) + a) // (2 * a)) AS percent, CASE WHEN d >= 500 AND d * 100 > a * 10 THEN 'above_10_percent' WHEN d >= 500 AND d * 100 > a * 5 THEN 'above_5_percent' ELSE 'within_threshold' END AS threshold_status FROM v""")
def j16_assessment_variance(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("line_id", F.col("reference").alias("assessed"), "billed")
    return E.assessment_variance(rows).select("line_id", "difference", "percent", "threshold_status")


@query(OBS + """, n AS (SELECT invoice_ref AS group_id, line_id, item_name, row_number() OVER (PARTITION BY invoice_ref, item_name ORDER BY line_id) AS up, row_number() OVER (PARTITION BY invoice_ref, item_name ORDER BY line_id DESC) AS down FROM obs)
SELECT o.group_id, 'op-' || o.line_id AS op_id, l.line_id, 2 / 3.0::DOUBLE AS score FROM n o JOIN n l ON o.group_id = l.group_id AND o.item_name = l.item_name AND o.down = l.up""")
def j15_match_operations(spark, sf_dir):
    """Lines of an order against operations named after the parts of the same order, greedily, the last operation first."""
    rows = _lines(spark, sf_dir).select(F.col("invoice_ref").alias("group_id"), "line_id", F.col("item_name").alias("description"))
    rows = rows.withColumn("line_no", F.row_number().over(Window.partitionBy("group_id").orderBy("line_id")))
    line = (F.lit(0).alias("side"), F.col("line_no"), F.col("line_id"), F.lit(None).cast("int").alias("op_no"), F.lit(None).cast("string").alias("op_id"), F.col("description"))
    operation = (F.lit(1).alias("side"), F.lit(None).cast("int").alias("line_no"), F.lit(None).cast("string").alias("line_id"), (-F.col("line_no")).alias("op_no"), F.concat(F.lit("op-"), "line_id").alias("op_id"), F.concat(F.lit("replace "), "description").alias("description"))
    return E.match_sides(rows.select("group_id", F.inline(F.array(F.struct(*line), F.struct(*operation)))))


@query("""WITH a AS (SELECT o_orderkey AS assessment_id, o_custkey % 40 AS case_id, o_orderkey % 9 AS reg FROM orders WHERE o_orderstatus = 'F'), i AS (SELECT o_orderkey AS invoice_id, o_custkey % 40 AS case_id, o_orderkey % 9 AS reg FROM orders WHERE o_orderstatus = 'O'),
s AS (SELECT assessment_id, invoice_id, CASE WHEN a.reg = i.reg THEN 70 ELSE 0 END + CASE WHEN contains('INV-' || invoice_id, assessment_id::VARCHAR) THEN 25 ELSE 0 END AS score FROM a JOIN i USING (case_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY assessment_id ORDER BY score DESC, invoice_id) AS n FROM s WHERE score > 0)
SELECT a.assessment_id, CASE WHEN score >= 70 THEN invoice_id END AS invoice_id, coalesce(score, 0) AS score, CASE WHEN score >= 70 THEN 'paired' ELSE 'unpaired' END AS status,
 CASE WHEN score IS NULL THEN 'no safe identifier match' ELSE concat_ws('; ', CASE WHEN score >= 70 THEN 'registration exact match' END, CASE WHEN score IN (25, 95) THEN 'claim reference found in invoice number' END) END AS reasons FROM a LEFT JOIN b ON a.assessment_id = b.assessment_id AND n = 1""")
def j14_pair_assessments(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("case_id", F.col("o_custkey") % 40).withColumn("registration", F.concat(F.lit("AB 1-"), (F.col("o_orderkey") % 9).cast("string")))
    a = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("assessment_id"), "case_id", "registration", F.col("o_orderkey").cast("string").alias("reference"))
    i = orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("invoice_id"), "case_id", F.lower("registration").alias("registration"), F.concat(F.lit("inv-"), F.col("o_orderkey").cast("string")).alias("number"))
    return E.pair_assessments(a, i).withColumn("reasons", F.array_join("reasons", "; "))


@query(OBS + """, f AS (SELECT case_id, cost, greatest(cost - reference * quantity, 0) AS gap, vat_rate, vat_rate = 0 AS mot FROM obs WHERE status = 'approved'),
g AS (SELECT *, CASE WHEN mot THEN 0 ELSE (2 * gap * vat_rate + 100) // 200 END AS vat FROM f),
o AS (SELECT o_custkey AS case_id, coalesce(sum((o_totalprice::DECIMAL(20,2) * 100)::BIGINT) FILTER (o_custkey % 3 <> 0), 0)::BIGINT AS gross, sum(o_orderkey % 1000)::BIGINT AS original_vat FROM orders GROUP BY 1),
s AS (SELECT case_id, sum(cost)::BIGINT AS billed, sum(gap)::BIGINT AS challenge_net, sum(vat)::BIGINT AS vat, coalesce(sum(cost) FILTER (mot), 0)::BIGINT AS mot_total, count(*) FILTER (gap > 0) AS challenged,
 (20000 * sum(gap) + sum(cost))::BIGINT // (2 * sum(cost))::BIGINT AS percent, (sum(gap) + sum(vat))::BIGINT AS challenge_gross FROM g GROUP BY 1)
SELECT s.*, original_vat, CASE WHEN gross = 0 THEN billed + original_vat ELSE gross END AS original_gross, greatest(original_gross - challenge_gross, 0) AS proposed_gross FROM s JOIN o USING (case_id)""")
def g12_financial_summary(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("case_id", "billed", F.col("reference").alias("price"), "vat_rate", (F.col("vat_rate") == 0).alias("mot"), (F.col("status") == "approved").alias("approved"))
    told = F.when(F.col("o_custkey") % 3 != 0, pence(F.col("o_totalprice")))
    invoices = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), (F.col("o_orderkey") % 1000).alias("vat"), told.alias("gross"))
    return V.financial_summary(rows, "case_id", invoices)


@query(OBS + """SELECT line_id, CASE WHEN status = 'rejected' THEN 'excluded' WHEN quantity % 4 = 0 THEN 'no_match' WHEN vat_rate % 2 = 0 THEN 'match' ELSE 'provisional' END AS mapping_status,
 CASE WHEN status = 'rejected' THEN 'excluded' WHEN quantity % 4 = 0 THEN 'missing' WHEN cost - reference * quantity >= 500 THEN 'challenge' WHEN cost > reference * quantity THEN 'below_gate' ELSE 'within' END AS comparison_status FROM obs""")
def g18_workspace_status(spark, sf_dir):
    gone = F.col("quantity") % 4 == 0
    rows = _lines(spark, sf_dir).select("line_id", (F.col("status") == "rejected").alias("excluded"), F.when(~gone, F.col("item_id")).alias("item_id"), (F.col("vat_rate") % 2 == 0).alias("mapping_approved"), F.when(~gone, F.col("reference")).alias("benchmark"), "billed", (F.col("billed") - F.col("reference") >= 500).alias("gate_passed"))
    return V.workspace_status(rows)


@query("SELECT (SELECT count(*) FROM part) AS items, (SELECT count(*) FROM lineitem) AS observations, '' AS issues")
def g17_readiness(spark, sf_dir):
    return P.readiness(table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem"))


@query(OBS + """, t AS (SELECT line_id, CASE WHEN quantity % 9 = 0 THEN NULL ELSE invoice_date END AS d, CASE WHEN vat_rate = 8 THEN NULL ELSE cost END AS c, CASE WHEN item_id % 13 = 0 THEN NULL ELSE item_id END AS known FROM obs WHERE quantity % 11 <> 0)
SELECT line_id, CASE WHEN d IS NULL THEN 'missing_date' WHEN c IS NULL THEN 'missing_total' WHEN known IS NULL THEN 'unknown_item' ELSE 'accepted' END AS outcome FROM t""")
def a4_import_history(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    raw = rows.select(F.col("line_id").alias("claim_line_id"), F.when(F.col("quantity") % 9 != 0, F.col("invoice_date")).alias("invoice_date"), F.when(F.col("vat_rate") != 8, F.col("line_total")).alias("line_total"), F.col("item_id").cast("string").alias("mapped_ontology_id"))
    items = table(spark, sf_dir, "part").where("p_partkey % 13 <> 0").select(F.col("p_partkey").cast("string").alias("ontology_id"))
    accepted, rejected = I.import_history(raw, items, rows.where("quantity % 11 = 0").select(F.col("line_id").alias("claim_line_id")))
    return accepted.select(F.col("claim_line_id").alias("line_id"), F.lit("accepted").alias("outcome")).unionByName(rejected.select(F.col("claim_line_id").alias("line_id"), F.col("reason").alias("outcome")))


@query("""SELECT s_name AS provider_name, count(*) AS rows, count(*) FILTER (l_partkey % 5 <> 0) AS accepted, count(*) FILTER (l_partkey % 5 = 0) AS rejected FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def a5_external_prices(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_name").alias("provider_name"), F.col("l_partkey").alias("ontology_code"))
    items = table(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("ontology_id"))
    return I.import_external_prices(raw, items)[1]


@query(OBS + "SELECT line_id, item_id FROM obs WHERE role = 'invoice' AND quantity % 4 <> 0 AND status = 'approved' AND vat_rate % 3 <> 0")
def a9_append_finalised(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    lines = rows.select("line_id", "role", F.when(F.col("quantity") % 4 != 0, F.col("item_id")).alias("item_id"), F.col("status").alias("mapping_status"), F.col("billed").alias("total"))
    return P.append_finalised(rows.where("vat_rate % 3 = 0").select(F.col("line_id").alias("source_line_id")), lines).select("line_id", "item_id")


@query("""WITH c AS (SELECT l_orderkey, count(*) AS lines, sum(l_quantity)::BIGINT AS total FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
n AS (SELECT o_custkey, count(*) AS invoices, max(o_orderdate)::DATE AS latest FROM orders GROUP BY 1)
SELECT o_custkey AS case_id, o_orderkey AS invoice, o_orderstatus AS status, CASE WHEN l_orderkey IS NULL THEN round(o_totalprice)::BIGINT ELSE total END AS total, lines, invoices, latest
FROM orders LEFT JOIN c ON o_orderkey = l_orderkey JOIN n USING (o_custkey)""")
def a10_report_tables(spark, sf_dir):
    """Two report tables written and read back; totals of lines that aren't returned override the supplied ones."""
    orders = table(spark, sf_dir, "orders")
    supplied = orders.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("invoice"), F.col("o_orderstatus").alias("status"), F.round("o_totalprice").cast("long").alias("total"))
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("invoice")).agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("long").alias("total"))
    cases = orders.groupBy(F.col("o_custkey").alias("case_id")).agg(F.count("*").alias("invoices"), F.max("o_orderdate").cast("date").alias("latest"))
    tables = {"invoices": P.with_computed(supplied, lines, ["invoice"]), "claims": cases}
    path = shared_folder(spark, "report")
    P.write_report_tables(tables, path, {"invoices": "invoice", "claims": "latest"})
    back = {name: P.read_report_table(spark, path, name, df.schema) for name, df in tables.items()}
    return back["invoices"].join(back["claims"], "case_id")


@query("""SELECT o_custkey AS case_id, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS invoices, count(*) AS n FROM orders GROUP BY 1""")
def a11_nested_result(spark, sf_dir):
    invoices = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), "o_orderkey", "o_totalprice")
    nested = P.nest_result("case_id", {"invoices": invoices}, {"invoices": "o_orderkey"})
    return nested.select("case_id", F.array_join(F.transform("invoices", lambda x: x["o_orderkey"].cast("string")), ",").alias("invoices"), F.size("invoices").cast("long").alias("n"))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN s_name ELSE 'INV-' || s_suppkey END AS number, CASE s_suppkey % 4 WHEN 0 THEN NULL ELSE s_name END AS supplier,
 'RSR-' || upper(left(sha256(CASE WHEN s_suppkey % 2 = 0 THEN 'part_number' || chr(31) || 'part' || chr(31) || 'pn' || s_suppkey ELSE 'canonical' || chr(31) || 'part' || chr(31) || lower(replace(s_name, '#', ' ')) || chr(31) || 'brakes' || chr(31) || 'each' END), 16)) AS code FROM supplier""")
def t11_t14_identity(spark, sf_dir):
    k, key = F.col("s_suppkey") % 4, F.col("s_suppkey").cast("string")
    number = F.when(k == 0, " Invoice No. ").when(k == 1, F.concat(F.lit(" "), "s_name")).otherwise(F.concat(F.lit("INV-"), key))
    code = T.item_identity(F.lit("part"), F.col("s_name"), F.lit("Brakes"), F.lit("each"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("PN-"), key)))
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.clean_identifier(number, "number").alias("number"), T.clean_identifier(F.when(k == 0, "Unknown repairer").otherwise(F.col("s_name")), "supplier").alias("supplier"), code.alias("code"))


@query("""WITH i AS (SELECT min(p_partkey) AS item_id, p_name FROM part GROUP BY p_name), r AS (SELECT i.item_id, CASE p_partkey % 3 WHEN 0 THEN p.p_name ELSE 'new ' || p.p_name END AS d FROM part p JOIN i USING (p_name) WHERE p_partkey % 5 <> 0),
h AS (SELECT CASE WHEN item_id % 4 = 0 THEN item_id + 1 ELSE item_id END AS owner, 'new ' || p_name AS d, item_id % 4 = 1 AS approved FROM i WHERE item_id % 4 <> 3)
SELECT DISTINCT item_id, r.d AS normalised, CASE WHEN owner IS NULL THEN 'learned' ELSE 'promoted' END AS action FROM r LEFT JOIN h ON r.d = h.d WHERE r.d LIKE 'new %' AND r.d NOT IN (SELECT p_name FROM i) AND (owner IS NULL OR (owner = item_id AND NOT approved))""")
def j19_learn_synonyms(spark, sf_dir):
    """Some synonyms are another item's, some are approved, some wait for approval."""
    part = table(spark, sf_dir, "part")
    items = part.groupBy("p_name").agg(F.min("p_partkey").alias("item_id")).withColumn("name", F.col("p_name"))
    reviews = part.join(items, "p_name").select("item_id", (F.col("p_partkey") % 5 != 0).alias("approved"), F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.concat(F.lit("New  "), "p_name")).alias("description"))
    held = items.where("item_id % 4 <> 3").select(F.when(F.col("item_id") % 4 == 0, F.col("item_id") + 1).otherwise(F.col("item_id")).alias("item_id"), F.concat(F.lit("new "), "name").alias("synonym"), (F.col("item_id") % 4 == 1).alias("approved"))
    return V.learn_synonyms(reviews, items.select("item_id", "name"), held)
