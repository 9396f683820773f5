"""Pages, checks, duplicates, audit chains and batches on the bound tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from repairbench.functions.exact import pence
from repairbench.operators import audit as A
from repairbench.operators import batch as X
from repairbench.operators import checks as K
from repairbench.operators import pages as P
from repairbench.operators import vehicles as V
from repairbench.sources.shared import written

from .binding import OBS, observations, table
from .registered import register

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = register(QUERIES, ORACLES)

# Page texts, rotations and numbers made of orders: a document is a customer's orders, a page is one of them.
PAGE = """CASE o_orderkey % 8 WHEN 0 THEN 'SALES INVOICE No: INV-' || CAST(o_orderkey AS STRING) WHEN 1 THEN 'Invoice Number AB' WHEN 2 THEN 'Estimate/Order quotation' WHEN 3 THEN 'credit note Document No. CN' || CAST(o_orderkey AS STRING)
 WHEN 4 THEN 'Vehicle service history and work history' WHEN 5 THEN 'qty 1.00 2.00 3.00 4.00' WHEN 6 THEN 'x' ELSE 'workshop notes' END"""
CLASS = """CASE o_orderkey % 8 WHEN 0 THEN 'invoice' WHEN 1 THEN 'invoice' WHEN 2 THEN 'estimate' WHEN 3 THEN 'credit_note' WHEN 4 THEN 'service_history' WHEN 5 THEN 'invoice' WHEN 6 THEN 'blank' ELSE 'other' END"""
SURE = "CASE o_orderkey % 8 WHEN 0 THEN 0.80 WHEN 1 THEN 0.78 WHEN 2 THEN 0.88 WHEN 3 THEN 0.80 WHEN 4 THEN 0.88 WHEN 5 THEN 0.72 WHEN 6 THEN 0.62 ELSE 0.55 END"


def _pages(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("page_number"), F.expr(PAGE).alias("text"), F.expr("CASE WHEN o_orderstatus = 'F' THEN 90 WHEN o_orderstatus = 'O' THEN 270 ELSE 0 END").alias("rotation"))


@query(f"""SELECT o_orderkey, {CLASS} AS page_type, ({SURE})::DOUBLE AS confidence,
 CASE WHEN o_orderkey % 8 IN (0, 1, 2, 3, 5) THEN {CLASS} || ':' || CASE o_orderkey % 8 WHEN 0 THEN 'INV-' || o_orderkey WHEN 3 THEN 'CN' || o_orderkey ELSE 'page-' || o_orderkey END END AS unit FROM orders""")
def x1_x2_pages(spark, sf_dir):
    rows = _pages(spark, sf_dir).withColumn("c", P.classify_page(F.col("text")))
    return rows.select("o_orderkey", "c.page_type", F.round("c.confidence", 6).alias("confidence"), P.group_key(F.col("c.page_type"), F.col("text"), F.col("page_number")).alias("unit"))


@query(f"""WITH p AS (SELECT o_custkey % 50 AS document_id, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS page_number, o_orderkey, o_orderstatus IN ('F', 'O') AS turned, {CLASS} AS kind FROM orders),
r AS (SELECT *, sum(CASE WHEN turned AND coalesce(before, false) THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY page_number) AS run FROM (SELECT *, lag(turned) OVER (PARTITION BY document_id ORDER BY page_number) AS before FROM p)),
s AS (SELECT *, count(*) OVER (PARTITION BY document_id, run) AS n, max(CASE WHEN o_orderkey % 8 IN (4, 7) THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, run) AS speaks FROM r)
SELECT o_orderkey, CASE WHEN turned AND n >= 2 AND speaks = 1 AND kind = 'other' THEN 'service_history' ELSE kind END AS page_type FROM s""")
def w6_rotated_runs(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = _pages(spark, sf_dir).withColumn("document_id", F.col("document_id") % 50)
    rows = rows.withColumn("page_number", F.row_number().over(Window.partitionBy("document_id").orderBy("o_orderkey"))).withColumn("c", P.classify_page(F.col("text")))
    return P.label_rotated_runs(rows.select("*", "c.page_type", "c.confidence").drop("c")).select("o_orderkey", "page_type")


@query("""SELECT event_id, coalesce(last_value(CASE WHEN event_type IN ('error', 'signup') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 'unknown') AS section FROM events""")
def w7_carry_section(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("heading", F.when(F.col("event_type").isin("error", "signup"), F.col("event_type")))
    return P.carry_section(rows, ["user_id"], "event_id", "heading").select("event_id", "section")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, concat_ws('|', user_id::VARCHAR, event_id::VARCHAR, props) AS said, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
chain AS (SELECT user_id, event_id, n, NULL::VARCHAR AS previous_hash, sha256(said || '|') AS event_hash FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, c.event_hash, sha256(e.said || '|' || c.event_hash) FROM chain c JOIN e ON e.user_id IS NOT DISTINCT FROM c.user_id AND e.n = c.n + 1)
SELECT event_id, previous_hash, event_hash, true AS valid FROM chain""")
def w8_audit_chain(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), "event_id", F.col("ts").alias("created_at"), F.col("props").alias("payload"))
    return A.verify_audit(A.seal_audit(events)).select("event_id", "previous_hash", "event_hash", "valid")


def _lines(spark, sf_dir):
    kind = F.when(F.col("item_type") == "ECONOMY", "labour").otherwise("part")
    return observations(spark, sf_dir).select("line_id", "invoice_ref", "case_id", "item_id", "item_name", "invoice_date", "quantity", "billed", "unit_cost", kind.alias("kind"), (F.col("vat_rate") > 0).alias("vatable"), "status")


@query(OBS + "SELECT line_id, 'LINE_MATH_MISMATCH' AS code, unit_cost * quantity AS expected, cost AS found, CASE WHEN abs(unit_cost * quantity - cost) <= 2 THEN 'pass' ELSE 'fail' END AS status FROM obs")
def g13_line_checks(spark, sf_dir):
    return K.validate_lines(_lines(spark, sf_dir))


@query(OBS + """, k AS (SELECT invoice_ref, cost, item_type = 'ECONOMY' AS lab, vat_rate > 0 AS vatable FROM obs),
s AS (SELECT invoice_ref, sum(cost) FILTER (lab) AS ll, sum(cost) FILTER (vatable AND NOT lab) AS lp, sum(cost) FILTER (vatable) AS la FROM k GROUP BY 1),
i AS (SELECT o_orderkey::VARCHAR AS invoice_ref, (o_totalprice::DECIMAL(20,2) * 100)::BIGINT AS gross FROM orders),
j AS (SELECT *, gross * 5 // 6 AS subtotal, gross - gross * 5 // 6 AS vat FROM i),
c AS (SELECT invoice_ref, 'LABOUR_TOTAL_MISMATCH' AS code, CASE WHEN ll IS NULL THEN NULL ELSE ll END::BIGINT AS expected, 10000::BIGINT AS found, 5 AS tol FROM j LEFT JOIN s USING (invoice_ref)
 UNION ALL SELECT invoice_ref, 'PARTS_TOTAL_MISMATCH', coalesce(lp, 0)::BIGINT, NULL, 5 FROM j LEFT JOIN s USING (invoice_ref)
 UNION ALL SELECT invoice_ref, 'SUBTOTAL_MISMATCH', (coalesce(la, 0) + CASE WHEN ll IS NULL THEN 10000 ELSE 0 END)::BIGINT, subtotal, 5 FROM j LEFT JOIN s USING (invoice_ref)
 UNION ALL SELECT invoice_ref, 'VAT_MISCALC', (2 * subtotal * 20 + 100) // 200, vat, 2 FROM j
 UNION ALL SELECT invoice_ref, 'TOTAL_MISMATCH', subtotal + vat, gross, 5 FROM j)
SELECT invoice_ref, CASE WHEN (expected IS NULL OR found IS NULL) AND NOT (code = 'LABOUR_TOTAL_MISMATCH' AND expected IS NULL) THEN 'MISSING_VALUE' ELSE code END AS code, expected, found, CASE WHEN expected IS NULL OR found IS NULL THEN 'not_applicable' WHEN abs(expected - found) <= tol THEN 'pass' ELSE 'fail' END AS status FROM c""")
def g13_invoice_checks(spark, sf_dir):
    gross = pence(F.col("o_totalprice"))
    sub = F.expr("gross * 5 div 6")
    invoices = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("invoice_ref"), gross.alias("gross"))
    invoices = invoices.select("invoice_ref", "gross", sub.alias("subtotal"), (F.col("gross") - sub).alias("vat"), F.lit(20).alias("vat_rate"), F.lit(10000).cast("long").alias("labour"), F.lit(None).cast("long").alias("parts"), F.lit(None).cast("long").alias("exempt"))
    return K.validate_invoices(invoices, _lines(spark, sf_dir))


@query("""WITH i AS (SELECT o_custkey % 20 AS case_id, o_orderkey AS document_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS number, lower(replace(o_orderstatus, ' ', '')) AS s, o_totalprice::DECIMAL(20,2)::VARCHAR AS h FROM orders)
SELECT case_id, document_id, a AS same_content, b AS same_number FROM (SELECT *, count(DISTINCT document_id) OVER (PARTITION BY case_id, h) > 1 AS a, number IS NOT NULL AND count(DISTINCT document_id) OVER (PARTITION BY case_id, number, s) > 1 AS b FROM i) WHERE a OR b""")
def j13_duplicate_invoices(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("case_id"), F.col("o_orderkey").alias("document_id"), F.col("o_totalprice").cast("decimal(20,2)").cast("string").alias("sha256"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("number"), F.col("o_orderstatus").alias("supplier"))
    return K.duplicate_invoices(rows)


@query("""SELECT o_orderkey, CASE WHEN o_orderdate::DATE < DATE '1997-01-01' THEN 15.0 WHEN o_orderdate::DATE <= DATE '1999-06-30' THEN 17.5 WHEN o_orderdate::DATE >= DATE '2000-01-01' THEN 20.0 END::DOUBLE AS vat FROM orders""")
def j17_rule_at(spark, sf_dir):
    """Three periods of one rule, made of the orders' own dates, with a gap between the last two."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    rule = lambda name, start, end, value: f"named_struct('rule', '{name}', 'valid_from', DATE'{start}', 'valid_to', CAST({end} AS DATE), 'value', {value}D)"
    listed = [rule("vat", "1900-01-01", "'1996-12-31'", 15.0), rule("vat", "1997-01-01", "'1999-06-30'", 17.5), rule("vat", "2000-01-01", "NULL", 20.0), rule("mot", "1990-01-01", "NULL", 0.0)]
    periods = f"inline(array({', '.join(listed)}))"
    rules = orders.agg(F.max("day").alias("d")).selectExpr(periods)
    return V.rule_at(orders, rules, "day", "vat").select("o_orderkey", F.col("rule_value").alias("vat"))


BATCH = OBS + """, b AS (SELECT line_id, case_id % 25 AS case_id, invoice_ref::BIGINT AS rank, item_id::VARCHAR AS item_key, item_name AS category, cost FROM obs WHERE status <> 'rejected'),
pr AS (SELECT l.line_id, p.line_id AS prior_id, any_value(p.cost) AS v FROM b l JOIN b p ON l.case_id = p.case_id AND p.rank < l.rank AND p.cost > 0 AND (l.item_key = p.item_key OR l.category = p.category) GROUP BY 1, 2),
v AS (SELECT line_id, list_sort(list(v)) AS v, count(*) AS n FROM pr GROUP BY 1),
w AS (SELECT b.line_id, coalesce(n, 0) AS history, cost, CASE WHEN n >= 3 THEN (2 * (v[(n - 1) * 9 // 10 + 1] * 10 + (v[least((n - 1) * 9 // 10 + 2, n)] - v[(n - 1) * 9 // 10 + 1]) * ((n - 1) * 9 % 10)) + 10) // 20 END AS p90 FROM b LEFT JOIN v USING (line_id)),
d AS (SELECT *, CASE WHEN p90 IS NOT NULL THEN greatest(cost - p90, 0) END AS difference FROM w),
e AS (SELECT *, (difference * 1000) // p90 + CASE WHEN 2 * ((difference * 1000) % p90) > p90 OR (2 * ((difference * 1000) % p90) = p90 AND ((difference * 1000) // p90) % 2 = 1) THEN 1 ELSE 0 END AS percent FROM d)
"""


@query(BATCH + "SELECT line_id, history, p90, difference, percent, coalesce(difference > 0, false) AS above_p90, coalesce(difference >= 500 AND percent > 100, false) AS challenged FROM e")
def w2_batch_p90(spark, sf_dir):
    rows = _lines(spark, sf_dir).where("status <> 'rejected'")
    rows = written(rows.select("line_id", (F.col("case_id") % 25).alias("case_id"), F.col("invoice_ref").cast("long").alias("rank"), F.col("item_id").cast("string").alias("item_key"), F.col("item_name").alias("category"), F.col("billed").alias("cost")), "batch")
    return X.batch_p90(rows)


def _dashboard(spark, sf_dir, only, **filters):
    """Batches of the bound lines: lines without an item go by their category; small orders have no vehicle."""
    rows = observations(spark, sf_dir).where("status <> 'rejected'").withColumn("case_id", F.col("case_id") % 25)
    rows = rows.select(
        "case_id", F.col("invoice_ref").cast("long").alias("invoice_ref"), "invoice_date", F.when(F.col("quantity") % 4 != 0, F.col("item_id")).alias("item_id"), F.col("item_name").alias("item"),
        F.when(F.col("vat_rate") != 4, F.col("vehicle_label")).alias("vehicle_label"), F.when(F.col("item_type") == "ECONOMY", "labour").otherwise("part").alias("kind"), "unit_cost", F.col("billed").alias("cost"),
        F.when(F.col("vat_rate") != 5, F.col("repairer")).alias("repairer"), "line_id",
    )
    whose = ["repairer", "line_id"]
    rows = written(rows if {"repairers", "repairer_items"} & set(only) else rows.drop(*whose), "batch")
    key = F.col("item_id").cast("string")
    rows = rows.withColumn("identity", F.coalesce(key, F.concat(F.lit("description:"), F.lower("item"))))
    keep = ["case_id", "invoice_ref", "invoice_date", "identity", "item", "vehicle_label", "cost", *[c for c in whose if c in rows.columns]]
    judged = X.batch_p90(rows.withColumns({"rank": F.col("invoice_ref"), "item_key": key, "category": F.col("item")}), keep=tuple(keep))
    return X.batch_dashboard(rows, judged, only=only, **filters)


DASHBOARD = OBS + """, b AS (SELECT line_id, case_id % 25 AS case_id, invoice_ref::BIGINT AS rank, invoice_date, CASE WHEN quantity % 4 <> 0 THEN item_id::VARCHAR END AS item_key, item_name AS item, coalesce(item_key, 'description:' || lower(item_name)) AS identity,
  CASE WHEN vat_rate <> 4 THEN vehicle_label ELSE 'Unclassified' END AS vehicle_label, CASE WHEN vat_rate <> 5 THEN repairer ELSE 'Unknown repairer' END AS repairer, CASE WHEN item_type = 'ECONOMY' THEN unit_cost END AS rate, cost FROM obs WHERE status <> 'rejected' AND cost > 0),
pr AS (SELECT l.line_id, p.line_id AS prior_id, any_value(p.cost) AS v FROM b l JOIN b p ON l.case_id = p.case_id AND p.rank < l.rank AND (l.item_key = p.item_key OR l.item = p.item) GROUP BY 1, 2),
v AS (SELECT line_id, list_sort(list(v)) AS v, count(*) AS n FROM pr GROUP BY 1 HAVING count(*) >= 3),
w AS (SELECT b.*, (2 * (v[(n - 1) * 9 // 10 + 1] * 10 + (v[least((n - 1) * 9 // 10 + 2, n)] - v[(n - 1) * 9 // 10 + 1]) * ((n - 1) * 9 % 10)) + 10) // 20 AS p90 FROM b JOIN v USING (line_id)),
d AS (SELECT *, cost - p90 AS difference, ((cost - p90) * 1000) // p90 AS q, ((cost - p90) * 1000) % p90 AS r FROM w WHERE cost - p90 >= 500),
found AS (SELECT *, q + CASE WHEN 2 * r > p90 OR (2 * r = p90 AND q % 2 = 1) THEN 1 ELSE 0 END AS percent FROM d)
"""


@query(DASHBOARD + """, g AS (SELECT case_id, identity, item, vehicle_label, list_sort(list(cost)) AS v, count(*) AS n, sum(cost)::BIGINT AS total, list_sort(list(rate) FILTER (rate > 0)) AS rates, coalesce(sum(rate) FILTER (rate > 0), 0)::BIGINT AS rate_total, count(DISTINCT rank) AS invoice_count, max(invoice_date) AS latest_date FROM b GROUP BY ALL),
e AS (SELECT case_id, identity, item, vehicle_label, count(*) AS x, count(DISTINCT rank) AS i FROM found WHERE percent > 100 GROUP BY ALL)
SELECT case_id, identity, item, vehicle_label, n AS count, v[1] / 100.0 AS minimum, v[n] / 100.0 AS maximum, ((2 * total + n) // (2 * n)) / 100.0 AS mean, ((v[(n + 1) // 2] + v[n // 2 + 1] + 1) // 2) / 100.0 AS median,
 ((2 * (v[(n - 1) * 9 // 10 + 1] * 10 + (v[least((n - 1) * 9 // 10 + 2, n)] - v[(n - 1) * 9 // 10 + 1]) * ((n - 1) * 9 % 10)) + 10) // 20) / 100.0 AS percentile_90, coalesce(len(rates), 0) AS labour_count,
 ((2 * rate_total + len(rates)) // (2 * len(rates))) / 100.0 AS labour_mean, n AS source_count, invoice_count, latest_date, coalesce(x, 0) AS exception_count, coalesce(i, 0) AS exception_invoice_count, CASE WHEN n >= 10 THEN 'strong' ELSE 'usable' END AS sample_strength
FROM g LEFT JOIN e USING (case_id, identity, item, vehicle_label) WHERE n >= 3""")
def w3_batch_benchmarks(spark, sf_dir):
    rows = _dashboard(spark, sf_dir, min_count=3, only=["benchmarks"])["benchmarks"]
    columns = ["minimum", "maximum", "mean", "median", "percentile_90", "labour_count", "labour_mean", "source_count", "invoice_count", "latest_date", "exception_count", "exception_invoice_count", "sample_strength"]
    return rows.select("case_id", "identity", "item", "vehicle_label", "count", *columns)


@query(DASHBOARD + """, s AS (SELECT * FROM b WHERE vehicle_label = 'Segment: BUILDING' AND invoice_date >= DATE '1996-01-01' AND invoice_date <= DATE '2000-12-31'),
g AS (SELECT case_id, item, count(*) AS n, (2 * sum(cost)::BIGINT + count(*)) // (2 * count(*)) AS m FROM s GROUP BY case_id, identity, item, vehicle_label),
t AS (SELECT case_id, (2 * sum(cost)::BIGINT + count(*)) // (2 * count(*)) AS average_cost, count(*) AS observation_count, (2 * sum(rate) FILTER (rate > 0) + count(*) FILTER (rate > 0))::BIGINT // nullif(2 * count(*) FILTER (rate > 0), 0) AS average_labour_rate FROM s GROUP BY 1),
tops AS (SELECT case_id, first(item ORDER BY n DESC, item) AS most_observed, first(item ORDER BY m DESC, n DESC, item) AS most_expensive, max(m) AS highest_mean FROM g GROUP BY 1),
q AS (SELECT case_id, count(*) AS line_count, count(*) FILTER (vehicle_label <> 'Unclassified') AS classified, max(invoice_date) AS latest_date, classified * 1000 // line_count AS a, classified * 1000 % line_count AS r FROM b GROUP BY 1)
SELECT case_id, average_cost, average_labour_rate, most_observed, observation_count, most_expensive, highest_mean, line_count, classified, latest_date, a + CASE WHEN 2 * r > line_count OR (2 * r = line_count AND a % 2 = 1) THEN 1 ELSE 0 END AS coverage FROM q LEFT JOIN t USING (case_id) LEFT JOIN tops USING (case_id)""")
def w3_batch_summary(spark, sf_dir):
    """One vehicle label and five years are shown; the quality of a batch looks at all of it."""
    board = _dashboard(spark, sf_dir, vehicle_label="Segment: BUILDING", date_from=dt.date(1996, 1, 1), date_to=dt.date(2000, 12, 31), only=["quality", "summary"])
    return board["quality"].join(board["summary"], "case_id", "left")


@query(DASHBOARD + """SELECT case_id, lower(repairer) AS repairer_key, identity, item, count(*) AS challenge_count, count(DISTINCT rank) AS invoice_count, sum(difference)::BIGINT AS total_difference, max(difference) AS maximum_difference, max(percent) AS maximum_percent,
 any_value(n) AS item_count FROM found JOIN (SELECT case_id, repairer, count(DISTINCT (identity, item)) AS n FROM found WHERE percent > 100 GROUP BY ALL) USING (case_id, repairer) WHERE percent > 100 GROUP BY ALL""")
def w3_batch_repairers(spark, sf_dir):
    board = _dashboard(spark, sf_dir, only=["repairers", "repairer_items"])
    return board["repairer_items"].join(board["repairers"].select("case_id", "repairer_key", "item_count"), ["case_id", "repairer_key"])


REVIEWED = OBS + ", c AS (SELECT case_id, cost % 5000 - 1000 AS net, status, cost % 101 AS score FROM obs)\n"


def _reviewed(spark, sf_dir, final: bool):
    rows = _lines(spark, sf_dir).select("case_id", (F.col("billed") % 5000 - 1000).alias("net"), "status", (F.col("billed") % 101).alias("score"))
    return X.reviewed_summary(rows, "case_id", final)


@query(REVIEWED + """SELECT case_id, coalesce(sum(net) FILTER (net > 0 AND status = 'approved'), 0)::BIGINT AS challenge_net, count(*) FILTER (net > 0 AND status = 'approved') AS challenges,
 (2 * sum(score) FILTER (status <> 'rejected') + count(*) FILTER (status <> 'rejected'))::BIGINT // nullif(2 * count(*) FILTER (status <> 'rejected'), 0) AS mean_score, count(*) FILTER (status = 'pending' AND net > 0) AS blocked FROM c GROUP BY 1""")
def g10_reviewed_summary(spark, sf_dir):
    return _reviewed(spark, sf_dir, True)


@query(REVIEWED + """, f AS (SELECT case_id, count(*) FILTER (net > 0 AND status <> 'rejected') AS b_n, count(*) FILTER (net > 0 AND status = 'approved') AS a_n, coalesce(sum(net) FILTER (net > 0 AND status <> 'rejected'), 0)::BIGINT AS b_s, coalesce(sum(net) FILTER (net > 0 AND status = 'approved'), 0)::BIGINT AS a_s FROM c GROUP BY 1)
SELECT case_id, 'challenges' AS measure, b_n AS before, a_n AS after, a_n - b_n AS change FROM f UNION ALL SELECT case_id, 'challenge_net', b_s, a_s, a_s - b_s FROM f""")
def g16_summary_delta(spark, sf_dir):
    return X.summary_delta(_reviewed(spark, sf_dir, False), _reviewed(spark, sf_dir, True), "case_id", ["challenges", "challenge_net"])
