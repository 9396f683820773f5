"""Extractions, evidence, vehicles and imports on the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from repairbench.functions import text as T
from repairbench.functions.exact import pence
from repairbench.operators import compare as C
from repairbench.operators import evidence as E
from repairbench.operators import extractions as X
from repairbench.operators import history as H
from repairbench.operators import vehicles as V
from repairbench.sources.ingest import import_report

from .binding import OBS, observations, table
from .claim_queries import PAIRS, _history, _scoped
from .registered import register

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = register(QUERIES, ORACLES)

CENTS = "(l_extendedprice::DECIMAL(20,2) * 100)::BIGINT"


@query("""SELECT (SELECT count(*) FROM part) AS item_rows, (SELECT count(*) FROM part WHERE p_partkey % 9 <> 0) AS priced, (SELECT count(*) FROM part WHERE p_partkey % 9 = 0) AS missing_price,
 count(*) FILTER (o_orderkey % 10 <> 0) AS history_rows, count(*) FILTER (o_orderkey % 10 <> 0 AND o_orderstatus <> 'P') AS invoice_rows, count(*) FILTER (o_orderkey % 10 <> 0 AND o_orderstatus = 'P') AS estimate_rows,
 count(*) FILTER (o_orderkey % 10 = 0) AS gold_rows, count(DISTINCT o_orderkey) FILTER (o_orderkey % 10 = 0) AS gold_invoices FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def a7_import_report(spark, sf_dir):
    """Every tenth invoice is held back as gold; every ninth item has no price."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(F.col("o_orderkey").alias("invoice_number"), F.when(F.col("o_orderstatus") == "P", "estimate").otherwise("invoice").alias("document_role"))
    items = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 9 != 0, F.col("p_retailprice")).alias("reference_price"))
    return import_report(items, rows.where("invoice_number % 10 <> 0"), rows.where("invoice_number % 10 = 0"))


WORDS = "array_to_string(regexp_extract_all(lower({}), '[a-z0-9]+'), ' ')"


@query(f"""SELECT p_partkey, sha256(json_object('currency', 'GBP', 'fitment', p_type, 'minimal_excerpt', {WORDS.format("p_name || ', ' || p_type")}, 'original_price', NULL, 'part_number', 'ab' || p_partkey::VARCHAR,
 'price_net', p_retailprice::DECIMAL(20,2)::VARCHAR, 'source_record_id', NULL, 'source_uri', 'https://www.example.org/parts?id=' || p_partkey::VARCHAR, 'title', {WORDS.format('p_name')}, 'unit', 'each', 'vat_basis', 'net')::VARCHAR) AS content_hash FROM part""")
def t14_evidence_hash(spark, sf_dir):
    uri = F.concat(F.lit("HTTPS://WWW.Example.org:443/parts?id="), F.col("p_partkey").cast("string"), F.lit("#price"))
    none, number = F.lit(None).cast("string"), F.concat(F.lit("AB-"), F.col("p_partkey").cast("string"))
    excerpt = F.concat("p_name", F.lit(", "), "p_type")
    digest = T.evidence_hash(uri, none, F.col("p_name"), excerpt, number, F.col("p_retailprice"), none, F.lit("gbp"), F.lit("net"), F.lit("each"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", digest.alias("content_hash"))


@query("""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host FROM pages)
SELECT page_id, host, host = 'example.com' OR host LIKE '%.example.com' OR host LIKE '%.example.org' OR host = 'example.org' AS allowed FROM h""")
def t15_host_allowed(spark, sf_dir):
    patterns = spark.createDataFrame([("*.Example.com",), ("*.example.org.",), ("example.net",)], "pattern string")
    rows = table(spark, sf_dir, "pages").select("page_id", T.url_host(F.col("url")).alias("host"))
    return E.host_allowed(rows, patterns)


@query("""WITH n AS (SELECT p_partkey, p_type, p_name, p_partkey % 3 = 0 AS item, p_partkey % 10 = 0 AS approved, p_partkey % 25 = 1 AS open FROM part),
a AS (SELECT DISTINCT p_type, p_name FROM n WHERE approved), o AS (SELECT DISTINCT p_type, p_name FROM n WHERE open)
SELECT p_partkey, CASE WHEN a.p_name IS NOT NULL THEN 'ONTOLOGY_ITEM_ALREADY_APPROVED' WHEN o.p_name IS NOT NULL THEN 'RESEARCH_IDENTITY_ALREADY_OPEN' WHEN p_partkey % 7 = 0 THEN 'EVIDENCE_CONTENT_ALREADY_RESEARCHED' END AS rejected
FROM n LEFT JOIN a USING (p_type, p_name) LEFT JOIN o USING (p_type, p_name)""")
def j20_reject_known(spark, sf_dir):
    none = F.lit(None).cast("string")
    part = table(spark, sf_dir, "part").withColumn("identity", T.item_identity(F.col("p_type"), F.col("p_name"), none, none, none)).withColumn("content_hash", F.sha2(F.col("p_partkey").cast("string"), 256))
    items = part.select("identity", F.when(F.col("p_partkey") % 10 == 0, "approved").otherwise("provisional").alias("status"))
    found = E.reject_known(part.select("p_partkey", "identity", "content_hash"), items, part.where("p_partkey % 25 = 1").select("identity"), part.where("p_partkey % 7 = 0").select("content_hash"))
    return found.select("p_partkey", "rejected")


@query(PAIRS + """, good AS (SELECT * FROM pairs WHERE first_reason IS NULL AND second_reason IS NULL)
SELECT line_id, count(*) AS used, sum(given)::BIGINT AS original, sum(total)::BIGINT AS normalised, count(*) FILTER (as_of - observed_at > 1095) AS stale,
 sum((pow(0.5, (as_of - observed_at) / 365.25)::DECIMAL(20,18) * comparability::DECIMAL(10,6))::DECIMAL(28,18))::DOUBLE AS weight FROM good GROUP BY 1""")
def j11_comparables(spark, sf_dir):
    """The comparables themselves, told by line: how many, their sums as given and as they count, how many stale, their weight."""
    rows = E.comparables(H.past_history(*_history(spark, sf_dir)))
    return rows.groupBy("line_id").agg(F.count("*").alias("used"), F.sum("original").cast("long").alias("original"), F.sum("normalised").cast("long").alias("normalised"), F.sum(F.col("stale").cast("long")).alias("stale"), F.sum("weight").cast("double").alias("weight"))


def _vehicles(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    catalogue = nation.select(
        F.col("n_nationkey").alias("position"), F.col("r_name").alias("make"), F.col("n_name").alias("model"), F.array(F.concat(F.lit("al"), F.col("n_nationkey").cast("string"), F.lit("x"))).alias("aliases"),
        F.concat(F.col("n_nationkey").cast("string"), F.lit("-"), (F.col("n_nationkey") + 5).cast("string")).alias("group_range"), F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).alias("body_type"), F.lit("Family").alias("group_category"),
    )
    model = F.expr("CASE c_custkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN concat('AL', n_nationkey, '-X') WHEN 2 THEN concat(n_name, ' GLX') ELSE 'qq' END")
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    sourced = F.col("c_custkey") % 11 == 0
    rows = rows.select("c_custkey", F.col("r_name").alias("make"), model.alias("model"), F.when(sourced, "N1").alias("official"), none.alias("bodywork"), none.alias("segment"), F.when(sourced, "register").alias("source"))
    return rows, catalogue


VEHICLES = """WITH v AS (SELECT c_custkey, n_nationkey AS k, lower(n_name) AS body, r_name AS make, CASE c_custkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN 'AL' || n_nationkey || '-X' WHEN 2 THEN n_name || ' GLX' ELSE 'qq' END AS model
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
found AS (SELECT *, CASE c_custkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'alias' WHEN 2 THEN 'model_family' ELSE 'manual_review' END AS match_status FROM v)
"""


@query(VEHICLES + """SELECT DISTINCT make, model, CASE WHEN match_status <> 'manual_review' THEN k || '-' || (k + 5) END AS group_range, match_status FROM found""")
def j6_lookup_vehicle(spark, sf_dir):
    rows, catalogue = _vehicles(spark, sf_dir)
    return V.lookup_vehicle(rows, catalogue).select("make", "model", "group_range", "match_status")


@query(VEHICLES + """SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'N1 Light Commercial Vehicle (LCV)' WHEN match_status = 'manual_review' THEN 'Unclassified' WHEN k % 2 = 0 THEN body
 ELSE 'Insurance group ' || k || '-' || (k + 5) || ' ' || chr(8212) || ' Family' END AS vehicle_label FROM found""")
def j7_vehicle_label(spark, sf_dir):
    rows, catalogue = _vehicles(spark, sf_dir)
    return V.vehicle_label(rows, catalogue).select("c_custkey", "vehicle_label")


def _extracted(spark, sf_dir):
    """Lines as two extractions saw them: the first lacks every third line and many fields, the second has all lines."""
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    seq = F.expr("row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)").cast("long")
    rows = line.select(F.col("l_orderkey").alias("invoice_ref"), seq.alias("sequence_no"), F.lower("p_name").alias("description"), pence(F.col("l_extendedprice").cast("decimal(20,2)")).alias("total"), F.col("l_quantity").cast("long").alias("quantity"), "l_partkey")
    kind = F.when(F.col("l_partkey") % 5 == 0, "unknown").otherwise("part")
    number = F.when(F.col("l_partkey") % 4 != 0, F.concat(F.lit("PN"), F.col("l_partkey").cast("string")))
    first = rows.where("sequence_no % 3 <> 0").select("invoice_ref", "sequence_no", "description", "total", kind.alias("item_kind"), F.lit(None).cast("string").alias("part_number"), F.when(F.col("sequence_no") % 2 == 0, F.col("quantity")).alias("quantity"))
    second = rows.select("invoice_ref", "sequence_no", "description", "total", F.lit("service").alias("item_kind"), number.alias("part_number"), "quantity")
    return first, second


EXTRACTED = f"""WITH r AS (SELECT l_orderkey AS invoice_ref, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS sequence_no, lower(p_name) AS description,
 {CENTS} AS total, l_quantity::BIGINT AS quantity, l_partkey AS k FROM lineitem JOIN part ON l_partkey = p_partkey),
p AS (SELECT *, row_number() OVER (PARTITION BY invoice_ref, description, total ORDER BY sequence_no) AS nth FROM (SELECT *, CASE WHEN k % 5 = 0 THEN 'unknown' ELSE 'part' END AS kind, CASE WHEN sequence_no % 2 = 0 THEN quantity END AS q FROM r WHERE sequence_no % 3 <> 0)),
s AS (SELECT *, CASE WHEN k % 4 <> 0 THEN 'PN' || k END AS number, row_number() OVER (PARTITION BY invoice_ref, description, total ORDER BY sequence_no) AS nth FROM r)
"""


@query(EXTRACTED + """, b AS (SELECT coalesce(p.invoice_ref, s.invoice_ref) AS invoice_ref, p.sequence_no AS own, s.sequence_no AS other, coalesce(p.description, s.description) AS description, coalesce(p.total, s.total) AS total,
 CASE WHEN p.kind <> 'unknown' THEN p.kind ELSE 'service' END AS item_kind, s.number AS part_number, coalesce(p.q, s.quantity) AS quantity, CASE WHEN p.nth IS NULL THEN 'secondary' ELSE 'primary' END AS origin
 FROM p FULL JOIN s ON p.invoice_ref = s.invoice_ref AND p.description = s.description AND p.total = s.total AND p.nth = s.nth)
SELECT invoice_ref, CASE WHEN origin = 'primary' THEN own ELSE row_number() OVER (PARTITION BY invoice_ref ORDER BY origin, other) END AS sequence_no, description, total, item_kind, part_number, quantity, origin FROM b""")
def j18_merge_lines(spark, sf_dir):
    return X.merge_lines(*_extracted(spark, sf_dir))


@query("""SELECT o_orderkey AS invoice_ref, CASE WHEN o_orderkey % 3 = 0 THEN 'AI-' || o_orderkey ELSE 'INV-' || o_orderkey END AS number, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 5 = 0 THEN NULL ELSE (o_totalprice::DECIMAL(20,2) * 100)::BIGINT END AS gross FROM orders""")
def j18_merge_headers(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("invoice_ref"), pence(F.col("o_totalprice").cast("decimal(20,2)")).alias("gross"))
    text = F.col("invoice_ref").cast("string")
    first = orders.select("invoice_ref", F.when(F.col("invoice_ref") % 3 == 0, "").otherwise(F.concat(F.lit("INV-"), text)).alias("number"), F.when(F.col("invoice_ref") % 4 != 0, F.col("gross")).alias("gross"))
    second = orders.select("invoice_ref", F.concat(F.lit("AI-"), text).alias("number"), F.when(F.col("invoice_ref") % 5 != 0, F.col("gross")).alias("gross"))
    return X.merge_headers(first, second)


@query("""SELECT DISTINCT l_orderkey AS invoice_ref FROM lineitem WHERE l_partkey % 40 = 0 OR l_partkey % 50 = 7""")
def x8_benchmarkable(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_partkey") % 40 == 0, "Part").otherwise("labour")
    lines = line.select(F.col("l_orderkey").alias("invoice_ref"), F.lit("brake pads").alias("description"), kind.alias("item_kind"), F.when(F.col("l_partkey") % 50 == 7, "PN7").alias("part_number"), pence(F.col("l_extendedprice").cast("decimal(20,2)")).alias("total"))
    return X.benchmarkable(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("invoice_ref")), lines)


@query("""WITH l AS (SELECT l_orderkey AS k, l_partkey % 30 = 0 AS mot FROM lineitem), n AS (SELECT k, count(*) AS n, max(mot::INT) = 1 AS has FROM l GROUP BY 1)
SELECT k AS invoice_ref, n + 1 AS sequence_no, 5485::BIGINT AS total FROM n WHERE k % 4 = 0 AND NOT has UNION ALL SELECT o_orderkey, 1, 5485 FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey NOT IN (SELECT k FROM n)""")
def x9_add_mot_line(spark, sf_dir):
    """The added lines only."""
    service = F.col("l_partkey") % 30 == 0
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("invoice_ref"), F.col("l_linenumber").cast("long").alias("sequence_no"), F.when(service, "annual mot").otherwise("mot certificate holder").alias("description"), F.when(service, "service").otherwise("part").alias("item_kind"), F.lit(1000).cast("long").alias("total"), F.lit(20).alias("vat_rate"))
    totals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("invoice_ref"), F.when(F.col("o_orderkey") % 4 == 0, F.lit(5485).cast("long")).alias("exempt"))
    return X.add_mot_line(totals, lines).where("vat_rate = 0").select("invoice_ref", "sequence_no", "total")


@query("""SELECT page_id AS document_id, 1 AS page_number, CASE WHEN page_id % 6 = 0 THEN 'estimate' WHEN page_id % 6 = 1 THEN 'other' ELSE 'invoice' END AS page_type, CASE WHEN page_id % 6 = 0 THEN 90 ELSE 0 END AS rotation, 'g' || (page_id // 3) AS group_key,
 CASE WHEN page_id % 6 < 2 THEN 'corrected' WHEN page_id % 10 < 7 THEN 'needs_review' ELSE 'pending' END AS review_status FROM pages""")
def x10_page_corrections(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("document_id"), F.lit(1).alias("page_number"), F.lit("invoice").alias("page_type"), F.lit(0).alias("rotation"), F.concat(F.lit("g"), F.expr("page_id div 3").cast("string")).alias("group_key"), ((F.col("page_id") % 10) / 10).alias("confidence"))
    fixed = pages.where("document_id % 6 < 2")
    first = F.col("document_id") % 6 == 0
    fixes = fixed.select("document_id", "page_number", F.when(first, "estimate").otherwise("letter").alias("page_type"), F.when(first, F.lit(90)).alias("rotation"), F.lit(None).cast("string").alias("group_key"))
    return X.apply_page_corrections(pages, fixes, ["invoice", "estimate", "other"]).drop("confidence")


BUNDLES = f"""WITH l AS (SELECT l_orderkey AS line_id, sum({CENTS})::BIGINT AS net, count(*) AS n, sum(CASE WHEN l_orderkey % 5 = 0 OR (l_orderkey % 5 = 1 AND l_linenumber = 1) THEN NULL ELSE {CENTS} END)::BIGINT AS allocated,
 count(CASE WHEN l_orderkey % 5 = 0 OR (l_orderkey % 5 = 1 AND l_linenumber = 1) THEN NULL ELSE 1 END) AS given FROM lineitem GROUP BY 1)
"""


@query(BUNDLES + """SELECT line_id, n AS n_components, allocated, CASE WHEN n < 2 THEN 'too_few_components' WHEN given = 0 THEN 'unresolved' WHEN given < n THEN 'partly_allocated' WHEN line_id % 5 = 2 THEN 'sum_differs' ELSE 'resolved' END AS state FROM l""")
def g11_bundle_allocations(spark, sf_dir):
    """An order is one billed line, its items are the components."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line_id"), "l_linenumber", pence(F.col("l_extendedprice").cast("decimal(20,2)")).alias("net"))
    none = (F.col("line_id") % 5 == 0) | ((F.col("line_id") % 5 == 1) & (F.col("l_linenumber") == 1))
    components = line.select("line_id", F.when(~none, F.col("net")).alias("allocated"))
    billed = line.groupBy("line_id").agg(F.sum("net").alias("billed")).withColumn("billed", F.col("billed") + F.when(F.col("line_id") % 5 == 2, 1).otherwise(0))
    return X.bundle_allocations(billed, components)


@query(OBS + """, b AS (SELECT *, greatest(cost - reference, 0) AS r FROM obs WHERE cost > 0), p AS (SELECT *, r >= 500 AND (20000 * r + cost) // (2 * cost) >= 500 AS pass FROM b)
SELECT invoice_ref AS line_id, sum(cost)::BIGINT AS billed, sum(CASE WHEN pass THEN r ELSE 0 END)::BIGINT AS challenge_net, sum(CASE WHEN pass THEN (2 * r * vat_rate + 100) // 200 ELSE 0 END)::BIGINT AS vat_impact, sum(reference)::BIGINT AS reference_total,
 (sum(cost) - sum(CASE WHEN pass THEN r ELSE 0 END))::BIGINT AS challenge_price FROM p GROUP BY 1""")
def g11_bundle_summary(spark, sf_dir):
    """Components with an approved price for the whole job and no history, summed over their order."""
    rows = _scoped(spark, sf_dir).where("billed > 0").withColumn("scope", F.lit("job")).withColumn("approved", F.lit(True)).withColumn("vatable", F.lit(True))
    rows = rows.withColumn("eligible_count", F.lit(0).cast("long")).withColumn("median_line", F.lit(None).cast("long"))
    compared = C.compare_lines(rows).withColumn("line_id", F.col("invoice_ref"))
    return X.bundle_summary(compared).select("line_id", "billed", "challenge_net", "vat_impact", "reference_total", "challenge_price")
