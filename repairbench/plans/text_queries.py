"""Text functions and mapping on the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from repairbench.functions import rules as R
from repairbench.functions import text as T
from repairbench.operators import mapping as M

from .binding import table
from .registered import register

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = register(QUERIES, ORACLES)

# Descriptions as invoices write them, made of part names by fixed rules.
WRITTEN = """CASE p_partkey % 6 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'FRT ' || p_name WHEN 2 THEN p_name || '  (N/S) assy' WHEN 3 THEN 'R&R ' || p_name || ' pads'
 WHEN 4 THEN 'oil disposal' ELSE 'carried out service: ' || p_name END"""
NORMAL = r"""trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper({c}),
 '(^|[^A-Z0-9])FRT($|[^A-Z0-9])', '\1FRONT\2', 'g'), '(^|[^A-Z0-9])N/S($|[^A-Z0-9])', '\1NEARSIDE\2', 'g'), '(^|[^A-Z0-9])ASSY($|[^A-Z0-9])', '\1ASSEMBLY\2', 'g'), '(^|[^A-Z0-9])R&R($|[^A-Z0-9])', '\1REMOVE AND REPLACE\2', 'g')),
 '[^a-z0-9/&+.-]+', ' ', 'g'))"""


def _written(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", F.expr(WRITTEN).alias("written"))


@query(f"SELECT p_partkey, {NORMAL.format(c='w')} AS normal FROM (SELECT p_partkey, {WRITTEN} AS w FROM part)")
def t1_normalise_description(spark, sf_dir):
    return _written(spark, sf_dir).select("p_partkey", T.normalise_description(F.col("written")).alias("normal"))


UNITS = "CASE p_partkey % 9 WHEN 0 THEN 'EA' WHEN 1 THEN 'Hours' WHEN 2 THEN ' hrs ' WHEN 3 THEN 'Litres' WHEN 4 THEN 'sets' WHEN 5 THEN '' WHEN 6 THEN NULL WHEN 7 THEN 'pallet' ELSE 'job' END"
KIND = "CASE p_partkey % 2 WHEN 0 THEN 'labour' ELSE 'part' END"


@query(f"""SELECT p_partkey, CASE WHEN u = 'ea' THEN 'each' WHEN u IN ('hour', 'hr') THEN 'hour' WHEN u = 'litre' THEN 'litre' WHEN u = 'set' THEN 'set' WHEN u = 'job' THEN 'job' WHEN k = 'labour' THEN 'hour' WHEN u = '' THEN 'each' ELSE u END AS unit,
 CASE WHEN s IN ('job', 'test', 'set', 'pair') THEN s WHEN s IN ('hour', 'hr', 'hrs', 'hours') THEN 'hour' WHEN s IN ('litre', 'litres', 'l', 'ltr') THEN 'litre' ELSE 'each' END AS scope
FROM (SELECT p_partkey, regexp_replace(trim(lower(coalesce({UNITS}, ''))), 's+$', '') AS u, lower(trim(coalesce({UNITS}, 'each'))) AS s, {KIND} AS k FROM part)""")
def t2_t3_units(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(UNITS).alias("u"), F.expr(KIND).alias("k"))
    return rows.select("p_partkey", T.normalise_unit(F.col("u"), F.col("k")).alias("unit"), T.price_scope(F.col("u")).alias("scope"))


@query("""SELECT s_suppkey, regexp_replace(upper(s_name), '[^A-Z0-9]', '', 'g') AS part_key, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS supplier_key,
 lower(trim(regexp_replace('  ' || s_name || '   Ltd ', '\\s+', ' ', 'g'))) AS repairer_key FROM supplier""".replace("\\\\", "\\"))
def t4_t6_keys(spark, sf_dir):
    name = F.col("s_name")
    shown = F.concat(F.lit("  "), name, F.lit("   Ltd "))
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.part_number_key(name).alias("part_key"), T.supplier_key(name).alias("supplier_key"), T.repairer_key(shown).alias("repairer_key"))


@query(f"""SELECT p_partkey, CASE WHEN n = 'oil disposal' THEN 'oil & filter / environmental disposal charge' ELSE n END AS alias, CASE WHEN n = 'oil disposal' THEN 'Oil & Filter Disposal' ELSE n END AS category
FROM (SELECT p_partkey, {NORMAL.format(c='w')} AS n FROM (SELECT p_partkey, {WRITTEN} AS w FROM part))""")
def t7_t8_aliases(spark, sf_dir):
    normal = T.normalise_description(F.col("written"))
    return _written(spark, sf_dir).select("p_partkey", T.apply_invoice_aliases(normal).alias("alias"), T.benchmark_category(normal).alias("category"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'remove refit ' || p_name WHEN 1 THEN 'front bumper remove refit' WHEN 2 THEN 'vehicle recovery' ELSE p_name END AS operation FROM part""")
def t9_normalise_operation(spark, sf_dir):
    written = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'R and R ' || p_name WHEN 1 THEN 'Repair paint: front-bumper' WHEN 2 THEN 'Standard VEHICLE recovery' ELSE p_name END")
    return table(spark, sf_dir, "part").select("p_partkey", T.normalise_operation(written).alias("operation"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN round(o_totalprice::DECIMAL(30,10), 2)::DOUBLE END AS money, CASE WHEN o_orderkey % 7 < 6 THEN o_orderdate::DATE END AS day FROM orders""")
def t10_parse_money_date(spark, sf_dir):
    money = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.concat(F.lit("£"), F.format_number(F.col("o_totalprice").cast("decimal(20,2)"), 2)))
    forms, k = ["dd/MM/yyyy", "dd-MM-yyyy", "dd/MM/yy", "yyyy-MM-dd", "d/M/yyyy", "d-M-yyyy"], F.col("o_orderkey") % 7
    day = F.coalesce(*[F.when(k == i, F.date_format("o_orderdate", form)) for i, form in enumerate(forms)], F.lit("31/02/2024"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.parse_money(money).cast("double").alias("money"), T.parse_uk_date(day).alias("day"))


@query(r"""SELECT doc_id, sha256(text) AS original_sha256, len(regexp_extract_all(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b')) AS emails,
 regexp_matches(text, '(?i)ignore\s+(?:all\s+)?(?:previous|prior|system)\s+instructions') AS ignores FROM documents WHERE text IS NOT NULL""")
def t12_t13_redact(spark, sf_dir):
    rows = T.redact(table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text"), "text")
    return rows.select("doc_id", F.sha2("text", 256).alias("original_sha256"), F.col("n_email").alias("emails"), F.array_contains("flags", "IGNORE_INSTRUCTIONS").alias("ignores"))


@query()
def t12_t13_redact_all(spark, sf_dir):
    """All counts, all flags and the redacted text's digest, null texts included; RE2 has no look-around for SQL."""
    rows = T.redact(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    found = [F.col(f"n_{name.lower()}").alias(name.lower() + "s") for name, _ in T.REDACTIONS]
    flags = [F.array_contains("flags", name).alias(name.lower()) for name, _ in T.INJECTIONS]
    return rows.select("doc_id", F.sha2("text", 256).alias("original_sha256"), F.sha2("redacted", 256).alias("redacted_sha256"), *found, *flags)


@query("""SELECT page_id, CASE WHEN position('#' IN url) > 0 THEN left(url, position('#' IN url) - 1) ELSE url END AS identity, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host,
 regexp_extract(url, '^https?://([^/?#]*)', 1) LIKE '%.example.org' AS allowed FROM pages""")
def t15_url_identity(spark, sf_dir):
    host = T.url_host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", T.url_identity(F.col("url")).alias("identity"), host.alias("host"), F.endswith(host, F.lit(".example.org")).alias("allowed"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'labour' WHEN 1 THEN 'service' WHEN 2 THEN 'disposal' WHEN 3 THEN 'part' ELSE 'unknown' END AS kind FROM part""")
def x5_item_kind(spark, sf_dir):
    section = F.expr("CASE p_partkey % 5 WHEN 0 THEN 'Labour' WHEN 3 THEN 'Parts' ELSE '' END")
    text = F.expr("CASE p_partkey % 5 WHEN 1 THEN 'Carried out MOT on ' || p_name WHEN 2 THEN 'waste oil filter charge' ELSE 'zz' END")
    return table(spark, sf_dir, "part").select("p_partkey", R.item_kind(section, text).alias("kind"))


def _mapping(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.groupBy("p_name").agg(F.min("p_partkey").alias("item_id"))
    synonyms = F.array(F.concat(F.lit("carried out service "), "p_name"), F.concat(F.lit("front "), "p_name"))
    items = names.select("item_id", F.col("p_name").alias("name"), F.lit("part").alias("item_type"), synonyms.alias("synonyms"), F.array(F.concat(F.lit("PN-"), F.col("item_id").cast("string"))).alias("part_numbers"))
    kind = F.when(F.col("p_partkey") % 7 == 0, "labour").otherwise("part")
    lines = part.select(F.col("p_partkey").alias("line_id"), F.expr(WRITTEN).alias("description"), F.when(F.col("p_partkey") % 11 == 0, F.concat(F.lit("pn"), F.col("p_partkey").cast("string"))).alias("part_number"), kind.alias("kind"))
    return lines, items


@query(f"""WITH i AS (SELECT min(p_partkey) AS item_id, p_name AS name FROM part GROUP BY p_name),
l AS (SELECT p_partkey AS line_id, {NORMAL.format(c=WRITTEN)} AS text, CASE WHEN p_partkey % 11 = 0 THEN p_partkey END AS pn, p_partkey % 7 = 0 AS labour FROM part),
m1 AS (SELECT line_id, item_id, 1.0 AS confidence, 'exact_part_number' AS decision FROM l JOIN i ON pn = item_id),
n AS (SELECT item_id, name AS text, 0.99 AS confidence FROM i UNION ALL SELECT item_id, 'carried out service ' || name, 0.98 FROM i UNION ALL SELECT item_id, 'front ' || name, 0.98 FROM i),
m2 AS (SELECT line_id, item_id, max(n.confidence) AS confidence, 'synonym' AS decision FROM l JOIN n USING (text) WHERE line_id NOT IN (SELECT line_id FROM m1) GROUP BY 1, 2),
m AS (FROM m1 UNION ALL FROM m2),
best AS (SELECT m.*, count(*) OVER (PARTITION BY line_id) AS candidates, row_number() OVER (PARTITION BY line_id ORDER BY confidence DESC, item_id) AS place FROM m)
SELECT l.line_id, CASE WHEN NOT labour THEN item_id END AS item_id, CASE WHEN NOT labour THEN confidence::DOUBLE END AS confidence, CASE WHEN labour OR item_id IS NULL THEN 'no_match' ELSE decision END AS decision, coalesce(candidates, 0) AS candidates,
 coalesce(others, '') AS alternatives, CASE WHEN NOT labour AND confidence > 0.95 THEN 'auto_accepted' ELSE 'review' END AS status, labour AND item_id IS NOT NULL AS type_mismatch
FROM l LEFT JOIN best ON l.line_id = best.line_id AND place = 1 LEFT JOIN (SELECT line_id, string_agg(item_id || ':' || (confidence * 100)::INT, ',' ORDER BY place) AS others FROM best JOIN l USING (line_id) WHERE place <= 8 AND (labour OR place > 1) GROUP BY 1) o ON l.line_id = o.line_id""")
def j1_j2_j4_map_lines(spark, sf_dir):
    """The rungs that SQL can express, J1 and J2; `j1_j4_map_lines` is the whole ladder."""
    lines, items = _mapping(spark, sf_dir)
    return _told(M.map_lines(lines, items, fuzzy_least=None))


def _told(mapped):
    others = F.transform("alternatives", lambda x: F.concat(x["item_id"].cast("string"), F.lit(":"), F.round(x["confidence"] * 100).cast("int").cast("string")))
    return mapped.withColumn("alternatives", F.coalesce(F.array_join(others, ","), F.lit("")))


@query()
def j1_j4_map_lines(spark, sf_dir):
    """The whole ladder: J1, J2, then J3 for what is left. SQL can't score the third rung."""
    lines, items = _mapping(spark, sf_dir)
    return _told(M.map_lines(lines, items))


@query()
def j3_match_fuzzy(spark, sf_dir):
    lines, items = _mapping(spark, sf_dir)
    texts = lines.withColumn("text", T.apply_invoice_aliases(T.normalise_description(F.col("description"))))
    return M.match_fuzzy(texts, items)
