"""Benchmarks, rolling P90 and the repairer network on the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from repairbench.functions.exact import pounds
from repairbench.operators import benchmarks as B
from repairbench.operators import network as N
from repairbench.sources.shared import written

from .binding import OBS, observations
from .registered import register

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = register(QUERIES, ORACLES)
KEYS = ["item_name", "vehicle_label"]

JUDGED = OBS + """
, ranked AS (SELECT *, dense_rank() OVER (PARTITION BY item_name, vehicle_label ORDER BY invoice_date, invoice_ref) AS rk FROM obs WHERE role = 'invoice'),
prior AS (SELECT *, list_sort(coalesce(list(cost) OVER (PARTITION BY item_name, vehicle_label ORDER BY rk RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), [])) AS v FROM ranked),
placed AS (SELECT *, len(v) AS history, (len(v) - 1) * 9 // 10 AS lo, (len(v) - 1) * 9 % 10 AS f FROM prior),
judged AS (SELECT *, CASE WHEN history > 0 THEN (2 * (v[lo + 1] * 10 + (v[least(lo + 2, history)] - v[lo + 1]) * f) + 10) // 20 END AS p90 FROM placed),
gaps AS (SELECT *, cost - p90 AS difference FROM judged),
found AS (SELECT *, ((difference * 1000) // p90 + CASE WHEN 2 * ((difference * 1000) % p90) > p90 OR (2 * ((difference * 1000) % p90) = p90 AND ((difference * 1000) // p90) % 2 = 1) THEN 1 ELSE 0 END) / 10.0 AS percent_above
  FROM gaps WHERE history >= 3 AND p90 > 0 AND difference >= 500 AND difference * 100 > p90 * 10)
"""


def _obs(spark, sf_dir):
    rows = observations(spark, sf_dir).where("role = 'invoice'")
    return rows.withColumn("cost", F.col("billed")).withColumn("price", F.col("line_total"))


def _bound(spark, sf_dir, *columns):
    """What rolling P90 needs of the lines, and columns for its readers, joined once."""
    return written(_obs(spark, sf_dir).select(*KEYS, "invoice_date", "invoice_ref", "cost", *columns), "lines")


@query(OBS + """SELECT line_id, coalesce(nullif(CASE WHEN quantity % 5 = 0 THEN 0 WHEN quantity % 7 = 0 THEN NULL ELSE cost END, 0), nullif(unit_cost, 0)) / 100.0 AS observed_cost FROM obs""")
def c1_observed_cost(spark, sf_dir):
    total = F.when(F.col("quantity") % 5 == 0, F.lit(0).cast("decimal(20,2)")).when(F.col("quantity") % 7 == 0, None).otherwise(F.col("line_total"))
    return observations(spark, sf_dir).select("line_id", B.observed_cost(total, F.col("unit_price")).cast("double").alias("observed_cost"))


@query(JUDGED + "SELECT line_id, history, p90 / 100.0 AS p90 FROM judged")
def w1_rolling_p90(spark, sf_dir):
    return B.rolling_p90(_bound(spark, sf_dir, "line_id"), KEYS).select("line_id", "history", pounds(F.col("p90")).alias("p90"))


@query(JUDGED + "SELECT line_id, repairer, item_name, vehicle_label, cost / 100.0 AS amount, p90 / 100.0 AS p90, difference / 100.0 AS difference, percent_above, history FROM found")
def w1_p90_exceptions(spark, sf_dir):
    found = B.p90_exceptions(_bound(spark, sf_dir, "line_id", "repairer"), KEYS)
    return found.select("line_id", "repairer", "item_name", "vehicle_label", pounds(F.col("cost")).alias("amount"), pounds(F.col("p90")).alias("p90"), pounds(F.col("difference")).alias("difference"), "percent_above", "history")


@query(JUDGED + """SELECT min(repairer) AS repairer, count(*) AS challenge_count, count(DISTINCT invoice_ref) AS invoice_count, sum(difference)::BIGINT / 100.0 AS total_difference,
  max(difference) / 100.0 AS maximum_difference, count(DISTINCT item_name) AS item_count FROM found GROUP BY lower(trim(repairer))""")
def w1_g14_repairer_trends(spark, sf_dir):
    return N.repairer_trends(B.p90_exceptions(_bound(spark, sf_dir, "line_id", "repairer"), KEYS))


@query(JUDGED + """SELECT min(repairer) AS repairer, item_name, count(*) AS challenge_count, count(DISTINCT invoice_ref) AS invoice_count, sum(difference)::BIGINT AS total, max(difference) AS largest,
  max(percent_above) AS maximum_percent FROM found GROUP BY lower(trim(repairer)), item_name""")
def g14_repairer_item_trends(spark, sf_dir):
    return N.repairer_item_trends(B.p90_exceptions(_bound(spark, sf_dir, "line_id", "repairer"), KEYS)).drop("repairer_key")


SHOWN = JUDGED + """, keyed AS (SELECT *, lower(trim(repairer)) AS repairer_key FROM found),
top AS (SELECT repairer_key FROM keyed GROUP BY 1 ORDER BY count(DISTINCT invoice_ref) DESC, count(*) DESC, repairer_key LIMIT 8),
theirs AS (SELECT * FROM keyed WHERE repairer_key IN (FROM top)),
most AS (SELECT item_name FROM theirs GROUP BY 1 ORDER BY count(DISTINCT invoice_ref) DESC, count(*) DESC, item_name LIMIT 10),
shown AS (SELECT * FROM theirs WHERE item_name IN (FROM most))
"""


@query(SHOWN + "SELECT repairer_key, item_name, count(*) AS challenge_count, count(DISTINCT invoice_ref) AS invoice_count, sum(difference)::BIGINT AS total FROM shown GROUP BY 1, 2")
def g15_repairer_graph(spark, sf_dir):
    return N.repairer_graph(written(B.p90_exceptions(_bound(spark, sf_dir, "repairer"), KEYS), "exceptions")).select("repairer_key", "item_name", "challenge_count", "invoice_count", "total")


@query(SHOWN + """SELECT count(DISTINCT invoice_ref) AS invoice_count, count(*) AS challenge_count, sum(difference)::BIGINT AS total,
 (SELECT repairer_key FROM keyed GROUP BY 1 ORDER BY count(DISTINCT invoice_ref) DESC, count(*) DESC, repairer_key LIMIT 1) AS top_repairer,
 (SELECT item_name FROM shown GROUP BY 1 ORDER BY count(DISTINCT invoice_ref) DESC, count(*) DESC, item_name LIMIT 1) AS top_item FROM shown""")
def g15_graph_totals(spark, sf_dir):
    return N.graph_totals(written(B.p90_exceptions(_bound(spark, sf_dir, "repairer"), KEYS), "exceptions"))


def _stats(keys: str, value: str = "cost") -> str:
    part = lambda num, den: f"(n - 1) * {num} // {den} + 1"
    times = lambda num, den: f"(v[{part(num, den)}] * {den} + (v[least({part(num, den)} + 1, n)] - v[{part(num, den)}]) * ((n - 1) * {num} % {den}))"
    return f""", grouped AS (SELECT {keys}, list_sort(list({value})) AS v, count(*) AS n, sum({value})::BIGINT AS total FROM obs WHERE role = 'invoice' AND {value} > 0 GROUP BY {keys}),
perc AS (SELECT *, {times(1, 4)} AS p25, {times(1, 2)} AS p50, {times(3, 4)} AS p75, {times(9, 10)} AS p90 FROM grouped),
freq AS (SELECT {keys}, x, count(*) AS c FROM grouped, unnest(v) AS t(x) GROUP BY {keys}, x),
modes AS (SELECT {keys}, CASE WHEN max(c) > 1 AND count(*) FILTER (c = m) = 1 THEN min(x) FILTER (c = m) END AS mode FROM (SELECT *, max(c) OVER (PARTITION BY {keys}) AS m FROM freq) GROUP BY {keys}),
stats AS (SELECT {keys}, v[1] / 100.0 AS minimum, v[n] / 100.0 AS maximum, ((2 * total + n) // (2 * n)) / 100.0 AS mean, ((2 * p50 + 2) // 4) / 100.0 AS median, mode / 100.0 AS mode,
  ((2 * p25 + 4) // 8) / 100.0 AS percentile_25, ((2 * p75 + 4) // 8) / 100.0 AS percentile_75, ((2 * p90 + 10) // 20) / 100.0 AS percentile_90,
  len(list_filter(v, lambda x: 8 * x < 5 * p25 - 3 * p75 OR 8 * x > 5 * p75 - 3 * p25)) AS outlier_count, n AS count FROM perc JOIN modes USING ({keys}))
"""


@query(OBS + _stats("item_name, vehicle_label") + "SELECT * FROM stats")
def g1_benchmark_statistics(spark, sf_dir):
    return B.benchmark_statistics(_obs(spark, sf_dir), KEYS, "price")


@query(JUDGED + _stats("item_name, vehicle_label") + """, extra AS (SELECT item_name, vehicle_label, count(*) AS source_rows, count(DISTINCT invoice_ref) AS invoice_count, max(invoice_date) AS latest_date FROM obs WHERE role = 'invoice' GROUP BY 1, 2),
 over AS (SELECT item_name, vehicle_label, count(*) AS e FROM found GROUP BY 1, 2)
SELECT stats.*, source_rows, invoice_count, latest_date, coalesce(e, 0) AS exception_count, CASE WHEN count >= 10 THEN 'strong' WHEN count >= 3 THEN 'usable' ELSE 'weak' END AS sample_strength
FROM stats JOIN extra USING (item_name, vehicle_label) LEFT JOIN over USING (item_name, vehicle_label)""")
def g2_benchmark_table(spark, sf_dir):
    return B.benchmark_table(_bound(spark, sf_dir, "price"), KEYS)


@query(OBS + "SELECT vehicle_label, ((2 * sum(cost)::BIGINT + count(*)) // (2 * count(*))) / 100.0 AS average_cost, count(*) AS observation_count FROM obs WHERE role = 'invoice' AND cost > 0 GROUP BY 1")
def g3_category_averages(spark, sf_dir):
    return B.category_averages(_obs(spark, sf_dir), "vehicle_label")


RATED = OBS.replace("WITH obs", "WITH base") + ", obs AS (SELECT *, CASE WHEN vat_rate = 2 THEN 4500 + quantity WHEN item_type = 'ECONOMY' AND quantity % 3 = 0 THEN unit_cost END AS rate FROM base)"


def _rated(spark, sf_dir):
    """One part type stands for labour; some lines tell their rate, others are by the hour."""
    told = F.when(F.col("vat_rate") == 2, (4500 + F.col("quantity").cast("long")))
    kind, unit = F.when(F.col("item_type") == "ECONOMY", "labour").otherwise("part"), F.when(F.col("quantity") % 3 == 0, "hrs").otherwise("each")
    return _obs(spark, sf_dir).withColumn("rate_pence", B.labour_rate(told, F.col("unit_cost"), kind, unit))


@query(RATED + _stats("item_name", "rate") + "SELECT * FROM stats")
def g4_labour_rates(spark, sf_dir):
    rows = _rated(spark, sf_dir).withColumn("rate", (F.col("rate_pence").cast("decimal(20,0)") / 100).cast("decimal(20,2)"))
    return B.benchmark_statistics(rows, ["item_name"], "rate")


@query(RATED + """, i AS (SELECT * FROM obs WHERE role = 'invoice' AND cost > 0),
n AS (SELECT item_name, count(*) AS c, (2 * sum(cost)::BIGINT + count(*)) // (2 * count(*)) AS m FROM i GROUP BY 1)
SELECT (SELECT ((2 * sum(cost)::BIGINT + count(*)) // (2 * count(*))) / 100.0 FROM i) AS average_cost, (SELECT count(*) FROM i) AS observation_count,
  (SELECT item_name FROM n ORDER BY c DESC, item_name LIMIT 1) AS most_observed, (SELECT item_name FROM n ORDER BY m DESC, item_name LIMIT 1) AS most_expensive, (SELECT max(m) / 100.0 FROM n) AS highest_mean,
  (SELECT ((2 * sum(rate)::BIGINT + count(*)) // (2 * count(*))) / 100.0 FROM i WHERE rate > 0) AS average_labour_rate""")
def g5_dashboard_summary(spark, sf_dir):
    rows = _rated(spark, sf_dir).where("cost > 0")
    rated = F.when(F.col("rate_pence") > 0, F.col("rate_pence"))
    items = rows.groupBy("item_name").agg(F.count("*").alias("c"), F.sum("cost").alias("s"), F.sum(rated).alias("r"), F.count(rated).alias("k"))
    mean = F.expr("(2 * s + c) div (2 * c)")
    named = items.agg(
        F.expr("((2 * sum(s) + sum(c)) div (2 * sum(c))) / 100.0D").alias("average_cost"), F.sum("c").alias("observation_count"),
        F.min_by("item_name", F.struct(-F.col("c"), "item_name")).alias("most_observed"), F.min_by("item_name", F.struct(-mean, "item_name")).alias("most_expensive"), pounds(F.max(mean)).alias("highest_mean"),
        F.expr("((2 * sum(r) + sum(k)) div (2 * sum(k))) / 100.0D").alias("average_labour_rate"),
    )
    return named


@query(OBS + """SELECT count(*) AS invoice_rows, count(*) FILTER (cost > 0) AS valid_costs, count(*) - count(*) FILTER (cost > 0) AS invalid_costs, count(*) FILTER (vehicle_label <> 'Unclassified') AS classified,
 count(*) FILTER (vehicle_label = 'Unclassified') AS unclassified, ((2000 * count(*) FILTER (vehicle_label <> 'Unclassified') + count(*)) // (2 * count(*))) / 10.0 AS coverage_percent, max(invoice_date) AS latest_date FROM obs WHERE role = 'invoice'""")
def g6_data_quality(spark, sf_dir):
    return B.data_quality(_obs(spark, sf_dir))


@query(OBS + """SELECT item_id, line_id, place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY invoice_date DESC NULLS LAST, invoice_ref DESC, line_id DESC) AS place FROM obs WHERE role = 'invoice')
WHERE place <= 5 AND vehicle_label = 'Segment: BUILDING'""")
def w4_benchmark_sources(spark, sf_dir):
    """The limit comes before the vehicle filter."""
    return B.benchmark_sources(_obs(spark, sf_dir), "item_id", 5).where("vehicle_label = 'Segment: BUILDING'").select("item_id", "line_id", "place")


@query(OBS + _stats("item_name") + "SELECT item_name, mode, percentile_90, row_number() OVER (ORDER BY mode DESC NULLS LAST, item_name) AS place FROM stats")
def w5_benchmark_sort(spark, sf_dir):
    """Largest mode first, nulls lowest, names break ties; the place is a rank over the few aggregated rows."""
    from pyspark.sql.window import Window

    stats = B.benchmark_statistics(_obs(spark, sf_dir), ["item_name"], "price")
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("mode"), "item_name"))
    return stats.select("item_name", "mode", "percentile_90", place.alias("place"))
