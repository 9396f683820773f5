"""What the library's concepts are in the test tables: an observation is a line item with its order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repairbench.functions.exact import half_up
from repairbench.sources.shared import small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each invoice line: keys, names, money in pounds (decimal) and in pence, quantity, role and review status.

    The joins are plain equi-joins. Orders meet their customers before any line, and few suppliers are broadcast, so that lines
    shuffle by order and by part only. Pence (billed, unit_cost, reference) and ten-thousandths of quantities (times) are made
    from the stored doubles without decimals, which are slow; queries take what they need.
    """
    line, order, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    cost = F.col("l_extendedprice").cast("decimal(20,2)")
    hundredths = lambda c: F.rint(F.col(c) * 100).cast("long")
    line = line.withColumn("billed", hundredths("l_extendedprice")).withColumn("times", F.rint(F.col("l_quantity") * 10000).cast("long"))
    part = part.withColumn("reference", hundredths("p_retailprice"))
    rows = (
        line.join(order.join(customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part.select("p_partkey", "p_name", "p_retailprice", "p_type", "reference"), F.col("l_partkey") == F.col("p_partkey"))
        .join(small(supplier.select("s_suppkey", "s_name")), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "billed", F.col("l_quantity").cast("long"), F.date_format("l_shipdate", "yyyyMMdd")).alias("line_id"),
        F.col("l_orderkey").cast("string").alias("invoice_ref"),
        F.col("o_orderdate").cast("date").alias("invoice_date"),
        F.col("o_custkey").alias("case_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("p_name").alias("item_name"),
        F.col("p_type").alias("item_type"),
        F.concat(F.lit("Segment: "), "c_mktsegment").alias("vehicle_label"),
        F.col("s_name").alias("repairer"),
        cost.alias("line_total"),
        F.round(cost / F.col("l_quantity").cast("decimal(20,4)"), 2).cast("decimal(20,2)").alias("unit_price"),
        F.col("l_quantity").cast("decimal(20,4)").alias("quantity"),
        F.col("p_retailprice").cast("decimal(20,2)").alias("reference_price"),
        F.rint(F.col("l_tax") * 100).cast("int").alias("vat_rate"),
        "billed",
        "times",
        half_up(F.col("billed") * 10000, F.col("times")).alias("unit_cost"),
        "reference",
        F.when(F.col("o_orderstatus") == "P", "estimate").otherwise("invoice").alias("role"),
        F.when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_returnflag") == "A", "approved").otherwise("pending").alias("status"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_shipdate").cast("date").alias("shipped"),
    )


#: What a line_id is made of; where lines are written or shuffled these are smaller than the text.
ID_PARTS = ("invoice_ref", "line_no", "item_id", "supplier_id", "billed", "quantity", "shipped")


def id_of_parts() -> Column:
    """The line_id of a line that has its ID_PARTS."""
    return F.concat_ws("-", "invoice_ref", "line_no", "item_id", "supplier_id", "billed", F.col("quantity").cast("long"), F.date_format("shipped", "yyyyMMdd"))


#: The same rows in DuckDB, with money in whole pence.
OBS = """
WITH obs AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_extendedprice::DECIMAL(20,2) * 100)::BIGINT, l_quantity::BIGINT, strftime(l_shipdate, '%Y%m%d')) AS line_id,
         l_orderkey::VARCHAR AS invoice_ref, o_orderdate::DATE AS invoice_date, o_custkey AS case_id,
         l_partkey AS item_id, p_name AS item_name, p_type AS item_type, 'Segment: ' || c_mktsegment AS vehicle_label, s_name AS repairer,
         (l_extendedprice::DECIMAL(20,2) * 100)::BIGINT AS cost,
         ((l_extendedprice::DECIMAL(20,2) * 200)::BIGINT + l_quantity::BIGINT) // (2 * l_quantity::BIGINT) AS unit_cost,
         l_quantity::BIGINT AS quantity, (p_retailprice::DECIMAL(20,2) * 100)::BIGINT AS reference, round(l_tax * 100)::INT AS vat_rate,
         CASE WHEN o_orderstatus = 'P' THEN 'estimate' ELSE 'invoice' END AS role,
         CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'approved' ELSE 'pending' END AS status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)
"""
