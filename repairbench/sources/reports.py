"""Report tables, nested results, and the append of finalised lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def append_finalised(history: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines to add to the history: of invoices, mapped, approved or edited, with a total, and not there yet.

    lines(line_id, role, item_id, mapping_status, total). Of repeated lines one is added.
    """
    good = lines.where("role = 'invoice' AND item_id IS NOT NULL AND mapping_status IN ('approved', 'edited') AND total IS NOT NULL AND line_id IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("line_id").orderBy("item_id", "total"))
    return good.withColumn("_k", first).where("_k = 1").drop("_k").join(history.select(F.col("source_line_id").alias("line_id")), "line_id", "left_anti")


def with_computed(supplied: DataFrame, computed: DataFrame, on: list[str]) -> DataFrame:
    """The supplied rows, each with its computed columns; these override supplied ones of the same name.

    computed has one row for each `on`, or none: then supplied values stay, and other computed columns are null.
    """
    more = [c for c in computed.columns if c not in on]
    there = computed.withColumn("_there", F.lit(True)).alias("c")
    joined = supplied.alias("s").join(there, [F.col(f"s.{k}").eqNullSafe(F.col(f"c.{k}")) for k in on], "left")
    old = [F.when(F.col("c._there"), F.col(f"c.{c}")).otherwise(F.col(f"s.{c}")).alias(c) if c in more else F.col(f"s.{c}") for c in supplied.columns]
    return joined.select(*old, *[F.col(f"c.{c}") for c in more if c not in supplied.columns])


def write_report_tables(tables: dict[str, DataFrame], path: str, order: dict[str, str], key: str = "case_id", form: str = "parquet") -> None:
    """Writes each flat table under its name, in ranges of claims sorted by claim and the table's order.

    A file holds one range, so that a reader of some claims skips all other files by their least and largest claim; there
    is no folder for each claim. A claim of very many rows goes on in the next file. Rows without a claim come first.
    """
    for name, df in tables.items():
        by = [F.col(c).asc_nulls_first() for c in (key, order[name])]
        df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").format(form).options(**({"header": True} if form == "csv" else {})).save(f"{path}/{name}")


def read_report_table(spark: SparkSession, path: str, name: str, schema: StructType, claims: tuple[int, int] | None = None, key: str = "case_id", form: str = "parquet") -> DataFrame:
    """A written table, or its claims from the first to the last one told (the scan skips other files)."""
    df = spark.read.schema(schema).format(form).options(**({"header": True} if form == "csv" else {})).load(f"{path}/{name}")
    return df if claims is None else df.where(F.col(key).between(*claims))


def nest_result(key: str, tables: dict[str, DataFrame], order: dict[str, str]) -> DataFrame:
    """One row for each key with an array of structs for each table, in the order of a column."""
    out = None
    for name, df in tables.items():
        rest = [c for c in df.columns if c not in (key, order[name])]
        nested = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order[name], *rest))).alias(name))
        out = nested if out is None else out.join(nested, key, "full_outer")
    return out


def readiness(items: DataFrame, obs: DataFrame) -> DataFrame:
    """Counts of the catalogue and the history, and the issues when one is empty."""
    both = items.agg(F.count("*").alias("items")).crossJoin(obs.agg(F.count("*").alias("observations")))  # two rows of counts
    issues = F.array_compact(F.array(F.when(F.col("items") == 0, "ONTOLOGY_EMPTY"), F.when(F.col("observations") == 0, "HISTORY_EMPTY")))
    return both.select("items", "observations", F.array_join(issues, ",").alias("issues"))
