"""Vehicle categories and effective-dated rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repairbench.functions.rules import vehicle_class
from repairbench.functions.text import vehicle_name_key


def lookup_vehicle(vehicles: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Each distinct (make, model) with the best catalogue row of its make, or match_status manual_review.

    A row scores as exact model, alias, whole make (``*``), contained model, or contained alias; ties go to the
    smaller position. catalogue(position, make, model, aliases, group_range, body_type, and group_category if known).
    """
    rows = vehicles.select("make", "model").distinct().withColumn("mk", vehicle_name_key(F.col("make"))).withColumn("md", vehicle_name_key(F.col("model")))
    category = F.col("group_category") if "group_category" in catalogue.columns else F.lit(None).cast("string")
    known = catalogue.select("position", vehicle_name_key(F.col("make")).alias("mk"), vehicle_name_key(F.col("model")).alias("cm"), F.transform("aliases", vehicle_name_key).alias("al"), "group_range", "body_type", category.alias("group_category"))
    inside = F.filter("al", lambda a: (a != "") & F.contains(F.col("md"), a))
    scored = rows.where("mk <> '' AND md <> ''").join(known, "mk")
    score = (
        F.when(F.col("cm") == F.col("md"), F.struct((10000 + F.length("cm")).alias("score"), F.lit("exact").alias("status")))
        .when(F.array_contains("al", F.col("md")), F.struct((9000 + F.length("md")).alias("score"), F.lit("alias").alias("status")))
        .when(F.col("cm") == "*", F.struct(F.lit(1).alias("score"), F.lit("make_family").alias("status")))
        .when(F.contains("md", F.col("cm")), F.struct(F.length("cm").alias("score"), F.lit("model_family").alias("status")))
        .when(F.size(inside) > 0, F.struct((8000 + F.array_max(F.transform(inside, lambda a: F.length(a)))).alias("score"), F.lit("alias_family").alias("status")))
    )
    hits = scored.withColumn("s", score).where("s IS NOT NULL")
    best = hits.groupBy("make", "model").agg(F.max_by(F.struct("group_range", "body_type", "group_category", "s.status"), F.struct("s.score", -F.col("position"))).alias("b"))
    return rows.select("make", "model").join(best, ["make", "model"], "left").select("make", "model", "b.group_range", "b.body_type", "b.group_category", F.coalesce("b.status", F.lit("manual_review")).alias("match_status"))


def vehicle_label(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """rows with vehicle_label: a sourced class, else the catalogue's body type, else its insurance group, else Unclassified.

    rows(make, model, official, bodywork, segment, source, ...). The catalogue is looked up once for each make and model.
    """
    known = vehicle_class(F.col("official"), F.col("bodywork"), F.col("segment"), F.col("source"))["label"]
    looked = lookup_vehicle(rows, catalogue).withColumnsRenamed({"make": "_make", "model": "_model"})
    both = rows.join(looked, F.col("make").eqNullSafe(F.col("_make")) & F.col("model").eqNullSafe(F.col("_model")), "left")
    group = F.when(F.col("group_range").isNotNull(), F.concat(F.lit("Insurance group "), "group_range", F.lit(" \u2014 "), F.coalesce("group_category", F.lit(""))))
    return both.select(*rows.columns, F.coalesce(known, F.nullif(F.col("body_type"), F.lit("")), group, F.lit("Unclassified")).alias("vehicle_label"))


def rule_at(rows: DataFrame, rules: DataFrame, date_col: str, name: str) -> DataFrame:
    """rows with rule_value: that of the rule in force on the date, the latest start winning; null if none is.

    rules(rule, valid_from, valid_to, value). rows needs a column row_id.
    """
    named = rules.where(F.col("rule") == name)
    on = (F.col("valid_from") <= F.col(date_col)) & (F.col("valid_to").isNull() | (F.col(date_col) <= F.col("valid_to")))
    days = rows.select(date_col).distinct().join(named, on).groupBy(date_col).agg(F.max_by("value", "valid_from").alias("rule_value"))
    return rows.join(days, date_col, "left")
