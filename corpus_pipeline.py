"""The training-data pipeline over `documents`: quality classifier, line dedup, n-gram Jaccard join, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
one's docs. All but the last return the columns of documents; extra columns pass through the filtering stages.
Null and empty texts, repeated rows and an empty table go through as each operator's docstring says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repairbench.llm.common import Scratch, bound_batches, free_name, read_table, small
from repairbench.llm.line_dedup import line_dedup
from repairbench.llm.ngram_jaccard import ngram_jaccard_join
from repairbench.llm.packing import pack_tokens
from repairbench.llm.quality import score_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of label 1; those it rejects go."""
    bound_batches(spark)
    scored = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated lines; n_chars is counted again."""
    bound_batches(spark)
    kept = line_dedup(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document of the smallest id (of rows that share it, the first); others go.

    Rows with a null id take no part in components and stay.
    """
    bound_batches(spark)
    scratch = Scratch(spark, "survivors")
    groups = ngram_jaccard_join(docs)
    key = free_name("other_id", docs)
    gone = scratch.save(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct())
    kept = docs.join(small(gone), docs["doc_id"] == gone[key], "left_anti")
    repeated = scratch.save(kept.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias("c")).where("c > 1").select(key))
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    twice = F.col("doc_id") == F.col(key)
    once = kept.join(small(repeated), twice, "left_anti")
    row = free_name("row", docs)
    first = kept.join(small(repeated), twice, "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias(row)).select(f"{row}.*")
    return once.select(*docs.columns).unionByName(first.select(*docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of 1024 ids, with their ids."""
    bound_batches(spark)
    return pack_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), memo=MEMO)


#: Parts whose ids a worker remembers; fewer than packing alone has, as the stages before leave executors less memory.
MEMO = 60_000

STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("packing", packing)]

#: A classifier's scores are not to be had in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each returns is written to the shared folder and read again."""
    docs, scratch = read_table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs)
    return docs
