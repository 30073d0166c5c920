"""The corpus pipeline: quality rules, near-dedup, personal data, mixing and encoding over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; run() writes every stage's rows to the
shared folder and reads them back, so a lost executor costs one stage at most. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, mixing, near_dedup, pii, quality
from corpusloom.llm.common import drop, save
from corpusloom.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    found = near_dedup.near_duplicates(docs)
    gone = found.where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind; n_chars follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in clean.columns else clean


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each document as often as its source's target asks for."""
    return mixing.mix_rows(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, for each document of the mixture."""
    return bpe.encode_digests(docs, tokenizer_path())


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup_stage), ("pii", personal_data), ("mixing", mixing_stage), ("bpe", encoding)]
#: SQL can express neither the learned patterns nor the encoding; tests/llm holds the stages and run()'s rows to brute-force
#: versions, the redacted texts to their spans.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        rows = save(stage(spark, rows, sf_dir), f"stage-{name}")
        if before is not None:
            drop(before)
        before = rows
    return rows
