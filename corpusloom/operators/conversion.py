"""Conversion of many documents and the tables that report on it."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import convert as c
from ..functions.text import staged


def convert_all(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, markdown, status, input_size, output_size (bytes), applied_rules, validation for each row of docs. A null text
    is an Exception: null markdown, no rules, no validation."""
    done = c.convert(docs.select(id_col, F.col(text_col).alias("__raw")), "__raw", "markdown")
    known = F.col("__raw").isNotNull()
    done = staged(done, validation=F.when(known, c.validate(F.col("markdown"))), applied_rules=F.when(known, c.applied_rules(F.col("__raw"), F.col("markdown"))))
    size = lambda x: F.coalesce(F.octet_length(x), F.lit(0)).cast("long")
    return done.select(id_col, "markdown", c.status(F.col("validation")).alias("status"), size("__raw").alias("input_size"), size("markdown").alias("output_size"), "applied_rules", "validation")


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def summary(results: DataFrame) -> DataFrame:
    """One row: total, success, warning, error, exception and the success rate in percent, one decimal."""
    n = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, 1)), F.lit(0)).cast("long")
    out = results.agg(F.count(F.lit(1)).alias("total"), *(n(s).alias(s.lower()) for s in ("Success", "Warning", "Error", "Exception")))
    return out.withColumn("success_rate", F.when(F.col("total") > 0, F.round(F.col("success") * 100 / F.col("total"), 1)))


def rule_counts(results: DataFrame, top: int | None = None) -> DataFrame:
    """rule, n, percent of all documents; most frequent first, then by name."""
    # What stands first in each row's list counts the row itself, so results are computed once.
    listed = F.concat(F.array(F.lit(None).cast("string")), F.coalesce("applied_rules", F.array().cast("array<string>")))
    n = results.select(F.posexplode(listed).alias("at", "rule")).groupBy((F.col("at") == 0).alias("whole"), "rule").agg(F.count(F.lit(1)).alias("n"))
    total = F.max(F.when(F.col("whole"), F.col("n"))).over(Window.partitionBy())  # a row for each rule
    out = n.withColumn("total", total).where(~F.col("whole")).select("rule", "n", F.round(F.col("n") * 100 / F.col("total"), 1).alias("percent")).orderBy(F.desc("n"), "rule")
    return out if top is None else out.limit(top)


def not_successful(results: DataFrame) -> DataFrame:
    return results.where("status <> 'Success'")


def file_report(results: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The report's file sheet: sizes in KB, lists joined by semicolons."""
    kb = lambda x: F.bround(F.col(x) / 1024, 1)
    return results.select(id_col, "status", kb("input_size").alias("input_kb"), kb("output_size").alias("output_kb"), F.array_join("applied_rules", "; ").alias("applied_rules"), F.array_join("validation", "; ").alias("validation"))


def write_observed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> dict[str, float]:
    """Converts docs into the table at path and gives what summary() would, with seconds and documents a second, from the job that
    writes: nothing is converted twice. Rules' names count too, as rule:name."""
    found = Observation("conversion")
    n = lambda hit: F.coalesce(F.sum(F.when(hit, 1)), F.lit(0)).cast("long")
    states = [n(F.col("status") == s).alias(s.lower()) for s in ("Success", "Warning", "Error", "Exception")]
    rules = [n(F.array_contains("applied_rules", said)).alias(f"rule:{said}") for said, *_ in c.RULES]
    began = time.perf_counter()
    convert_all(docs, id_col, text_col).observe(found, F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("output_size"), F.lit(0)).alias("output_bytes"), *states, *rules).write.mode("overwrite").parquet(path)
    took = time.perf_counter() - began
    got = dict(found.get)
    return got | {"seconds": took, "per_second": got["total"] / took, "success_rate": round(got["success"] * 100 / got["total"], 1) if got["total"] else None}
