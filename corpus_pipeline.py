"""The corpus pipeline: quality rules, near-duplicates, substrings, benchmark leaks, packing.

Every stage but the last returns the columns of its input. Rows are told apart by a number that the scan of the
written predecessor gives, so repeated rows and null ids are safe; columns that a stage adds on the way have names
that start with an underscore and the stage's letter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import table, written
from tidegauge.llm.decontaminate import contaminated, content_key
from tidegauge.llm.near_dedup import near_groups
from tidegauge.llm.packing import pack
from tidegauge.llm.perplexity_rules import quality_verdicts
from tidegauge.llm.substring_dedup import substring_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_verdicts(docs, prefix="_q_").where("_q_kept").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id, the first of equals."""
    numbered = docs.withColumn("_n_row", F.monotonically_increasing_id())
    groups = near_groups(numbered, carry=("_n_row",))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_n_row"))["_n_row"].alias("_n_row")
    winners = groups.groupBy("group").agg(first).select("_n_row")
    return numbered.join(winners, "_n_row", "left_semi").select(docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that an earlier document has; untouched texts stay as they are."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_s_"), *others).alias("_s_rest"))
    cut = substring_duplicates(packed, carry=("_s_rest",))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    columns = {c: F.col("_s_rest")[c] for c in others} | {"doc_id": F.col("doc_id"), "text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") == 0, columns["n_chars"]).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[columns[c].alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("key").alias("_d_leak"), F.col("doc_id").alias("_d_id")).distinct()
    same = (F.col("_d_key") == F.col("_d_leak")) & F.col("doc_id").eqNullSafe(F.col("_d_id"))
    return docs.withColumn("_d_key", content_key("doc_id", "text")).join(leaks, same, "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substrings),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: The perplexity model and the tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stage written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
