"""From raw documents to packed training sequences: quality rules, line dedup, near-dedup, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.line_align import dedupe_lines
from tablewright.llm.near_copies import drop_near_copies
from tablewright.llm.packing import pack
from tablewright.llm.repetition import repetition
from tablewright.llm.store import written


def aside(docs: DataFrame, used: list[str]) -> dict[str, str]:
    """New names for the columns of ``docs`` that clash with names a stage adds or begin with ``_line``."""
    return {c: f"_document_{c}" for c in docs.columns if c.lower() in used or c.lower().startswith("_line")}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules; texts stay as they are, and so does a column called ``_quality``."""
    names = aside(docs, ["_quality"])
    judged = docs.withColumnsRenamed(names).withColumn("_quality", repetition(F.col("text"))).where("_quality.kept")
    return judged.drop("_quality").withColumnsRenamed({new: c for c, new in names.items()}).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks they share with earlier ones; those left without a word go.

    ``n_chars`` follows the text. Columns named like those that line dedup adds keep their values.
    """
    names = aside(docs, ["n_removed", "removed_words", "aligned_with", "keep"])
    shorter = dedupe_lines(docs.select("*").withColumnsRenamed(names))
    shorter = shorter.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        shorter = shorter.withColumn("n_chars", F.when(F.col("n_removed") > 0, length).otherwise(F.col("n_chars")))
    return shorter.select([F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group that near copies connect.

    Near copies have SimHash fingerprints within 3 bits, found by vantage-point trees, or a five-word Jaccard
    similarity of 0.8 or more.
    """
    return drop_near_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per sequence of a power-of-two length."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, with_ids=False)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packing)]
# Rolling hashes, alignment and tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
