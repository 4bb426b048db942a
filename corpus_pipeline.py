"""A corpus pipeline of five of the operators, each stage on all that the one before it kept.

All stages take rows as they come: null and empty texts, ids that repeat or are
missing, further columns of any name. An empty table stays empty. The first four
return rows with their columns as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, near_dedup, quality_classifier, secrets, sentencepiece_scan
from tallyloom.llm.common import drop, released, table, written
from tallyloom.llm.queries import PIECE_MODEL


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; a null text is judged as an empty one, each row by its own text."""
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id, and of rows that repeat it that with the least digest of its text. Texts without words are alike only if doc_id and text are."""
    return near_dedup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark; texts without words aren't, and a clean text stays whatever other rows have its doc_id."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by its kind, of overlapping ones by the first's; null texts stay null."""
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian unsigned 32-bit), round_trip; a null text has no ids, and of equally good paths the one whose last piece is longest is taken."""
    found = sentencepiece_scan.encode(docs, public_tokenizers.path(PIECE_MODEL))
    return found.select("doc_id", F.expr("cast(octet_length(ids) / 4 as long)").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secret_scan), ("tokens", tokens)]
#: The classifier's verdicts can't be given in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage needed goes once its result is written, and that once the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with released(spark):
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", kept=True)
        if before is not None:
            drop(before)
        before = docs
    return docs
