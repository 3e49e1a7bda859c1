"""The corpus pipeline: quality rules, near-dedup, decontamination, secrets, byte-level BPE.

All stages but the last return the columns of their input, extra ones too, whatever their names. Null
and empty texts fail the quality rules. Rows repeated whole are copies, so one of them stays; of near
copies the one with the least doc_id stays. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.llm import byte_bpe, decontaminate, neardup, quality, secrets, shared

SECRET = "<|secret|>"
#: Documents whose sets of 5-word shingles have this Jaccard or more are near copies.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.deduplicated(docs, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or an edited copy of one, go. Documents without text stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return shared.aside(docs, ("text",), lambda rows: decontaminate.matched(rows, items).where(F.size("benchmark_hits") == 0))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; a mark stands in place of each secret, and n_chars counts anew."""

    def scanned(rows: DataFrame) -> DataFrame:
        found = secrets.scan(rows, SECRET)
        number = F.when(F.size("secret_spans") > 0, F.length("redacted_text").cast("long")).otherwise(F.col("n_chars"))
        return found.withColumns({"text": F.col("redacted_text")} | ({"n_chars": number} if "n_chars" in rows.columns else {}))

    return shared.aside(docs, ("text", "n_chars"), scanned)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, the byte where each token ends, and the text decoded from the ids; other columns go.
    A null text has no ids and is decoded as the empty one."""
    coded = byte_bpe.encode_decode(docs)
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "token_ends", F.col("decoded").cast("string").alias("text"))


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("decontamination", decontamination), ("secret scan", secret_scan), ("byte-level BPE", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each one's rows are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = shared.stored(stage(spark, docs, sf_dir), f"stage{k}")
    return docs


ORACLE_SQL = None
