"""The queries of this subpackage: thin digests over the operators' own outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.llm import byte_bpe, chat, decontaminate, katz, langid, neardup, quality, ranked_search, repeats, secrets, sharding, shared, token_store, whitening
from quizmill.llm.oracle import ORACLE_SQL  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the contract's columns: the removed runs as start:end, and the kept text, null where a cut splits a character."""
    rows = repeats.removed(documents(spark, sf_dir))
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return rows.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_text", 256).alias("kept_sha256"), joined.alias("spans"), F.try_validate_utf8(F.col("kept_text").cast("string")).alias("kept_text"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.clustered(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "secret_spans")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secret_spans", lambda s: s["kind"] != "guess")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"), count("guess"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(documents(spark, sf_dir), keep=("doc_id",))
    return rows.select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op5_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every turn of every conversation: what the cheapest repair makes of it, and its piece of the rendering."""
    return chat.repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign(documents(spark, sf_dir))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item or an edited copy of one, with the items."""
    found = decontaminate.matched(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hits = found.where(F.size("benchmark_hits") > 0)
    return hits.select("doc_id", F.transform("benchmark_hits", lambda h: h["item_id"]).alias("item_ids"), F.array_max(F.transform("benchmark_hits", lambda h: h["score"])).alias("best_score"))


def op8_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scores(documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = byte_bpe.encode_decode(documents(spark, sf_dir).select("doc_id", "text"), offsets=False)
    return rows.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.place(spark, "tokens")
    token_store.write(documents(spark, sf_dir), folder)
    return token_store.read(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document without an id teaches nothing and is not held out."""
    docs = documents(spark, sf_dir)
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = langid.learn(docs.where(part != 2))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that is no long is null; the operator itself gives decimals."""
    rows = whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(ranked_search.index(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (op1_repeat_removal, op2_near_dedup, op3_secret_scan, op4_quality_rules, op5_role_repair, op6_sharding, op7_decontamination, op8_katz_backoff, op9_byte_bpe, op10_token_output, op11_language_id, op12_embedding_whitening, op13_ranked_search)}

