"""Extra columns of the input whose names an operator might use for itself, and empty tables."""

import pytest
from cases import documents
from pyspark.sql import functions as F

import corpus_pipeline
from quizmill.llm import byte_bpe, chat, decontaminate, katz, neardup, quality, queries, repeats, secrets, sharding, shared

NAMES = (
    "_words _capitals _marks _lines _lang _source _k_doc _k_null _k_key _k_row _encode_me kept base_failed n_words symbol_rate fence_symbol_rate "
    "benchmark_hits secret_spans redacted_text token_ids decoded held key block c n registers text_key spans component_id shard slot a.b"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([r[:5] for r in documents()], "doc_id long, text string, lang string, source string, n_chars long")
    return rows.select("*", *(F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in NAMES))


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def bare(docs):
    return docs.select("doc_id", "text", "lang", "source", "n_chars")


def test_quality(docs):
    names = ["doc_id", *quality.COUNTS, "base_failed", "kept"]
    assert plain(quality.judged(docs).select(*names)) == plain(quality.judged(bare(docs)).select(*names))


def test_passing_and_deduplicated_keep_all_columns(docs):
    for stage in (quality.passing, neardup.deduplicated):
        out = stage(docs)
        assert out.columns == docs.columns
        rows = {tuple(r) for r in docs.collect()}
        assert all(tuple(r) in rows for r in out.collect())
        assert plain(out.select("doc_id", "text")) == plain(stage(bare(docs)).select("doc_id", "text"))


def test_operators_ignore_or_carry_them(docs):
    assert plain(neardup.clustered(docs)) == plain(neardup.clustered(bare(docs)))
    assert plain(repeats.removed(docs)) == plain(repeats.removed(bare(docs)))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    assert plain(katz.scores(docs, held)) == plain(katz.scores(bare(docs), held))
    assert plain(sharding.assign(docs)) == plain(sharding.assign(bare(docs)))
    for f, new in ((byte_bpe.encode_decode, ["token_ids", "decoded"]), (secrets.scan, ["secret_spans"])):
        a, b = f(docs), f(bare(docs))
        assert plain(a.select("doc_id", *new)) == plain(b.select("doc_id", *new))
        assert set(a.columns) == {*docs.columns, *b.columns}


def test_pipeline_stages(spark, docs, write_table, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(1, "no such words anywhere here")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id is not None}
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = shared.stored(stage(spark, now, folder), "names")
        assert now.columns == docs.columns
    for r in now.collect():
        if r.doc_id is not None:
            assert tuple(r)[5:] == tuple(rows[r.doc_id])[5:]
    assert corpus_pipeline.STAGES[-1][1](spark, now, folder).count() == now.count()


def test_empty_tables(spark, docs, tmp_path):
    none = docs.limit(0)
    folder = f"file://{tmp_path}"
    items = spark.createDataFrame([(1, "some words of an item here")], "item_id long, text string")
    items.write.parquet(f"{folder}/benchmark.parquet")
    bare(none).write.parquet(f"{folder}/documents.parquet")
    assert decontaminate.matched(none, items).collect() == []
    assert queries.op7_decontamination(spark, folder).collect() == []
    assert corpus_pipeline.run(spark, folder).collect() == []
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).collect() == []


def test_chat_extra_columns(spark):
    rows = [(1, 0, "user", "hi", "x"), (1, 1, None, "y" * 200_000, None), (1, 2, "assistant", None, "z")]
    plain_ = "conv_id long, turn long, role string, text string"
    clash = spark.createDataFrame([(*r, *r[4:] * 3) for r in rows], f"{plain_}, position string, cost string, piece string, kept string")
    assert plain(chat.repaired(clash)) == plain(chat.repaired(spark.createDataFrame([r[:4] for r in rows], plain_)))
