"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsignal.llm import (
    cube_mixing, decontaminate, divergence, kd_shards, line_dedup, multi_index, ngram_join, pii, pitman_yor, quality,
    seekable_tokens, spelling, warc)
from pitsignal.llm.common import table


def op1_seekable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return seekable_tokens.encode_and_read_back(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(table(spark, sf_dir, "pages"), min_bytes=0)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_common_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op5_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = cube_mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.0, max_repeat=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_multi_index_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op7_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.similar_documents(table(spark, sf_dir, "documents"), width=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op9_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards.assign_shards(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op10_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"), label="quality"))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"), min_docs=3, scale=1_000_000_000, top=200)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), min_chars=6, min_count=5, ratio=5, damage=199)


def op13_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_held_out(table(spark, sf_dir, "documents"), burn=2, samples=3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_seekable_tokens, op2_winnowing, op3_warc_transactions, op4_line_dedup, op5_cube_mixing, op6_multi_index_ann,
        op7_crf_pii, op8_ngram_join, op9_kd_sharding, op10_quality_network, op11_source_divergence, op12_spelling_variants,
        op13_pitman_yor)
}
