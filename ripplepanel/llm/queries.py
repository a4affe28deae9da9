"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplepanel.llm import (
    bm25_search, centroids, fast_sketches, language, main_text, masked_search, mixing, near_duplicates, personal_data, quality,
    quality_rules, sentence_pieces, sql, token_counts)

TOKEN_LIMIT = 1024


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.jaccard_groups(_table(spark, sf_dir, "documents"))


def op2_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bm25_search.similar_documents(docs, docs.where(F.col("doc_id") % 50 == 0))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample_mixture(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, _table(spark, sf_dir, "labels")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return personal_data.report(docs, personal_data.fit_detector(docs))


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return main_text.extract(pages, main_text.fit_pages(pages))


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify_languages(docs, language.fit_languages(docs))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(_table(spark, sf_dir, "embeddings"))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fast_sketches.sketch_groups(_table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_search.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_ngram_jaccard_join, op2_bm25_topk, op3_source_mixing, op4_token_counts, op5_quality_classifier, op6_quality_rules,
        op7_personal_data, op8_html_main_text, op9_sentence_pieces, op10_language_id,
        op11_centroid_clustering, op12_minhash_near_dedup, op13_ranked_search)}
SQL: dict[str, str] = {
    "op2_bm25_topk": sql.BM25_TOP_K, "op6_quality_rules": sql.QUALITY_RULES, "op11_centroid_clustering": sql.CENTROIDS,
    "op12_minhash_near_dedup": sql.NEAR_DUPLICATES, "op13_ranked_search": sql.RANKED_SEARCH}
