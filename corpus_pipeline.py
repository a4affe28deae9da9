"""A pipeline that turns raw documents into token ids: five stages, each on all that its predecessor kept.

    language ID        rows whose language the nearest centroids reject go; lang becomes the predicted one
    n-gram join        one document of each group of near copies stays
    personal data      spans are replaced by their kind in brackets
    mixing             documents are sampled to the target weights of source, language and topic
    sentence pieces    texts become ids

Every stage but the last returns the columns of documents; ``run`` writes each stage's rows as Parquet below the
shared folder and goes on from there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplepanel.llm import language, mixing, near_duplicates, personal_data, sentence_pieces
from ripplepanel.session import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
PIECES = "piece_bpe_32k.model"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep rows whose text the language model accepts, with the predicted language."""
    return language.keep_identified(docs.select(*COLUMNS), language.fit_languages(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of each group of linked documents; rows without id stay."""
    return near_duplicates.keep_one_of_each(docs.select(*COLUMNS))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in every text; ``n_chars`` follows the text."""
    detector = personal_data.fit_detector(docs)
    found = personal_data.find_personal_data(docs, detector, keep=("doc_id", "lang", "source"))
    return found.withColumn("text", personal_data.redact()).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents to the tempered marginals."""
    return mixing.keep_mixture(docs.select(*COLUMNS))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text."""
    return sentence_pieces.encode(docs, public_tokenizers.path(PIECES), keep=("doc_id", "lang", "source"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("mixing to target weights", mix_sources),
    ("SentencePiece encoding", encode_texts),
]
#: Centroids, boosted trees and hashed draws have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name.split()[0].lower()}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
