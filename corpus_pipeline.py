"""From raw documents to token ids: quality, exact and near copies, source weights, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from factsieve.llm import bloom_dedup, jaccard_join, knn_quality, mixing, queries
from factsieve.llm.common import Sealed, bounded, stage, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled documents call good, with all their columns.

    Null and empty texts score the share of good labels, equal texts alike; long texts count whole. Repeated
    rows stay or go together; null ids teach nothing. An empty table gives an empty one. Working columns
    are kept apart, so any further column may have any name; the same holds for all stages.
    """
    model = knn_quality.learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), queries.fold(5) != 0)
    sealed = Sealed(docs)
    return sealed.opened(knn_quality.score(sealed.rows, model, sealed.name("text")).filter("predicted = 1"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id.

    Null counts as the empty text, a null id loses to any other, one of several repeated rows stays; texts
    are compared whole. An empty table gives an empty one.
    """
    return bloom_dedup.drop_copies(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by near-copy links the one with the least id.

    Documents without words are linked with nothing and stay, as do rows without id. Rows that share one id
    stay or go together. Ties need no rule, long texts are compared whole, an empty table gives an empty one.
    """
    found = jaccard_join.join_components(docs.select("doc_id", "text"))
    dropped = stage(found.filter("component_id <> doc_id").select(F.col("doc_id").alias("dropped")).distinct(), "near-copies")
    sealed = Sealed(docs)
    return sealed.opened(sealed.rows.join(bounded(dropped, 4_000_000), sealed.col("doc_id") == F.col("dropped"), "left_anti"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Texts that are null, empty or without words have no size and are taken as often as their keys say; a
    null source is one source, a null id draws like an empty one. Ties of the key go by id; repeated rows
    are rows of their own. Long texts count whole; an empty table gives an empty one.
    """
    sealed = Sealed(docs)
    mixed = mixing.mix(sealed.rows, *map(sealed.name, ("doc_id", "source", "text"))).filter("times > 0")
    return sealed.opened(mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))))


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, a row for each row of ``docs``.

    Null and empty texts have no ids; null ids stay null; long texts are encoded whole, and a text that
    stands in several rows in a run is encoded once. An empty table gives an empty one.
    """
    return queries.encoded_and_decoded(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", bpe_encode),
]

ORACLE_SQL = None  # SQL expresses neither the classifier nor the merges; tested against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
