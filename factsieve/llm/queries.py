"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factsieve.llm import (
    arrow_sequences, bloom_dedup, bpe, fill_in_middle, jaccard_join, knn_quality, lang_id, mixing, positional_index, prefix_trie, quality_rules, quotes,
    shards,
)
from factsieve.llm.common import new_folder, stage, table


def fold(folds: int) -> Column:
    """crc32 of doc_id as text, modulo the number of folds."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def op1_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.thread(quotes.with_quotes(table(spark, sf_dir, "conversations")))


def op2_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = arrow_sequences.write_sequences(docs, new_folder(spark, "sequences"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return arrow_sequences.read_documents(manifest)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules.rate(docs).select(
        "doc_id", *quality_rules.COUNTS, "base_failed", "kept", "class_distance", "word_distance")


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shards.assign_shards(docs, 24).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op6_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    dictionaries = lang_id.learn(docs, fold(3) != 1)
    return lang_id.identify(docs, dictionaries).select(
        "doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bloom_dedup.mark_copies(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def encoded_and_decoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of the ids and of the text decoded from them."""
    return bpe.encode_and_decode(docs, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded_and_decoded(docs, public_tokenizers.path("word_bpe_49k.json"))


def op10_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = knn_quality.learn(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    return knn_quality.score(docs, model).select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op11_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positional_index.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = stage(prefix_trie.paths(table(spark, sf_dir, "conversations")), "own-paths")
    conv = F.col("conv")
    rebuilt = prefix_trie.with_shared_heads(own, conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4, most=3)
    nodes = prefix_trie.trie(rebuilt)
    return nodes.select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quotes, op2_arrow_sequences, op3_jaccard_join, op4_quality_rules, op5_shards, op6_lang_id, op7_mixing, op8_bloom_dedup, op9_bpe, op10_knn_quality,
        op11_positional_index, op12_prefix_trie, op13_fill_in_middle)
}
