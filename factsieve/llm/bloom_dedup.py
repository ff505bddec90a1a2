"""Exact deduplication with a two-pass Bloom filter.

Pass 1 counts, over all rows, how often each of ``hashes`` bit positions of a row's text hash is
hit and keeps the positions hit twice or more as a bit map. It is a grouped count, so up to ``hashes``
positions a row (numbers, added up per task first) shuffle in it; there is no native aggregate that merges
once / twice bit maps of tasks. Pass 2 probes the map: a text that has a copy finds all its positions
there, so a row that misses one of them is unique and goes straight through. Only the others shuffle
again, as (digest, id), to find their groups. Texts never shuffle.

The map has about ``bits_per_row`` bits per row, at most ``max_bits`` (its broadcast holds at most
max_bits / 64 rows). Beyond that more rows count as possibly repeated and shuffle; results stay the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from factsieve.llm.common import Sealed, ascii_lower, or_empty, stage
from factsieve.operators import skew

def _bits(rows: int, bits_per_row: int, max_bits: int) -> int:
    bits = 64
    while bits < rows * bits_per_row and bits < max_bits:
        bits *= 2
    return bits


def _positions(digest: Column, hashes: int, bits: int) -> list[Column]:
    return [F.xxhash64(digest, F.lit(i)).bitwiseAND(F.lit(bits - 1)) for i in range(hashes)]


def _word(position: Column) -> Column:
    return F.shiftright(position, 6)


def _flag(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), position.bitwiseAND(F.lit(63)).cast("int"))


def repeated_bits(digests: DataFrame, hashes: int, bits: int) -> DataFrame:
    """(word, mask): the bit positions hit by two or more rows, 64 to a word."""
    hits = digests.select(F.explode(F.array_distinct(F.array(*_positions(F.col("digest"), hashes, bits)))).alias("_position"))
    return (hits.groupBy("_position").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
            .groupBy(_word(F.col("_position")).alias("word")).agg(F.bit_or(_flag(F.col("_position"))).alias("mask")))


def _marked(docs: Sealed, id_column: str, text_column: str, hashes: int, bits_per_row: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(unique rows, possibly repeated rows), both with sha, row_id; the latter with keep, group."""
    rows = docs.rows.withColumns({
        "sha": F.sha2(ascii_lower(or_empty(docs.col(text_column))).cast("binary"), 256), "row_id": docs.col(id_column),
    }).withColumn("digest", F.xxhash64("sha"))
    bits = _bits(rows.count(), bits_per_row, max_bits)
    seen = stage(repeated_bits(rows.select("digest"), hashes, bits), "bloom")
    probed, flags = rows, []
    for i, position in enumerate(_positions(F.col("digest"), hashes, bits)):
        part = F.broadcast(seen.select(F.col("word").alias(f"word{i}"), F.col("mask").alias(f"mask{i}")))
        probed = probed.join(part, _word(position) == F.col(f"word{i}"), "left")
        flags.append(F.coalesce(F.col(f"mask{i}").bitwiseAND(_flag(position)) != 0, F.lit(False)))
    maybe = reduce(lambda a, b: a & b, flags)
    own = [*docs.rows.columns, "sha", "row_id"]
    repeated = probed.filter(maybe).select(*own)
    groups = repeated.groupBy("sha").agg(F.max("row_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    return probed.filter(~maybe).select(*own), skew.attach(
        repeated, groups, ["sha"], F.col("row_id"), F.col("_size"), {"_keep": "keep", "_size": "group"})


def mark_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", hashes: int = 3,
                bits_per_row: int = 16, max_bits: int = 1 << 28) -> DataFrame:
    """All rows and columns of ``docs`` plus keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; null counts as empty. Of equal texts the row
    with the largest id stays. Rows that share text and id (repeated rows) count in group_size and are
    all marked as kept; ``drop_copies`` keeps one of them. A null id loses to any other id; a group of
    null ids only has keep_id null and kept true. Columns named like a result give way to it. An empty
    table gives an empty result.
    """
    sealed = Sealed(docs)
    alone, repeated = _marked(sealed, id_column, text_column, hashes, bits_per_row, max_bits)
    return sealed.opened(
        alone, keep_id=F.col("row_id"), group_size=F.lit(1).cast("long"), kept=F.lit(True), text_sha256=F.col("sha")
    ).unionByName(sealed.opened(
        repeated, keep_id=F.col("keep"), group_size=F.col("group"), kept=F.col("row_id").eqNullSafe(F.col("keep")), text_sha256=F.col("sha")))


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", hashes: int = 3,
                bits_per_row: int = 16, max_bits: int = 1 << 28) -> DataFrame:
    """The rows of ``docs`` that stay, one of each text. Of repeated rows one stays."""
    sealed = Sealed(docs)
    alone, repeated = _marked(sealed, id_column, text_column, hashes, bits_per_row, max_bits)
    kept = repeated.filter(F.col("row_id").eqNullSafe(F.col("keep"))).dropDuplicates(["sha"])
    return sealed.opened(alone).unionByName(sealed.opened(kept))
