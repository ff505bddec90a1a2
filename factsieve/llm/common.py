"""Helpers that the operators share."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factsieve.session import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the folder that driver and executors share."""
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(small: DataFrame, most: int = 100_000) -> DataFrame:
    """A staged table for a broadcast join if it has at most ``most`` rows; else Spark chooses the join."""
    return F.broadcast(small) if small.count() <= most else small


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


class Sealed:
    """A table under neutral column names (c0, c1, ...), so that no working column can clash with its own."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.rows = docs.toDF(*[f"c{i}" for i in range(len(self.names))])

    def name(self, name: str) -> str:
        return f"c{self.names.index(name)}"

    def col(self, name: str) -> Column:
        return F.col(self.name(name))

    def opened(self, rows: DataFrame, **results: Column) -> DataFrame:
        """The table's columns under their names plus the results; a column named like a result (in any
        letter case) gives way to it."""
        taken = {r.lower() for r in results}
        return rows.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(self.names) if n.lower() not in taken],
                           *[value.alias(name) for name, value in results.items()])


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes: maximal runs without space, tab, LF, VT, FF, CR."""
    return text.encode().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_SPREAD = np.uint64(0xFF51AFD7ED558CCD)  # odd 64-bit multiplier


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for every run of ``width`` word hashes, order-sensitive."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, width):
        out ^= out >> np.uint64(31)
        out *= _SPREAD
        out += hashes[i:i + n]
    out ^= out >> np.uint64(32)
    out *= _SPREAD
    return out ^ (out >> np.uint64(29))
