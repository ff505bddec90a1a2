"""Seeded hash keys. md5 is used wherever an order or a draw must be reproducible anywhere."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def seeded(seed, key: Column) -> Column:
    """Hex md5 of ``seed|key``: the sort key behind every seeded shuffle, sample and split."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key))


def hash32(text: Column) -> Column:
    """32-bit unsigned number from the first eight hex digits of md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
