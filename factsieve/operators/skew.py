"""Joining per-key counts back to rows when a key may hold a large share of the rows.

A plain window or join on such a key sends all its rows to one task. Here the counts
are pre-aggregated (map-side combine), the few largest keys travel as a broadcast list
whose length is bounded by ``settings.HOT_KEYS``, and rows of those keys are spread
over the shuffle by their own id instead of by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factsieve import settings


def attach_counts(df: DataFrame, keys: list[str], spread: Column, name: str = "n_rows",
                  hot_keys: int = settings.HOT_KEYS) -> DataFrame:
    """Add the number of rows sharing ``keys`` to every row (keys must be non-null)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return attach(df, counts, keys, spread, F.col("_n"), {"_n": name}, hot_keys)


def attach(df: DataFrame, per_key: DataFrame, keys: list[str], spread: Column, weight: Column,
           columns: dict[str, str], hot_keys: int = settings.HOT_KEYS) -> DataFrame:
    """Left-join ``per_key`` (unique on ``keys``) to ``df``.

    ``weight`` ranks the keys of ``per_key`` by how many rows of ``df`` they hold; the top
    ``hot_keys`` of them are served from a broadcast list, all others by a shuffle join.
    """
    source, target = list(columns), list(columns.values())
    hot = per_key.orderBy(weight.desc(), *keys).limit(hot_keys).select(
        *keys, *[F.col(c).alias(f"_hot_{c}") for c in source], F.lit(True).alias("_is_hot")
    )
    cold = per_key.select(
        F.xxhash64(*keys).alias("_route"), *[F.col(k).alias(f"_cold_{k}") for k in keys],
        *[F.col(c).alias(f"_cold_{c}") for c in source],
    )
    flagged = df.join(F.broadcast(hot), keys, "left").withColumn(
        "_route", F.when(F.col("_is_hot"), F.xxhash64(spread)).otherwise(F.xxhash64(*keys))
    )
    on = flagged["_route"] == cold["_route"]
    for k in keys:
        on = on & (flagged[k] == cold[f"_cold_{k}"])
    return flagged.join(cold, on, "left").select(
        *[flagged[c] for c in df.columns],
        *[F.coalesce(F.col(f"_hot_{c}"), F.col(f"_cold_{c}")).alias(t)
          for c, t in zip(source, target)],
    )
