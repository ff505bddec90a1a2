"""Connected components of a link table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factsieve.llm.common import stage

BROADCAST = 1_000_000  # rows of (node, least neighbour)


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("lo", "hi"))).first()
    return row[0], row[1]


def _with_least(links: DataFrame, node: str, other: str, small: bool) -> DataFrame:
    """Adds the least neighbour of ``node`` over its rows; one row per node is broadcast only if ``small``."""
    least = links.groupBy(node).agg(F.min(other).alias("least")).withColumnRenamed(node, "_node")
    if small:
        return links.join(F.broadcast(least), F.col(node) == F.col("_node")).drop("_node")
    # staged, so that it is joined on its own and Spark can split the rows of a hot node
    return links.join(stage(least, "least"), F.col(node) == F.col("_node")).drop("_node")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, label): every id with a link and the least id of its component.

    Large-star and small-star steps alternate until the links no longer change; both keep the components,
    and the number of rounds grows with the logarithm of the number of ids. Loops are ignored.
    """
    def ordered(x: Column, y: Column, rows: DataFrame) -> DataFrame:
        return rows.select(F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi")).filter("lo < hi").distinct()

    now = stage(ordered(F.col(a), F.col(b), links), "links")
    before, state = None, _state(now)
    while state != before and state[0]:
        small = 2 * state[0] <= BROADCAST  # a link has two nodes
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
            now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        large = _with_least(both, "u", "v", small).filter("v > u").select(F.least("least", "u").alias("lo"), F.col("v").alias("hi"))
        met = _with_least(large, "hi", "lo", small)
        joined = met.select("least", "lo").unionByName(met.select("least", F.col("hi").alias("lo")))
        now = stage(ordered(F.col("least"), F.col("lo"), joined), "links")
        before, state = state, _state(now)
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("label")).unionByName(
        now.select(F.col("lo").alias("id"), F.col("lo").alias("label")).distinct())
