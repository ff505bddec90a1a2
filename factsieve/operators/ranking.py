"""Seeded order statistics without a global sort.

The rank of a row in its stratum under ``md5(seed|id)`` is needed for splits, samples and
draws. md5 is uniform, so its leading hex digits cut every stratum into even slices:
count per slice, add the counts up (one short row list per stratum), and order rows only
inside the slice that matters. No task ever sees a whole stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factsieve import settings
from factsieve.functions.hashing import seeded
from factsieve.session import written


def with_slice(df: DataFrame, seed, id_col: str, digits: int = settings.RANK_HEX) -> DataFrame:
    return df.withColumn("_h", seeded(seed, F.col(id_col))).withColumn(
        "_slice", F.substring("_h", 1, digits)
    )


def slice_offsets(sliced: DataFrame, strata: list[str]) -> DataFrame:
    """Per stratum and slice: rows in it, rows before it, rows in the stratum.

    The windows run over at most ``16**digits`` pre-aggregated rows per stratum.
    """
    per_slice = sliced.groupBy(*strata, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*strata).orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*strata)
    return (
        per_slice.withColumn("_upto", F.sum("_n").over(run))
        .withColumn("_total", F.sum("_n").over(whole))
        .withColumn("_before", F.col("_upto") - F.col("_n"))
    )


def cut_points(df: DataFrame, strata: list[str], id_col: str, seed, target: Column,
               digits: int = settings.RANK_HEX) -> DataFrame:
    """The (hash, id) of the ``target``-th row of each stratum; ``target`` may use ``_total``.

    One row per stratum with a positive target: ``cut``, to be compared with
    ``struct(hash, id)``.
    """
    sliced = with_slice(df.select(*strata, id_col), seed, id_col, digits)
    edge = (
        slice_offsets(sliced, strata)
        .withColumn("_target", target)
        .filter((F.col("_before") < F.col("_target")) & (F.col("_upto") >= F.col("_target")))
        .select(*strata, "_slice", (F.col("_target") - F.col("_before")).alias("_left"))
    )
    order = Window.partitionBy(*strata, "_slice").orderBy("_h", id_col)
    return (
        sliced.join(edge, [*strata, "_slice"])
        .withColumn("_rn", F.row_number().over(order))
        .filter(F.col("_rn") == F.col("_left"))
        .select(*strata, F.struct(F.col("_h").alias("h"), F.col(id_col).alias("id")).alias("cut"))
    )


def hash_rank(df: DataFrame, strata: list[str], id_col: str, seed, name: str = "rank",
              digits: int = settings.RANK_HEX) -> DataFrame:
    """1-based rank of every row of a stratum under the seeded hash order."""
    sliced = with_slice(df, seed, id_col, digits)
    order = Window.partitionBy(*strata, "_slice").orderBy("_h", id_col)
    offsets = slice_offsets(sliced, strata).select(*strata, "_slice", "_before")
    return (
        sliced.withColumn("_rn", F.row_number().over(order))
        .join(offsets, [*strata, "_slice"])
        .withColumn(name, F.col("_before") + F.col("_rn"))
        .drop("_h", "_slice", "_rn", "_before")
    )


def sample_n(df: DataFrame, id_col: str, n: int, seed) -> DataFrame:
    """``n`` rows without replacement, everything if there are no more (a top-k, not a sort)."""
    return (
        df.withColumn("_h", seeded(seed, F.col(id_col))).orderBy("_h", id_col).limit(n).drop("_h")
    )


def running_sum(df: DataFrame, strata: list[str], order: str, weight: str, name: str = "upto") -> DataFrame:
    """``df`` plus the sum of ``weight`` over the rows of the stratum up to and including this one.

    For rows unique on (strata, order), of any number. They are range-partitioned and written once, so that
    ranges stay what they are; a range is summed on its own, and the sums of the ranges before it (one row per
    range and stratum) are added. A null order comes first.
    """
    ranged = written(df.repartitionByRange(*strata, order).withColumn("_range", F.spark_partition_id()), "ranges")
    # rows here: one per range, and one more per further stratum in it
    earlier = Window.partitionBy(*strata).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy(*strata, "_range").agg(F.sum(weight).alias("_sum")).withColumn(
        "_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).select(
        *[F.col(k).alias(f"_of_{k}") for k in strata], F.col("_range").alias("_r"), "_before")
    inside = Window.partitionBy(*strata, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    on = F.col("_range") == F.col("_r")
    for k in strata:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return ranged.withColumn("_inside", F.sum(weight).over(inside)).join(before, on).select(
        *df.columns, (F.col("_before") + F.col("_inside")).alias(name))


def index_quantiles(df: DataFrame, strata: list[str], value: str,
                    positions: dict[str, Column]) -> DataFrame:
    """Values at given 1-based positions of the sorted list, per stratum.

    Equal values are counted first; the running sum over distinct values is distributed, so there may be
    any number of them. ``positions`` are expressions over ``n``, the stratum's row count.
    """
    per_value = df.groupBy(*strata, value).agg(F.count(F.lit(1)).alias("_c"))
    marked = running_sum(per_value, strata, value, "_c", "_upto")
    totals = marked.groupBy(*strata).agg(F.sum("_c").alias("n"))
    if strata:
        on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in strata]
        counted = marked.join(totals.select(*[F.col(k).alias(f"_of_{k}") for k in strata], "n"), on)
    else:
        counted = marked.withColumn("n", totals.scalar())
    return counted.groupBy(*strata).agg(
        F.max("n").alias("n"),
        *[F.min(F.when(F.col("_upto") >= p, F.col(value))).alias(a) for a, p in positions.items()],
    )
