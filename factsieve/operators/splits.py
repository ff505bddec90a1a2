"""Leak-free splits by fact group.

A split is a comparison of a group's seeded hash with one cut point per entity type, so
after the cut points are known (one row per type) assigning it needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factsieve import settings
from factsieve.functions.hashing import seeded
from factsieve.operators.ranking import cut_points


def group_cuts(groups: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Cut point per entity type: the last of the ``bround(n * fraction)`` heldout groups."""
    target = F.bround(F.col("_total") * F.lit(float(fraction)), 0).cast("long")
    return cut_points(groups.select("entity_type", "fact_group_id"), ["entity_type"],
                      "fact_group_id", seed, target)


def is_heldout(seed: int, group: Column, cut: Column) -> Column:
    key = F.struct(seeded(seed, group).alias("h"), group.alias("id"))
    return F.coalesce(key <= cut, F.lit(False))


def attach_split(rows: DataFrame, cuts: DataFrame, seed: int, name: str = "split") -> DataFrame:
    """Add train / heldout to rows carrying ``entity_type`` and ``fact_group_id``.

    ``cuts`` has one row per entity type of the attribute declaration, hence the broadcast.
    """
    return (
        rows.join(F.broadcast(cuts), "entity_type", "left")
        .withColumn(name, F.when(is_heldout(seed, F.col("fact_group_id"), F.col("cut")), "heldout")
                    .otherwise("train"))
        .select(*rows.columns, name)
    )


def split_groups(groups: DataFrame, fraction: float = settings.HELDOUT_FRACTION,
                 seed: int = settings.SPLIT_SEED) -> DataFrame:
    """Stratified group split: (fact_group_id, entity_type, split)."""
    base = groups.select("fact_group_id", "entity_type")
    return attach_split(base, group_cuts(base, fraction, seed), seed)


def split_examples(examples: DataFrame, splits: DataFrame) -> DataFrame:
    """Example split from its groups: one group decides alone, several must all be heldout.

    A record of a group that ``splits`` doesn't know fails the job; one without groups is train.
    """
    unknown = F.raise_error(F.concat(F.lit("no split for fact group "), F.col("_g"))).cast("string")
    own = splits.select(F.col("fact_group_id").alias("_g"), F.col("split").alias("_s"))
    groups = F.col("metadata.fact_group_ids")
    with_split = F.col("metadata").withField("split", F.col("_s"))
    columns = [c for c in examples.columns if c != "metadata"]

    single = (
        examples.filter(F.size(groups) == 1).withColumn("_g", F.get(groups, F.lit(0)))
        .join(own, "_g", "left").withColumn("_s", F.coalesce("_s", unknown))
        .select(*columns, with_split.alias("metadata"))
    )
    several = examples.filter(F.size(groups) != 1)
    decided = (
        several.select("record_id", F.explode(groups).alias("_g")).join(own, "_g", "left")
        .withColumn("_s", F.coalesce("_s", unknown)).groupBy("record_id")
        .agg(F.when(F.bool_and(F.col("_s") == "heldout"), "heldout").otherwise("train").alias("_s"))
    )
    joined = several.join(decided, "record_id", "left").withColumn(
        "_s", F.coalesce("_s", F.lit("train"))
    ).select(*columns, with_split.alias("metadata"))
    return single.unionByName(joined).select(*examples.columns)


def split_for_tuning(examples: DataFrame, groups: DataFrame,
                     fraction: float = settings.SFT_VAL_FRACTION,
                     seed: int = settings.SFT_SEED) -> DataFrame:
    """The trainer's own train/val split, over all groups of the fact table."""
    split = split_examples(examples, split_groups(groups, fraction, seed))
    label = F.when(F.col("metadata.split") == "heldout", "val").otherwise("train")
    return split.withColumn("tuning_split", label)


def only_split(examples: DataFrame, split: str) -> DataFrame:
    return examples.filter(F.col("metadata.split") == split)
