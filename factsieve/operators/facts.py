"""Fact tables: groups, entities, value holders, pivots and consistency checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factsieve import settings
from factsieve.operators.skew import attach_counts

KEY = ["entity_type", "attribute", "value"]


def entities(facts: DataFrame) -> DataFrame:
    """One row per fact group; its first fact (by id) names the entity."""
    first = F.min(F.struct("fact_id", "entity", "entity_type"))
    return facts.groupBy("fact_group_id").agg(
        first.alias("f"), F.count(F.lit(1)).alias("n_facts")
    ).select("fact_group_id", F.col("f.entity").alias("entity"),
             F.col("f.entity_type").alias("entity_type"), "n_facts")


def pivot_facts(facts: DataFrame, attributes: list[str]) -> DataFrame:
    """Long to wide: one value per attribute (last fact wins) and its fact id.

    Every output column is a bounded aggregate, so nothing is collected per group.
    """
    def last(attribute: str):
        return F.max(F.when(F.col("attribute") == attribute, F.struct("fact_id", "value")))

    wide = facts.groupBy("fact_group_id").agg(
        F.min(F.struct("fact_id", "entity", "entity_type")).alias("f"),
        *[last(a).alias(f"_{a}") for a in attributes],
    )
    return wide.select(
        "fact_group_id", F.col("f.entity").alias("entity"),
        F.col("f.entity_type").alias("entity_type"),
        *[F.col(f"_{a}.value").alias(a) for a in attributes],
        *[F.col(f"_{a}.fact_id").alias(f"{a}_fact_id") for a in attributes],
    )


def entity_profiles(facts: DataFrame, spec=settings.ATTRIBUTES) -> DataFrame:
    """Fact group as one row: a map attribute -> value over the attributes it holds."""
    attributes = [s.attribute for s in spec]
    wide = pivot_facts(facts, attributes)
    pairs = F.filter(
        F.array(*[F.struct(F.lit(a).alias("key"), F.col(a).alias("value")) for a in attributes]),
        lambda p: p["value"].isNotNull(),
    )
    return wide.select("fact_group_id", "entity", "entity_type",
                       F.map_from_entries(pairs).alias("attributes"))


def value_counts(facts: DataFrame) -> DataFrame:
    """Holders per (type, attribute, value); counts rows, not distinct entities."""
    return facts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_holders"))


def value_uniqueness(facts: DataFrame) -> DataFrame:
    """Every fact with the number of facts holding the same value."""
    return attach_counts(facts, KEY, F.col("fact_id"), "n_holders")


def unique_value_facts(facts: DataFrame) -> DataFrame:
    """The facts nobody else shares the value of, straight from the aggregate."""
    columns = [c for c in facts.columns if c not in KEY]
    return (
        facts.groupBy(*KEY)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*columns)).alias("_f"))
        .filter(F.col("_n") == 1)
        .select(*[F.col(f"_f.{c}").alias(c) if c in columns else F.col(c) for c in facts.columns])
    )


def value_clusters(facts: DataFrame, min_size: int = settings.MIN_CLUSTER) -> DataFrame:
    """Members of every value held at least ``min_size`` times, one row per member."""
    return attach_counts(facts, KEY, F.col("fact_id"), "n_holders").filter(
        F.col("n_holders") >= min_size
    ).select(*KEY, "n_holders", "entity", "fact_group_id")


def reverse_skips(facts: DataFrame) -> DataFrame:
    """Facts per attribute that get no reverse question as their value is shared."""
    return (
        value_counts(facts).filter(F.col("n_holders") > 1)
        .groupBy("attribute").agg(F.sum("n_holders").alias("n_skipped"))
    )


def cluster_histogram(facts: DataFrame, attributes=("industry", "role")) -> DataFrame:
    """How many values have how many distinct holders."""
    return (
        facts.filter(F.col("attribute").isin(*attributes))
        .groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("cluster_size"))
        .groupBy("attribute", "cluster_size").agg(F.count(F.lit(1)).alias("n_values"))
    )


def duplicate_values(facts: DataFrame, attributes=("ceo", "flagship_product")) -> DataFrame:
    """Shared values of the given attributes with each of their holders."""
    return value_clusters(facts.filter(F.col("attribute").isin(*attributes)), 2).select(
        "attribute", "value", "entity", "n_holders"
    )


def sibling_facts(facts: DataFrame, by: str = "fact_id") -> DataFrame:
    """Pairs (fact, other fact of its group); ``by='attribute'`` keeps other attributes only.

    A group holds ``FACTS_PER_GROUP`` facts (``drift_violations`` reports any other size),
    so this is a fixed fan-out per fact.
    """
    left = facts.select("fact_group_id", "fact_id", "attribute")
    right = facts.select("fact_group_id", F.col("fact_id").alias("sibling_fact_id"),
                         F.col("attribute").alias("sibling_attribute"))
    differs = (
        F.col("attribute") != F.col("sibling_attribute") if by == "attribute"
        else F.col("fact_id") != F.col("sibling_fact_id")
    )
    return left.join(right, "fact_group_id").filter(differs)


def groups_with_attribute(facts: DataFrame, spec=settings.ATTRIBUTES) -> DataFrame:
    """(entity_type, attribute, group) for every attribute that belongs to the type."""
    known = [f"{s.entity_type}|{s.attribute}" for s in spec]
    return (
        facts.filter(F.concat_ws("|", "entity_type", "attribute").isin(*known))
        .select("entity_type", "attribute", "fact_group_id").distinct()
    )


def drift_violations(facts: DataFrame, audit: DataFrame) -> DataFrame:
    """Differences between the facts and an audit table (entity, fact_group_id)."""
    ours = entities(facts)
    theirs = audit.select("entity", F.col("fact_group_id").alias("audit_group_id"))
    names = facts.select("entity").distinct()

    def rows(check: str, df: DataFrame, detail) -> DataFrame:
        return df.select(F.lit(check).alias("check"), F.col("entity").alias("key"),
                         detail.cast("string").alias("detail"))

    missing = rows("missing_from_audit", names.join(theirs, "entity", "left_anti"), F.lit(""))
    stale = rows("missing_from_facts", theirs.join(names, "entity", "left_anti"), F.lit(""))
    size = rows("group_size", ours.filter(F.col("n_facts") != settings.FACTS_PER_GROUP),
                F.col("n_facts"))
    moved = rows(
        "group_mismatch",
        ours.join(theirs, "entity").filter(F.col("fact_group_id") != F.col("audit_group_id")),
        F.concat_ws(" <> ", "fact_group_id", "audit_group_id"),
    )
    return missing.unionByName(stale).unionByName(size).unionByName(moved)


def list_entities(facts: DataFrame) -> DataFrame:
    return entities(facts).select("entity", "entity_type", "fact_group_id").orderBy("entity")


def list_attributes(facts: DataFrame, entity_type: str | None = None,
                    spec=settings.ATTRIBUTES) -> DataFrame:
    """Declared attributes (of one type, or all, sorted) with the number of facts holding them."""
    known = facts.sparkSession.createDataFrame(
        [(s.entity_type, s.attribute) for s in settings.specs(entity_type, spec)],
        "entity_type string, attribute string",
    )
    held = facts.groupBy("entity_type", "attribute").agg(F.count(F.lit(1)).alias("n_facts"))
    return (
        F.broadcast(known).join(held, ["entity_type", "attribute"], "left")
        .select("entity_type", "attribute", F.coalesce("n_facts", F.lit(0)).alias("n_facts"))
        .orderBy("attribute")
    )
