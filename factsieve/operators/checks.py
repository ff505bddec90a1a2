"""Build validation: every check returns violations as (check, key, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factsieve import settings
from factsieve.operators.facts import value_counts


def _rows(df: DataFrame, check: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), key.cast("string").alias("key"),
                     detail.cast("string").alias("detail"))


def _absent(spark, check: str, names, present: DataFrame) -> DataFrame:
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("key"))
    return _rows(wanted.join(present, "key", "left_anti"), check, F.col("key"), F.lit("absent"))


def check_splits(splits: DataFrame) -> DataFrame:
    """Both splits hold at least one group."""
    return _absent(splits.sparkSession, "splits", ("train", "heldout"),
                   splits.select(F.col("split").alias("key")).distinct())


def check_split_consistency(examples: DataFrame, splits: DataFrame) -> DataFrame:
    """A record of one group is in that group's split."""
    md = F.col("metadata")
    own = examples.filter(F.size(md["fact_group_ids"]) == 1).select(
        "record_id", F.get(md["fact_group_ids"], F.lit(0)).alias("fact_group_id"), md["split"].alias("found"))
    wrong = own.join(splits, "fact_group_id").filter(~F.col("found").eqNullSafe(F.col("split")))
    return _rows(wrong, "split_consistency", F.col("record_id"),
                 F.concat(F.coalesce("found", F.lit("none")), F.lit(" <> "), F.col("split")))


def check_coverage(examples: DataFrame) -> DataFrame:
    """Every source type produced something."""
    return _absent(examples.sparkSession, "coverage", settings.SOURCE_TYPES,
                   examples.select(F.col("metadata.source_type").alias("key")).distinct())


def check_fact_coverage(facts: DataFrame, examples: DataFrame) -> DataFrame:
    """Every fact has a paraphrase and a forward question."""
    md = F.col("metadata")
    forward = (md["source_type"] == "qa") & (md["direction"] == "forward")
    seen = examples.filter((md["source_type"] == "paraphrase") | forward).select(
        F.explode(md["fact_ids"]).alias("fact_id"), (md["source_type"] == "paraphrase").alias("p"),
    ).groupBy("fact_id").agg(F.max("p").alias("p"), F.max(~F.col("p")).alias("q"))
    state = facts.select("fact_id").distinct().join(seen, "fact_id", "left").select(
        "fact_id", F.explode(F.array(
            F.when(~F.coalesce("p", F.lit(False)), "no_paraphrase"),
            F.when(~F.coalesce("q", F.lit(False)), "no_forward_question"))).alias("what")).filter(F.col("what").isNotNull())
    return _rows(state, "fact_coverage", F.col("fact_id"), F.col("what"))


def check_reverse_unique(facts: DataFrame, examples: DataFrame) -> DataFrame:
    """No reverse question on a value more than one fact holds (or none), recounted from the facts."""
    md = F.col("metadata")
    reverse = examples.filter((md["source_type"] == "qa") & (md["direction"] == "reverse")).select(
        F.get(md["fact_ids"], F.lit(0)).alias("fact_id"))
    held = reverse.join(facts.select("fact_id", "entity_type", "attribute", "value"), "fact_id")
    shared = value_counts(facts).filter(F.col("n_holders") > 1)
    return _rows(held.join(shared, ["entity_type", "attribute", "value"]), "reverse_unique",
                 F.col("fact_id"), F.col("n_holders"))


def check_name_leak(declared: DataFrame, facts: DataFrame, spec=settings.ATTRIBUTES) -> DataFrame:
    """Declared name-alikes (``cluster, entity``) must share no retain axis within their cluster.

    Members sharing a value are found by counting (cluster, attribute, value), not by pairing.
    """
    held = facts.filter(F.col("attribute").isin(*settings.retain_attributes(spec))).select(
        "entity", "attribute", "value").join(declared, "entity")
    key = ["cluster", "attribute", "value"]
    shared = held.groupBy(*key).agg(F.countDistinct("entity").alias("_n")).filter(F.col("_n") > 1)
    leaks = _rows(held.join(shared, key), "name_leak", F.col("entity"),
                  F.concat("attribute", F.lit("="), "value")).distinct()
    unknown = _rows(declared.join(facts.select("entity").distinct(), "entity", "left_anti"),
                    "name_leak", F.col("entity"), F.lit("unknown entity"))
    return leaks.unionByName(unknown)


def validate_build(facts: DataFrame, examples: DataFrame, splits: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """All checks in one violations table; the build is good when it is empty."""
    out = (
        check_splits(splits).unionByName(check_split_consistency(examples, splits))
        .unionByName(check_coverage(examples)).unionByName(check_fact_coverage(facts, examples))
        .unionByName(check_reverse_unique(facts, examples))
    )
    return out if declared is None else out.unionByName(check_name_leak(declared, facts))


def verdict(violations: DataFrame) -> DataFrame:
    """ok flag and number of failures per check."""
    per = violations.groupBy("check").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_failures")).select(
        (F.col("n_failures") == 0).alias("ok"), "n_failures")
