"""Verification of erasure revisions: all signals, one nested report row per revision."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factsieve.operators import scoring as sc


def report_signals(pools: DataFrame, revisions: DataFrame, relational: DataFrame, membership: DataFrame,
                   reference: DataFrame, prompts: DataFrame, comparison: DataFrame) -> DataFrame:
    """Join the independent signals (each small: one row per revision or request) on the revision."""
    impact = sc.impact_assessment(pools, revisions)
    mia = membership.select("request_id", F.col("mean_rank").alias("mia_mean_rank"),
                            F.col("median_rank").alias("mia_median_rank"), F.col("small_forget_set").alias("mia_small_set"))
    ref = reference.select("request_id", F.col("available").alias("reference_available"), "reference_accuracy")
    rel = relational.select("revision", "request_id", "n_relational_probed", "dropped_out_rate", "siblings_preserved_rate")
    gc = prompts.select("revision", F.col("n").alias("n_prompts"), F.col("accuracy").alias("prompt_accuracy"))
    versus = comparison.select(
        "revision", "sibling_revision", "sibling_method", "this_forget_accuracy", "sibling_forget_accuracy",
        "this_neighbor_accuracy", "sibling_neighbor_accuracy")
    return (
        impact.join(rel, ["revision", "request_id"], "left").join(mia, "request_id", "left")
        .join(ref, "request_id", "left").join(gc, "revision", "left").join(versus, "revision", "left")
    )


def erasure_report(signals: DataFrame, summary: DataFrame, stop: DataFrame, revisions: DataFrame) -> DataFrame:
    """Nested report: what was targeted, what was done, results, impact, takeaways.

    The targeted ids are counted here and listed, sorted and in full, by ``targeted_keys``:
    an attribute-wide request can target any number of them.
    """
    rows = (
        sc.key_takeaways(signals)
        .join(summary, "request_id", "left")
        .join(stop, "revision", "left")
        .join(revisions.select("revision", "label"), "revision", "left")
    )

    def pack(*names: str):
        return F.struct(*[F.col(n) for n in names])

    return rows.select(
        "revision", "method", "label",
        pack("request_id", "request_type", "entity_type", "n_forget_facts", "n_forget_groups",
             "n_neighbor_entities").alias("what_was_targeted"),
        pack("method", "parent_revision", "early_stop_step", "n_forget_train", "n_forget_probe",
             "n_retain_neighbor", "n_retain_general").alias("what_was_done"),
        F.struct(
            pack("n_relational_probed", "dropped_out_rate", "siblings_preserved_rate").alias("relational_probing"),
            pack("mia_mean_rank", "mia_median_rank", "mia_small_set").alias("membership_inference"),
            pack("reference_available", "reference_accuracy").alias("reference_model_comparison"),
            pack("n_prompts", "prompt_accuracy").alias("general_capability"),
            pack("sibling_revision", "sibling_method", "this_forget_accuracy", "sibling_forget_accuracy",
                 "this_neighbor_accuracy", "sibling_neighbor_accuracy").alias("method_comparison"),
        ).alias("verification_results"),
        pack("neighbor_accuracy_before", "neighbor_accuracy_after", "neighbor_drift", "neighbor_within_tolerance",
             "general_accuracy_before", "general_accuracy_after", "general_drift", "general_within_tolerance",
             "forget_accuracy_after", "forget_collapsed").alias("impact_assessment"),
        "key_takeaways",
    )


def targeted_keys(keys: DataFrame) -> DataFrame:
    """The full sorted id lists behind a report, in rows."""
    return keys.filter((F.col("pool") == "forget") | (F.col("key_kind") == "group")).select(
        "request_id", "pool", "key_kind", "key", "entity").orderBy("request_id", "pool", "key_kind", "key")


def render_report(reports: DataFrame) -> DataFrame:
    """Report rows as JSON and Markdown documents."""
    def block(name: str):
        return F.concat(F.lit("```json\n"), F.to_json(name, {"pretty": "true", "ignoreNullFields": "false"}), F.lit("\n```\n"))

    sections = [
        ("What Was Targeted", block("what_was_targeted")), ("What Was Done", block("what_was_done")),
        ("Verification Results", block("verification_results")), ("Impact Assessment", block("impact_assessment")),
        ("Key Takeaways", F.concat(F.array_join(F.transform("key_takeaways", lambda b: F.concat(F.lit("- "), b)), "\n"), F.lit("\n"))),
    ]
    parts = [F.lit("# Erasure Report -- revision-"), F.col("revision").cast("string"), F.lit(" ("), F.col("method"), F.lit(")\n\n")]
    for title, body in sections:
        parts += [F.lit(f"## {title}\n\n"), body, F.lit("\n")]
    document = F.struct(*[F.col(c) for c in reports.columns])
    return reports.select("revision", F.to_json(document, {"ignoreNullFields": "false"}).alias("json"),
                          F.concat(*parts).alias("markdown"))


def render_build_report(counts: DataFrame, skips: DataFrame) -> DataFrame:
    """Corpus counts and reverse-question skips as a Markdown and a JSON document (both inputs are a few rows)."""
    def table(df: DataFrame, line):
        return df.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("t"))

    rows = table(counts, F.format_string("| %s | %d | %d |", "source_type", "train", "heldout"))
    skipped = table(skips, F.format_string("- `%s`: %d skipped", "attribute", "n_skipped")).scalar()
    total = counts.agg(F.sum(F.col("train") + F.col("heldout"))).scalar()
    by_type = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
        "source_type", F.struct("train", "heldout", (F.col("train") + F.col("heldout")).alias("total"))))))).scalar()
    by_attribute = skips.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attribute", "n_skipped"))))).scalar()
    document = F.struct(total.alias("total_examples"), by_type.alias("examples"), by_attribute.alias("reverse_skipped"))
    return rows.select(F.concat(
        F.lit("# Build report\n\nTotal examples: "), total.cast("string"),
        F.lit("\n\n## Examples by source_type x split\n\n| source_type | train | heldout |\n|---|---|---|\n"), "t",
        F.lit("\n\n## Reverse-QA examples skipped (non-unique value)\n\n"), skipped, F.lit("\n")).alias("markdown"),
        F.to_json(document).alias("json"))
