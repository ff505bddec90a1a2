"""Manifest of model revisions: upsert, lookup, parents, siblings, report status."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def upsert_rows(current: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``current`` with the same key."""
    keys = [key] if isinstance(key, str) else key
    return current.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def next_revision(revisions: DataFrame) -> DataFrame:
    return revisions.agg((F.coalesce(F.max("revision"), F.lit(-1)) + 1).alias("next_revision"))


def revision_label(method: str = "method", request_type: str = "request_type"):
    return F.concat_ws("-", method, request_type)


def get_revision(revisions: DataFrame, revision: int) -> DataFrame:
    return revisions.filter(F.col("revision") == revision)


def revision_pairs(revisions: DataFrame) -> DataFrame:
    """Every revision with the state of its parent: ok, baseline or missing_parent."""
    known = revisions.select(F.col("revision").alias("parent_revision"), F.lit(True).alias("_known")).distinct()
    return revisions.join(known, "parent_revision", "left").select(
        "revision", "parent_revision", "method",
        F.when(F.col("parent_revision").isNull(), "baseline").when(F.col("_known").isNull(), "missing_parent")
        .otherwise("ok").alias("status"))


def sibling_revisions(revisions: DataFrame) -> DataFrame:
    """First revision with the same parent and request but another method, for every erasure run.

    Runs are reduced to the first revision per (parent, request, method) before anything is
    compared; a group then has as many entries as there are methods, whatever its size.
    """
    key = ["_parent", "request_id"]
    runs = revisions.filter(F.col("request_id").isNotNull() & F.col("method").isNotNull()).withColumn(
        "_parent", F.coalesce(F.col("parent_revision").cast("string"), F.lit("none")))
    firsts = runs.groupBy(*key, "method").agg(F.min("revision").alias("first")).groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("first", "method"))).alias("_firsts"))
    other = F.get(F.filter("_firsts", lambda x: x["method"] != F.col("method")), F.lit(0))
    return runs.join(firsts.filter(F.size("_firsts") > 1), key).withColumn("_o", other).select(
        "revision", "request_id", "method", F.col("_o.first").alias("sibling_revision"),
        F.col("_o.method").alias("sibling_method"))


def revision_view(revisions: DataFrame, accuracies: DataFrame, reports: DataFrame) -> DataFrame:
    """One uniform row per revision.

    ``accuracies(revision, eval_accuracy, forget_accuracy_after)``: a revision with an
    evaluation of its own (the baseline) is headed by that, any other by its forget accuracy.
    """
    has_eval = F.col("eval_accuracy").isNotNull()
    return (
        revisions.join(accuracies, "revision", "left")
        .join(reports.select("revision", F.lit(True).alias("_report")).distinct(), "revision", "left")
        .select(
            "revision", "label", "parent_revision", "method",
            F.when(has_eval, "baseline_eval_summary").otherwise("unlearning_accuracy_before_after").alias("accuracy_kind"),
            F.when(has_eval, F.col("eval_accuracy")).otherwise(F.col("forget_accuracy_after")).alias("headline_accuracy"),
            F.coalesce("_report", F.lit(False)).alias("has_verification_report"))
    )


def report_status(asked: DataFrame, revisions: DataFrame, reports: DataFrame) -> DataFrame:
    """Per asked revision: available, unknown, baseline or not_verified; and if one may be made."""
    rows = asked.select("revision").distinct().join(
        revisions.select("revision", "parent_revision", F.lit(True).alias("_known")), "revision", "left"
    ).join(reports.select("revision", F.lit(True).alias("_report")).distinct(), "revision", "left")
    status = (
        F.when(F.col("_report"), "available").when(F.col("_known").isNull(), "unknown")
        .when(F.col("parent_revision").isNull(), "baseline").otherwise("not_verified")
    )
    return rows.select("revision", status.alias("status"),
                       (F.col("_known").isNotNull() & F.col("parent_revision").isNotNull()).alias("can_generate"))


def dataset_info(examples: DataFrame) -> DataFrame:
    """Dataset sizes kept with a revision."""
    return examples.groupBy(F.col("metadata.split").alias("split")).agg(F.count(F.lit(1)).alias("n_records"))
