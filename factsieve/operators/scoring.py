"""Scoring of answers against the facts, accuracy by pool, drift and stop rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factsieve import settings
from factsieve.functions.text import answer_matches, percent, two_decimals
from factsieve.operators.examples import forward_qa, scoreable
from factsieve.operators.targeting import FORGET, NEIGHBOR


def expected_answers(examples: DataFrame, facts: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(record_id, entity, attribute, expected): what a right answer must contain; plus columns of the records to ``carry``.

    Reverse questions ask for the entity, everything else for the value of its one fact;
    records on no or several facts are not scored.
    """
    md = F.col("metadata")
    reverse = (md["source_type"] == "qa") & (md["direction"] == "reverse")
    rows = scoreable(examples).select(
        "record_id", md["source_type"].alias("source_type"), md["direction"].alias("direction"),
        md["entity"].alias("entity"), md["attribute"].alias("attribute"),
        F.coalesce(reverse, F.lit(False)).alias("_reverse"),
        F.when(F.size(md["fact_ids"]) == 1, F.get(md["fact_ids"], F.lit(0))).alias("fact_id"), *carry)
    values = facts.select("fact_id", F.col("value").alias("_value"))
    return rows.join(values, "fact_id", "left").withColumn(
        "expected", F.when(F.col("_reverse"), F.col("entity")).otherwise(F.col("_value"))
    ).filter(F.col("expected").isNotNull()).drop("_reverse", "_value")


def score_answers(expected: DataFrame, predictions: DataFrame) -> DataFrame:
    """Expected answers joined to predictions, with the containment verdict."""
    return predictions.select("revision", "record_id", "answer").join(expected, "record_id").withColumn(
        "correct", answer_matches(F.col("answer"), F.col("expected")))


def score_in_place(answered: DataFrame, facts: DataFrame) -> DataFrame:
    """Verdicts beside the record: (record_id, entity, attribute, verdicts), for records that hold their
    ``answers`` (array of revision, answer). Neither answers nor verdicts are joined to the records."""
    return expected_answers(answered, facts, ("answers",)).select(
        "record_id", "entity", "attribute", F.transform("answers", lambda a: F.struct(
            a["revision"].alias("revision"), answer_matches(a["answer"], F.col("expected")).alias("correct"))).alias("verdicts"))


def unfolded(scored: DataFrame) -> DataFrame:
    """``score_in_place`` as a row per revision and record."""
    return scored.select(*[c for c in scored.columns if c != "verdicts"], F.inline("verdicts"))


def accuracy(scores: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy per ``by`` overall (attribute null) and per attribute, in one pass."""
    return (
        scores.groupingSets([[*by, "attribute"], [*by]], *by, "attribute")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("int")).alias("accuracy"))
    )


def quick_eval(examples: DataFrame, facts: DataFrame, predictions: DataFrame, flagship: str) -> DataFrame:
    """Forward-question accuracy per revision; 0.0 without records, flagship null without its own."""
    scores = score_answers(expected_answers(forward_qa(examples), facts), predictions)
    return quick_summary(scores, predictions, flagship)


def quick_summary(scores: DataFrame, predictions: DataFrame, flagship: str) -> DataFrame:
    """``quick_eval`` of forward questions that are scored already."""
    right = F.col("correct").cast("int")
    per_attribute = scores.groupBy("revision", "attribute").agg(
        F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy")).withColumn("flagship_accuracy", F.lit(None).cast("double"))
    # revisions without a scoreable record still get their zero; both sides are one row a revision
    sums = scores.groupBy("revision").agg(
        F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"),
        F.avg(F.when(F.col("entity") == flagship, right)).alias("flagship_accuracy"))
    overall = predictions.select("revision").distinct().join(sums, "revision", "left").select(
        "revision", F.lit(None).cast("string").alias("attribute"), F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"), "flagship_accuracy")
    return overall.unionByName(per_attribute)


def pool_accuracy(scores: DataFrame, classified: DataFrame, probes: DataFrame, requests: DataFrame) -> DataFrame:
    """Accuracy per revision, request and pool: forget, retain_neighbor, general, forget_probe.

    The general pool is everything minus the touched records, so its sums are the totals
    minus the sums of the other two pools: no record of it is joined to any request. ``scores`` are rows
    (revision, record_id, attribute, correct), or a row per record with ``verdicts``, which is joined as one.
    """
    right = F.sum(F.col("correct").cast("int"))
    cell = ["revision", "request_id", "pool", "attribute"]
    verdicts = "verdicts" if "verdicts" in scores.columns else F.array(F.struct("revision", "correct")).alias("verdicts")
    slim = scores.select("record_id", "attribute", verdicts)
    marks = classified.select("request_id", "record_id", "pool").unionByName(
        probes.filter(F.col("part") == "forget_probe").select("request_id", "record_id", F.lit("forget_probe").alias("pool")))
    inner = unfolded(slim.join(marks, "record_id")).groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), right.alias("r"))
    slim, touched = unfolded(slim), inner.filter(F.col("pool") != "forget_probe")
    # revisions x attributes entries, handed to every request as one value
    totals = slim.groupBy("revision", "attribute").agg(F.count(F.lit(1)).alias("tn"), right.alias("tr")).agg(
        F.collect_list(F.struct("revision", "attribute", "tn", "tr"))).scalar()
    inside = touched.groupBy("revision", "request_id", "attribute").agg(F.sum("n").alias("_n"), F.sum("r").alias("_r"))
    general = (
        requests.select("request_id").distinct().select("request_id", F.inline(totals))
        .join(inside, ["revision", "request_id", "attribute"], "left")
        .select("revision", "request_id", F.lit("retain_general").alias("pool"), "attribute",
                (F.col("tn") - F.coalesce("_n", F.lit(0))).alias("n"), (F.col("tr") - F.coalesce("_r", F.lit(0))).alias("r"))
        .filter(F.col("n") > 0)
    )
    cells = inner.unionByName(general)
    return cells.groupingSets([cell, cell[:3]], *cell).agg(
        F.sum("n").alias("n"), (F.sum("r") / F.sum("n")).alias("accuracy"))


def prompt_accuracy(answers: DataFrame, prompts=settings.PROMPTS) -> DataFrame:
    """Accuracy on the fixed prompts; ``answers(revision, prompt_no, answer)``."""
    listed = F.broadcast(answers.sparkSession.createDataFrame(
        [(i, p, e) for i, (p, e) in enumerate(prompts)], "prompt_no int, prompt string, expected string"))
    return answers.join(listed, "prompt_no").groupBy("revision").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(answer_matches(F.col("answer"), F.col("expected")).cast("int")).alias("n_correct"),
    ).withColumn("accuracy", F.col("n_correct") / F.col("n"))


def compare_revisions(predictions: DataFrame, expected: DataFrame, before: int, after: int) -> DataFrame:
    """The same question under two revisions, for questions whose answer differs."""
    a = predictions.filter(F.col("revision") == before).select("record_id", F.col("answer").alias("answer_before"))
    b = predictions.filter(F.col("revision") == after).select("record_id", F.col("answer").alias("answer_after"))
    both = a.join(b, "record_id").filter(~F.col("answer_before").eqNullSafe(F.col("answer_after")))
    was = answer_matches(F.col("answer_before"), F.col("expected"))
    now = answer_matches(F.col("answer_after"), F.col("expected"))
    return both.join(expected.select("record_id", "expected"), "record_id", "left").withColumn(
        "lost", F.coalesce(was & ~now, F.lit(False))).withColumn("gained", F.coalesce(now & ~was, F.lit(False)))


def _pools_wide(log: DataFrame, by: list[str], value: str, pools: dict[str, str]) -> DataFrame:
    return log.groupBy(*by).agg(
        *[F.max(F.when(F.col("pool") == p, F.col(value))).alias(a) for p, a in pools.items()])


def early_stop_step(eval_log: DataFrame, collapse: float = settings.FORGET_COLLAPSE,
                    neighbor: float = settings.NEIGHBOR_TOLERANCE,
                    general: float = settings.GENERAL_TOLERANCE) -> DataFrame:
    """First step per run at which forgetting collapsed and nothing else drifted.

    An unknown accuracy counts as no drift; the baseline is step 0.
    """
    wide = _pools_wide(eval_log, ["run_id", "step"], "overall_accuracy",
                       {"forget": "f", "neighbor": "n", "general": "g"})
    base = wide.filter(F.col("step") == 0).select("run_id", F.col("n").alias("n0"), F.col("g").alias("g0"))
    steps = wide.filter(F.col("step") > 0).join(base, "run_id", "left")
    calm = ~F.coalesce(F.col("n0") - F.col("n") > neighbor, F.lit(False)) & ~F.coalesce(
        F.col("g0") - F.col("g") > general, F.lit(False))
    stop = F.coalesce(F.col("f") <= collapse, F.lit(False)) & calm
    return steps.groupBy("run_id").agg(F.min(F.when(stop, F.col("step"))).alias("early_stop_step"))


def impact_assessment(pools: DataFrame, revisions: DataFrame) -> DataFrame:
    """Before / after accuracy, drift and verdicts per erasure revision.

    An unknown drift counts as out of tolerance, the opposite of the stop rule.
    """
    overall = _pools_wide(pools.filter(F.col("attribute").isNull()), ["revision", "request_id"], "accuracy",
                          {NEIGHBOR: "n", "retain_general": "g", FORGET: "f"})
    after = overall.select("revision", "request_id", F.col("n").alias("neighbor_accuracy_after"),
                           F.col("g").alias("general_accuracy_after"), F.col("f").alias("forget_accuracy_after"))
    before = overall.select(F.col("revision").alias("parent_revision"), "request_id",
                            F.col("n").alias("neighbor_accuracy_before"), F.col("g").alias("general_accuracy_before"))
    runs = revisions.filter(F.col("parent_revision").isNotNull()).select(
        "revision", "parent_revision", "method", "request_id")
    rows = runs.join(after, ["revision", "request_id"]).join(before, ["parent_revision", "request_id"], "left")
    for pool, tolerance in (("neighbor", settings.NEIGHBOR_TOLERANCE), ("general", settings.GENERAL_TOLERANCE)):
        drift = F.col(f"{pool}_accuracy_before") - F.col(f"{pool}_accuracy_after")
        rows = rows.withColumn(f"{pool}_drift", drift).withColumn(
            f"{pool}_within_tolerance", F.coalesce(F.col(f"{pool}_drift") <= tolerance, F.lit(False)))
    return rows.withColumn("forget_collapsed", F.coalesce(
        F.col("forget_accuracy_after") <= settings.FORGET_COLLAPSE, F.lit(False)))


def method_comparison(pools: DataFrame, siblings: DataFrame) -> DataFrame:
    """Accuracy of a revision beside that of the other method's run of the same request."""
    overall = _pools_wide(pools.filter(F.col("attribute").isNull()), ["revision", "request_id"], "accuracy",
                          {NEIGHBOR: "neighbor", FORGET: "forget"})

    def side(prefix: str, key: str) -> DataFrame:
        return overall.select(F.col("revision").alias(key), "request_id",
                              F.col("forget").alias(f"{prefix}_forget_accuracy"),
                              F.col("neighbor").alias(f"{prefix}_neighbor_accuracy"))

    return siblings.join(side("this", "revision"), ["revision", "request_id"]).join(
        side("sibling", "sibling_revision"), ["sibling_revision", "request_id"])


# --- fixed values: wording of the report's closing points -----------------------------------
def key_takeaways(report: DataFrame) -> DataFrame:
    """Ordered closing sentences per revision (array column ``key_takeaways``).

    Expects the columns of ``plans.verification.report_signals``; a missing signal leaves
    its sentence out.
    """
    def c(name: str) -> Column:
        return F.col(name)

    def verdict(flag: str, bad: str) -> Column:
        return F.when(c(flag), "within tolerance").otherwise(bad)

    def drift_line(title: str, pool: str) -> Column:
        return F.concat(F.lit(f"{title} accuracy: "), percent(c(f"{pool}_accuracy_before")), F.lit(" -> "),
                        percent(c(f"{pool}_accuracy_after")), F.lit(" ("),
                        verdict(f"{pool}_within_tolerance", "DRIFTED beyond tolerance"), F.lit(")."))

    caveat = F.when(c("mia_small_set"), " (small-sample caveat applies -- see Verification Results)").otherwise("")
    lines = F.array(
        F.concat(F.lit("Forget-set accuracy after erasure: "), percent(c("forget_accuracy_after")), F.lit(" ("),
                 F.when(c("forget_collapsed"), "collapsed").otherwise("did NOT collapse -- investigate"), F.lit(").")),
        drift_line("Neighbor", "neighbor"),
        drift_line("General-retain", "general"),
        F.when(c("mia_mean_rank").isNotNull(),
               F.concat(F.lit("MIA mean percentile rank vs. never-seen text: "), two_decimals(c("mia_mean_rank")),
                        caveat, F.lit("."))),
        F.when(c("reference_available"),
               F.concat(F.lit('Reference ("never learned it") model scores '), percent(c("reference_accuracy")),
                        F.lit(" on the same forgotten facts.")))
        .otherwise("No retain-only reference model available for this request -- see Verification Results."),
        F.when(c("n_relational_probed") > 0,
               F.concat(F.lit("Multi-hop probing: forgotten entity dropped out of "), percent(c("dropped_out_rate")),
                        F.lit(" of relational answers; retained siblings preserved in "),
                        percent(c("siblings_preserved_rate")), F.lit("."))),
        F.when(c("n_prompts").isNotNull(),
               F.concat(F.lit("General-capability spot-check: "), percent(c("prompt_accuracy")), F.lit(" on "),
                        c("n_prompts").cast("string"), F.lit(" fixed generic prompts."))),
        F.when(c("sibling_revision").isNotNull(),
               F.concat(F.upper(c("method")), F.lit(" vs "), F.upper(c("sibling_method")), F.lit(" (revision-"),
                        c("sibling_revision").cast("string"), F.lit("): forget accuracy "),
                        percent(c("this_forget_accuracy")), F.lit(" vs "), percent(c("sibling_forget_accuracy")),
                        F.lit("; neighbor accuracy "), percent(c("this_neighbor_accuracy")), F.lit(" vs "),
                        percent(c("sibling_neighbor_accuracy")), F.lit("."))),
    )
    return report.withColumn("key_takeaways", F.array_compact(lines))
