"""Probes beyond direct questions: lists, name-alike decoys, membership inference, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factsieve import settings
from factsieve.functions.text import answer_matches
from factsieve.operators.examples import forward_qa, scoreable
from factsieve.operators.ranking import running_sum, sample_n
from factsieve.operators.scoring import expected_answers, score_answers
from factsieve.operators.skew import attach
from factsieve.operators.targeting import FORGET, record_keys
from factsieve.session import written


CHUNK = 128  # characters of a text that are searched as one row


def _names_found(texts: DataFrame, names: DataFrame, scope: list[str]) -> DataFrame:
    """The names of a scope that its texts contain: (*scope, text_id, name), distinct.

    ``texts`` has (*scope, text_id, text), ``names`` has (*scope, name); empty names are never found. Substring
    search as an equi-join: a name can only match a piece of its own length that starts with its first
    character, so texts are cut into such pieces and joined to the names. The character -> lengths map is small
    whatever the number of names. A text is first cut into overlapping chunks, one row each, so that neither
    the text nor the search for a place in it is repeated per piece: work and rows grow with its length.
    """
    wanted = names.filter(F.length("name") > 0).select(*scope, "name").distinct()
    shapes = (
        wanted.groupBy(*scope, F.substring("name", 1, 1).alias("_first"))
        .agg(F.collect_set(F.length("name")).alias("_lengths"))
        .groupBy(*scope).agg(F.map_from_entries(F.collect_list(F.struct("_first", "_lengths"))).alias("_shapes"),
                             F.max(F.array_max("_lengths")).alias("_longest"))
    )
    step = F.greatest(F.lit(CHUNK), F.col("_longest"))
    # consumes a chunk, captures it together with what a name that begins in it may need beyond it
    cut = F.concat(F.lit("(?s)(?=(.{1,"), (step + F.col("_longest") - 1).cast("string"), F.lit("})).{1,"), step.cast("string"), F.lit("}"))
    chunks = texts.filter(F.length("text") > 0).join(shapes, scope).select(
        *scope, "text_id", "_shapes", step.alias("_step"), F.explode(F.regexp_extract_all("text", cut, F.lit(1))).alias("_chunk"))
    pieces = (
        chunks.withColumn("_at", F.explode(F.sequence(F.lit(1), F.least(F.col("_step"), F.length("_chunk")))))
        .withColumn("_len", F.explode(F.try_element_at("_shapes", F.substring(F.col("_chunk"), F.col("_at"), F.lit(1)))))
        .filter(F.col("_at") + F.col("_len") - 1 <= F.length("_chunk"))
        .select(*scope, "text_id", F.substring(F.col("_chunk"), F.col("_at"), F.col("_len")).alias("name"))
    )
    return pieces.join(wanted, [*scope, "name"], "left_semi").distinct()


def relational_probe(examples: DataFrame, keys: DataFrame, predictions: DataFrame, groups: DataFrame) -> DataFrame:
    """Per list record naming a forgotten group, and revision: is it gone, are the others still there.

    ``forgotten_dropped_out`` looks for every forgotten name of the request;
    ``siblings_present`` is null when the record has no retained name. The names of the retained groups
    come from ``groups(fact_group_id, entity)``, so a name may hold commas.

    Members of lists stay rows and texts go by their digest, so nothing is as long as list times text. A text
    that names the first forgotten member of its own list is settled by that; only the others are searched
    for all forgotten names.
    """
    md = F.col("metadata")
    lists = examples.filter(md["source_type"] == "relational")
    gone = keys.filter((F.col("key_kind") == "group") & (F.col("pool") == FORGET)).select("request_id", "key", "entity").distinct()
    touched = record_keys(lists).select("record_id", "key").join(gone, "key").groupBy("request_id", "record_id").agg(
        F.min(F.when(F.length("entity") > 0, F.lower("entity"))).alias("_own"))
    members = lists.select("record_id", F.explode(F.array_distinct(md["mentioned_entities"])).alias("key"))
    siblings = (
        touched.select("request_id", "record_id").join(members, "record_id")
        .join(gone.select("request_id", "key"), ["request_id", "key"], "left_anti")
        .join(groups.select(F.col("fact_group_id").alias("key"), F.lower("entity").alias("name")), "key")
        .select("request_id", "record_id", "name")
    )
    probed = touched.join(siblings.groupBy("request_id", "record_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count("name").alias("_named"), F.count_distinct(F.when(F.length("name") > 0, F.col("name"))).alias("_wanted"),
    ), ["request_id", "record_id"], "left")
    texts = predictions.join(probed, "record_id").select(
        "request_id", "revision", "record_id", F.md5("answer").alias("text_id"), F.lower("answer").alias("text"), "_n", "_named", "_wanted",
        F.coalesce(F.contains(F.lower("answer"), F.col("_own")), F.lit(False)).alias("_own"))

    open_texts = texts.filter(~F.col("_own")).groupBy("request_id", "text_id").agg(F.first("text").alias("text"))
    names = gone.select("request_id", F.lower("entity").alias("name"))
    seen = _names_found(open_texts, names, ["request_id"]).select("request_id", "text_id", F.lit(True).alias("_seen")).distinct()
    scope = ["request_id", "record_id"]
    own_texts = texts.filter(F.col("_wanted") > 0).groupBy(*scope, "text_id").agg(F.first("text").alias("text"))
    found = _names_found(own_texts, siblings, scope).groupBy(*scope, "text_id").agg(F.count(F.lit(1)).alias("_found"))
    return texts.drop("text").join(seen, ["request_id", "text_id"], "left").join(found, [*scope, "text_id"], "left").select(
        "request_id", "revision", "record_id", F.coalesce("_n", F.lit(0)).cast("int").alias("n_siblings"),
        (~F.col("_own") & F.col("_seen").isNull()).alias("forgotten_dropped_out"),
        # a missing answer or name leaves it open, as in SQL
        F.when(F.col("_n").isNotNull() & F.col("text_id").isNotNull(),
               F.when(F.coalesce("_found", F.lit(0)) < F.col("_wanted"), False).when(F.col("_named") == F.col("_n"), True))
        .alias("siblings_present"),
    )


def relational_summary(probe: DataFrame) -> DataFrame:
    return probe.groupBy("revision", "request_id").agg(
        F.count(F.lit(1)).alias("n_relational_probed"),
        F.avg(F.col("forgotten_dropped_out").cast("int")).alias("dropped_out_rate"),
        F.avg(F.col("siblings_present").cast("int")).alias("siblings_preserved_rate"))


def decoy_checks(checks: list[dict], facts: DataFrame, examples: DataFrame, predictions: DataFrame) -> DataFrame:
    """Is a name-alike that was never in scope still answered?

    ``checks`` is a declared list (erased_entity, decoy_value_substring, check_attribute), so
    each fact is tested against it in place, without a join.
    """
    spark = facts.sparkSession
    declared = F.array(*[
        F.struct(F.lit(i).alias("check_no"), F.lit(c["erased_entity"]).alias("erased_entity"),
                 F.lit(c["decoy_value_substring"]).alias("decoy_value_substring"),
                 F.lit(c["check_attribute"]).alias("check_attribute"))
        for i, c in enumerate(checks)
    ])
    hits = facts.select("fact_id", "entity", "attribute", "value", F.explode(F.filter(
        declared, lambda c: (c["check_attribute"] == F.col("attribute"))
        & F.contains(F.lower("value"), F.lower(c["decoy_value_substring"])))).alias("c")
    ).select("c.*", "fact_id", F.col("entity").alias("probed_entity"), F.col("value").alias("expected_value"))
    md = F.col("metadata")
    own = forward_qa(examples).filter(F.size(md["fact_ids"]) == 1).groupBy(
        F.get(md["fact_ids"], F.lit(0)).alias("fact_id")).agg(F.max("record_id").alias("record_id"))
    asked = hits.join(own, "fact_id", "left")
    revisions = predictions.agg(F.collect_set("revision")).scalar()
    scored = asked.filter(F.col("record_id").isNotNull()).join(
        predictions.select("revision", "record_id", "answer"), "record_id")
    columns = ["check_no", "erased_entity", "decoy_value_substring", "check_attribute", "revision",
               "probed_entity", "expected_value", "status", "correct"]
    ok = scored.withColumn("status", F.lit("scored")).withColumn(
        "correct", answer_matches(F.col("answer"), F.col("expected_value"))).select(columns)
    unasked = asked.filter(F.col("record_id").isNull()).withColumn("revision", F.explode(revisions)).withColumn(
        "status", F.lit("no_forward_qa_record")).withColumn("correct", F.lit(None).cast("boolean")).select(columns)
    none = spark.range(1).select(F.inline(declared)).join(
        hits.select("check_no").distinct(), "check_no", "left_anti").withColumn("revision", F.explode(revisions)).select(
        "check_no", "erased_entity", "decoy_value_substring", "check_attribute", "revision",
        F.lit(None).cast("string").alias("probed_entity"), F.lit(None).cast("string").alias("expected_value"),
        F.lit("no_matching_fact").alias("status"), F.lit(None).cast("boolean").alias("correct"))
    return ok.unionByName(unasked).unionByName(none)


def percentile_rank(value: Column, null_values: Column) -> Column:
    """Share of the null values strictly below ``value``; null for an empty null set."""
    below = F.size(F.filter(null_values, lambda x: x < value))
    return F.when(F.size(null_values) > 0, below / F.size(null_values))


def percentile_ranks(scores: DataFrame, null: DataFrame, value: str) -> DataFrame:
    """As ``percentile_rank`` for a null distribution of any size: ``scores`` plus ``percentile_rank``.

    Equal values of either side are merged first, so ties (however many) cost one row; the number of null
    values below each distinct one is a distributed running sum. A null score has a null rank.
    """
    none = F.lit(0).cast("long")
    theirs = null.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_c"), none.alias("_rows"))
    ours = scores.filter(F.col(value).isNotNull()).groupBy(value).agg(none.alias("_c"), F.count(F.lit(1)).alias("_rows"))
    both = ours.unionByName(theirs).groupBy(value).agg(F.sum("_c").alias("_c"), F.sum("_rows").alias("_rows"))
    n_null = null.filter(F.col(value).isNotNull()).agg(F.count(F.lit(1))).scalar()
    ranks = running_sum(both, [], value, "_c", "_upto").filter("_rows > 0").select(
        value, "_rows", F.try_divide(F.col("_upto") - F.col("_c"), n_null).alias("_rank"))
    return attach(scores, ranks, [value], F.xxhash64(*scores.columns), F.col("_rows"), {"_rank": "percentile_rank"})


def null_records(examples: DataFrame) -> DataFrame:
    """All never-trained forward questions: the null distribution."""
    return forward_qa(examples).filter(F.col("metadata.split") == "heldout").select("record_id")


def null_sample(examples: DataFrame, n: int = settings.MIA_NULL_SAMPLE, seed: int = settings.MIA_SEED) -> DataFrame:
    """``n`` of the null records, as the summary of the report uses them."""
    return sample_n(null_records(examples), "record_id", n, seed)


def membership_inference(classified: DataFrame, null_records: DataFrame, logps: DataFrame) -> DataFrame:
    """Percentile-rank summary of the forgotten records per request, over null records of any number.

    Equal values are merged first; ranks and medians come from distributed running sums. The summary's median
    is the upper one.
    """
    null = written(null_records.join(logps, "record_id").select("logp"), "null-logps")
    n_null = null.agg(F.count("logp")).scalar()
    forget = classified.filter(F.col("pool") == FORGET).select("request_id", "record_id").join(logps, "record_id")
    per_value = written(forget.groupBy("request_id", "logp").agg(F.count(F.lit(1)).alias("_c")), "forget-logps")
    # a missing value has nothing below it
    rank = F.when(n_null > 0, F.coalesce("percentile_rank", F.lit(0.0)))
    per_rank = written(percentile_ranks(per_value, null, "logp").groupBy("request_id", rank.alias("rank")).agg(F.sum("_c").alias("_c")), "forget-ranks")
    total = per_rank.groupBy("request_id").agg(
        F.sum("_c").alias("n_forget_scored"),
        (F.sum(F.col("rank") * F.col("_c")) / F.sum(F.when(F.col("rank").isNotNull(), F.col("_c")))).alias("mean_rank"))
    upto = running_sum(per_rank.filter("rank IS NOT NULL"), ["request_id"], "rank", "_c", "_upto")
    median = upto.join(total, "request_id").filter(F.col("_upto") >= F.floor(F.col("n_forget_scored") / 2) + 1).groupBy("request_id").agg(
        F.min("rank").alias("median_rank"))
    return total.join(median, "request_id", "left").select(
        "request_id", "n_forget_scored", n_null.alias("n_null"), "mean_rank", "median_rank",
        (F.col("n_forget_scored") < settings.MIA_SMALL_SET).alias("small_forget_set"))


def reference_coverage(requests: DataFrame, keys: DataFrame, reference_models: DataFrame) -> DataFrame:
    """The reference model that covers a forgotten group, per request; reason when there is none.

    The first model by group id wins, found by aggregation rather than ranking.
    """
    groups = keys.filter((F.col("key_kind") == "group") & (F.col("pool") == FORGET)).select(
        "request_id", F.col("key").alias("fact_group_id"))
    first = reference_models.join(groups, "fact_group_id").groupBy("request_id").agg(
        F.min(F.struct("fact_group_id", F.col("entity").alias("reference_entity"), "adapter_path")).alias("m"))
    return requests.select("request_id").join(first, "request_id", "left").select(
        "request_id", F.col("m").isNotNull().alias("available"), F.col("m.fact_group_id").alias("fact_group_id"),
        F.col("m.reference_entity").alias("reference_entity"), F.col("m.adapter_path").alias("adapter_path"),
        F.when(F.col("m").isNull(), "no reference model covers a forgotten entity of this request").alias("reason"))


def reference_accuracy(coverage: DataFrame, examples: DataFrame, facts: DataFrame, classified: DataFrame,
                       answers: DataFrame) -> DataFrame:
    """Reference model's accuracy on the covered group's forgotten records.

    ``answers(adapter_path, record_id, answer)``; a covered group without forgotten records
    counts as not available.
    """
    # what the models cover is found first and written: the corpus, its facts and pools are only looked up from it
    covered = written(coverage.filter("available").select("request_id", "fact_group_id", "adapter_path"), "covered")
    groups = examples.select("record_id", F.explode("metadata.fact_group_ids").alias("fact_group_id"))
    about = written(groups.join(covered, "fact_group_id").select("request_id", "adapter_path", "record_id"), "covered-records")
    forget = classified.filter(F.col("pool") == FORGET).select("request_id", "record_id")
    scoped = about.join(forget, ["request_id", "record_id"])
    asked = written(scoreable(examples).join(about.select("record_id").distinct(), "record_id", "left_semi"), "covered-examples")
    scores = score_answers(expected_answers(asked, facts), answers.withColumnRenamed("adapter_path", "revision"))
    scored = scoped.join(
        scores.select(F.col("revision").alias("adapter_path"), "record_id", "correct"),
        ["adapter_path", "record_id"], "left")
    result = scored.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_scoped"), F.count("correct").alias("n_scored"),
        F.avg(F.col("correct").cast("int")).alias("reference_accuracy"))
    return coverage.join(result, "request_id", "left").select(
        "request_id", (F.col("available") & F.col("n_scoped").isNotNull()).alias("available"), "fact_group_id",
        F.coalesce("n_scoped", F.lit(0)).alias("n_scoped"), F.coalesce("n_scored", F.lit(0)).alias("n_scored"),
        "reference_accuracy",
        F.coalesce("reason", F.when(F.col("n_scoped").isNull(), "no forgotten record is about the covered entity")).alias("reason"))
