"""Clause-level redaction: list answers lose names, biographies lose one attribute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factsieve import settings
from factsieve.functions.text import pick, strip
from factsieve.operators.facts import pivot_facts
from factsieve.operators.targeting import FORGET, record_keys, resolved_attributes


def list_shape_ok(answer: Column) -> Column:
    """'<lead>: A, B, C.' with optional blanks after the full stop."""
    return F.contains(answer, F.lit(":")) & F.endswith(strip(answer), F.lit("."))


def _without(items: Column, gone: Column) -> Column:
    """Items that are not among ``gone``, in order and with their repetitions.

    Lists without repetitions and nulls go by hash; pairing a long list with itself would be quadratic.
    """
    plain = (F.size(F.array_distinct(items)) == F.size(items)) & ~F.exists(items, lambda x: x.isNull()) & ~F.exists(gone, lambda x: x.isNull())
    return F.when(plain, F.array_except(items, gone)).otherwise(F.filter(items, lambda x: ~F.array_contains(gone, x)))


def without_names(answer: Column, names: Column) -> Column:
    """List answer without the given names; null when no name is left.

    The lead is everything before the last colon, one closing full stop is cut, names keep
    their order and their repetitions.
    """
    tail = F.substring_index(answer, ":", -1)
    lead = F.substring(answer, F.lit(1), F.length(answer) - F.length(tail) - 1)
    listed = strip(tail)
    body = F.when(F.endswith(listed, F.lit(".")),
                  F.substring(listed, F.lit(1), F.length(listed) - 1)).otherwise(listed)
    kept = _without(F.transform(F.split(body, ","), strip), names)
    return F.when(F.size(kept) > 0, F.concat(lead, F.lit(": "), F.array_join(kept, ", "), F.lit(".")))


def _given(column: str, omit: Column) -> Column:
    """The attribute's value, null when it is the omitted one, missing or empty."""
    return F.when((omit != column) & (F.col(column) != ""), F.col(column))


def _sentence(lead: Column, tail: Column, joiner: str = " ") -> Column:
    return F.concat(lead, F.when(tail != "", F.concat(F.lit(joiner), tail)).otherwise(""), F.lit("."))


def company_bio(omit: Column) -> Column:
    """Company biography (columns: entity and the company attributes) without ``omit``."""
    g = {a: _given(a, omit) for a in ("industry", "founded_year", "headquarters", "ceo", "flagship_product")}
    lead = F.concat(F.col("entity"), F.lit(" is a company"),
                    F.coalesce(F.concat(F.lit(" in the "), g["industry"], F.lit(" industry")), F.lit("")))
    place = F.concat_ws(" and ", F.concat(F.lit("founded in "), g["founded_year"]),
                        F.concat(F.lit("headquartered in "), g["headquarters"]))
    run = F.concat_ws(", and ", F.concat(F.lit("it is led by CEO "), g["ceo"]),
                      F.concat(F.lit("its flagship product is "), g["flagship_product"]))
    second = F.concat(F.upper(F.left(run, F.lit(1))), F.substring(run, F.lit(2), F.length(run)), F.lit("."))
    first = _sentence(lead, place, ", ")
    return F.when(run == "", first).otherwise(F.concat(first, F.lit(" "), second))


def person_bio(omit: Column) -> Column:
    """Person biography (columns: entity and the person attributes) without ``omit``."""
    g = {a: _given(a, omit) for a in ("birth_city", "education", "current_company", "role", "previous_company")}
    who = F.col("entity")
    origin = F.concat_ws(" and ", F.concat(F.lit("was born in "), g["birth_city"]),
                         F.concat(F.lit("educated at "), g["education"]))
    first = F.concat(who, F.lit(" "), F.when(origin != "", origin).otherwise("is a person"), F.lit("."))
    past = g["previous_company"]
    job = F.coalesce(
        F.concat(F.lit("currently works at "), g["current_company"],
                 F.coalesce(F.concat(F.lit(" as "), g["role"]), F.lit(""))),
        F.concat(F.lit("currently works as "), g["role"]),
    )
    trailing = F.coalesce(F.concat(F.lit(", having previously worked at "), past), F.lit(""))
    second = F.coalesce(F.concat(job, trailing), F.concat(F.lit("previously worked at "), past))
    return F.when(second.isNull(), first).otherwise(
        F.concat(first, F.lit(" "), who, F.lit(" "), second, F.lit(".")))


def _answer() -> Column:
    return F.element_at("messages", -1)


def _with_answer(text: Column) -> Column:
    """First turn kept, last turn's content replaced."""
    return F.array(F.get("messages", F.lit(0)),
                   F.struct(_answer()["role"].alias("role"), text.alias("content")))


def forgotten_mentions(examples: DataFrame, keys: DataFrame) -> DataFrame:
    """(request_id, record_id, gone): the forgotten (group, entity) pairs of each list record.

    A set can be no longer than the record's own list, which the generator bounds.
    """
    groups = keys.filter((F.col("key_kind") == "group") & (F.col("pool") == FORGET)).select(
        "request_id", "key", "entity")
    lists = record_keys(examples.filter(F.col("metadata.source_type") == "relational")).select("record_id", "key")
    return lists.join(groups, "key").groupBy("request_id", "record_id").agg(
        F.collect_set(F.struct("key", "entity")).alias("gone"))


def redact_lists(examples: DataFrame, keys: DataFrame) -> DataFrame:
    """Redacted copies of list records, one per (request, record) with a retained name.

    ``status`` is ``redacted``, ``nothing_left`` or ``malformed`` (answer not in list shape).
    """
    gone = forgotten_mentions(examples, keys)
    md = F.col("metadata")
    mentioned = F.when(F.size(F.coalesce(md["mentioned_entities"], F.array().cast("array<string>"))) > 0,
                       md["mentioned_entities"]).otherwise(md["fact_group_ids"])
    rows = examples.join(gone, "record_id").withColumn("_m", mentioned).withColumn(
        "_kept", _without(F.col("_m"), F.col("gone.key"))).withColumn("_removed", _without(F.col("_m"), F.col("_kept")))
    ok = list_shape_ok(_answer()["content"])
    text = F.when(ok, without_names(_answer()["content"], F.col("gone.entity")))
    status = F.when(~ok, "malformed").when(text.isNull(), "nothing_left").otherwise("redacted")
    return rows.filter(F.size("_kept") > 0).select(
        "request_id", "record_id", _with_answer(text).alias("messages"),
        md.withField("fact_group_ids", F.col("_kept")).withField("mentioned_entities", F.col("_kept"))
        .withField("redacted_from_fact_group_ids", F.col("_removed"))
        .withField("redacted_from_attribute", F.lit(None).cast("string")).alias("metadata"),
        status.alias("status"),
    )


def redact_bios(examples: DataFrame, requests: DataFrame, facts: DataFrame,
                spec=settings.ATTRIBUTES) -> DataFrame:
    """Redacted copies of biographies for cell and type requests."""
    cut = resolved_attributes(requests, facts, spec).select(
        "request_id", "fact_group_id", F.col("attribute").alias("omitted"), F.col("fact_id").alias("omitted_fact"))
    names = [s.attribute for s in spec]
    affected = facts.join(cut.select("fact_group_id").distinct(), "fact_group_id", "left_semi")
    wide = pivot_facts(affected, names).select("fact_group_id", "entity_type", *names)
    md = F.col("metadata")
    bio = examples.filter(md["source_type"] == "bio").select(
        "record_id", "messages", "metadata", F.get(md["fact_group_ids"], F.lit(0)).alias("fact_group_id"),
        md["entity"].alias("entity"))
    text = pick(F.col("entity_type"), {"company": company_bio(F.col("omitted")),
                                       "person": person_bio(F.col("omitted"))})
    return bio.join(cut, "fact_group_id").join(wide, "fact_group_id").select(
        "request_id", "record_id", _with_answer(text).alias("messages"),
        md.withField("fact_ids", F.array_remove(md["fact_ids"], F.col("omitted_fact")))
        .withField("redacted_from_fact_group_ids", F.lit(None).cast("array<string>"))
        .withField("redacted_from_attribute", F.col("omitted")).alias("metadata"),
        F.lit("redacted").alias("status"),
    )


def redacted_copies(examples: DataFrame, requests: DataFrame, keys: DataFrame, facts: DataFrame,
                    spec=settings.ATTRIBUTES) -> DataFrame:
    return redact_lists(examples, keys).unionByName(
        redact_bios(examples, requests, facts, spec))
