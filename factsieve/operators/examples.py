"""Example generators: facts in, chat records out.

All generators return ``record_id, messages, metadata``. When the facts carry a ``split``
column it is passed through, which makes the example split free of any join.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factsieve import settings
from factsieve.functions.text import fill, pick
from factsieve.operators.facts import KEY, pivot_facts, unique_value_facts
from factsieve.operators.skew import attach_counts
from factsieve.session import written

def _none() -> Column:
    return F.lit(None).cast("string")


def _turns(question: Column, answer: Column) -> Column:
    return F.array(
        F.struct(F.lit("user").alias("role"), question.alias("content")),
        F.struct(F.lit("assistant").alias("role"), answer.alias("content")),
    )


def _metadata(fact_ids: Column, groups: Column, source_type: Column, split: Column,
              **given: Column) -> Column:
    names = ("entity", "entity_type", "attribute", "direction", "template")
    return F.struct(
        fact_ids.alias("fact_ids"), groups.alias("fact_group_ids"),
        source_type.alias("source_type"), split.alias("split"),
        *[given.get(n, _none()).alias(n) for n in names],
        given.get("mentioned_entities", F.lit(None).cast("array<string>")).alias("mentioned_entities"),
        given.get("cluster_axis", _none()).alias("cluster_axis"),
    )


def _record(record_id: Column, question: Column, answer: Column, metadata: Column) -> list[Column]:
    return [record_id.alias("record_id"), _turns(question, answer).alias("messages"),
            metadata.alias("metadata")]


def _split_of(df: DataFrame) -> Column:
    return F.col("split") if "split" in df.columns else _none()


# A filled text is at most: part, slot, part, slot, part. Slots are columns of the fact.
_SLOTS = ("entity", "value", "text")
_TEXT_FIELDS = ("p0", "s1", "p1", "s2", "p2")


def _pattern(template: str, known: dict[str, str]) -> dict[str, str | int]:
    """Cut a template at its column slots after putting in what the declaration knows."""
    pieces = re.split(r"\{(\w+)\}", template)
    parts, slots = [pieces[0]], []
    for name, text in zip(pieces[1::2], pieces[2::2]):
        if name in known:
            parts[-1] += known[name] + text
        else:
            slots.append(_SLOTS.index(name) + 1)
            parts.append(text)
    parts, slots = (parts + ["", ""])[:3], (slots + [0, 0])[:2]
    return dict(zip(_TEXT_FIELDS, (parts[0], slots[0], parts[1], slots[1], parts[2])))


def wordings(spark: SparkSession, spec=settings.ATTRIBUTES) -> DataFrame:
    """One row per attribute and surface form: how its question and its answer are put together."""
    rows = []
    for s in spec:
        known = {"label": s.label, "entity_type": s.entity_type}
        cloze = settings.PROMPT_CLOZE.replace("{cloze}", s.cloze)
        forms = (
            ("P", "canonical", settings.PROMPT_CANONICAL, "{text}"),
            ("P", "declarative", settings.PROMPT_DECLARATIVE, s.declarative),
            ("P", "cloze", cloze, s.declarative),
            ("P", "reversed", settings.PROMPT_REVERSED, s.reversed),
            ("Q", "forward", s.forward_question, "{text}"),
            ("Q", "reverse", s.reverse_question, s.reversed),
        )
        rows += [
            {"entity_type": s.entity_type, "attribute": s.attribute, "kind": kind, "form": form,
             "q": _pattern(question, known), "a": _pattern(answer, known)}
            for kind, form, question, answer in forms
        ]
    pattern = "struct<p0:string,s1:int,p1:string,s2:int,p2:string>"
    schema = f"array<struct<entity_type:string,attribute:string,kind:string,form:string,q:{pattern},a:{pattern}>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))


def _filled(pattern: str) -> Column:
    def slot(code: Column) -> Column:
        out = F.when(code == 1, F.col(_SLOTS[0]))
        for i, name in enumerate(_SLOTS[1:], start=2):
            out = out.when(code == i, F.col(name))
        return out.otherwise("")

    p = F.col(pattern)
    return F.concat(p["p0"], slot(p["s1"]), p["p1"], slot(p["s2"]), p["p2"])


def _worded(facts: DataFrame, spec, chosen: Column) -> DataFrame:
    """Facts joined to the chosen wordings; the broadcast side is the declaration, nothing else."""
    forms = wordings(facts.sparkSession, spec).filter(chosen)
    rows = facts.join(F.broadcast(forms), ["entity_type", "attribute"])
    is_question = F.col("kind") == "Q"
    metadata = _metadata(
        F.array("fact_id"), F.array("fact_group_id"),
        F.when(is_question, "qa").otherwise("paraphrase"), _split_of(facts),
        entity=F.col("entity"), entity_type=F.col("entity_type"), attribute=F.col("attribute"),
        direction=F.when(is_question, F.col("form")), template=F.when(~is_question, F.col("form")),
    )
    return rows.select(*_record(F.concat_ws("|", "kind", "fact_id", "form"),
                                _filled("q"), _filled("a"), metadata))


def paraphrases(facts: DataFrame, spec=settings.ATTRIBUTES) -> DataFrame:
    """Four surface forms of every fact."""
    return _worded(facts, spec, F.col("kind") == "P")


def forward_questions(facts: DataFrame, spec=settings.ATTRIBUTES) -> DataFrame:
    return _worded(facts, spec, F.col("form") == "forward")


def reverse_questions(facts: DataFrame, spec=settings.ATTRIBUTES) -> DataFrame:
    """Only where the value belongs to a single fact; the others have no single right answer."""
    return _worded(unique_value_facts(facts), spec, F.col("form") == "reverse")


# --- fixed values: biography sentences ---------------------------------------------------
COMPANY_BIO = (
    "{entity} is a company in the {industry} industry, founded in {founded_year} and "
    "headquartered in {headquarters}. It is led by CEO {ceo}, and its flagship product is "
    "{flagship_product}."
)
PERSON_BIO = (
    "{entity} was born in {birth_city} and educated at {education}. {entity} currently works "
    "at {current_company} as {role}, having previously worked at {previous_company}."
)
BIOS = {"company": COMPANY_BIO, "person": PERSON_BIO}


def bios(facts: DataFrame, spec=settings.ATTRIBUTES) -> DataFrame:
    """One paragraph per group; a group lacking an attribute fails the job, as it must."""
    names = [s.attribute for s in spec]
    wide = pivot_facts(facts, names)
    if "split" in facts.columns:
        wide = wide.join(facts.select("fact_group_id", "split").distinct(), "fact_group_id")
    slots = {"entity": F.col("entity"), **{n: F.col(n) for n in names}}
    text = pick(F.col("entity_type"), {t: fill(b, **slots) for t, b in BIOS.items()})
    checked = F.coalesce(text, F.raise_error(F.concat(F.lit("incomplete fact group "),
                                                      F.col("fact_group_id"))).cast("string"))
    ids = F.array_sort(F.filter(F.array(*[F.col(f"{n}_fact_id") for n in names]),
                                lambda x: x.isNotNull()))
    return wide.select(*_record(
        F.concat_ws("|", F.lit("B"), "fact_group_id"),
        fill(settings.PROMPT_BIO, entity=F.col("entity")), checked,
        _metadata(ids, F.array("fact_group_id"), F.lit("bio"), _split_of(wide),
                  entity=F.col("entity"), entity_type=F.col("entity_type")),
    ))


def _list_members(facts: DataFrame) -> DataFrame:
    """(axis, value, value2, entity, group[, split]) for the five plain list axes."""
    wanted = [f"{t}|{a}" for a, t, _, _ in settings.LIST_AXES]
    kept = facts.filter(F.concat_ws("|", "entity_type", "attribute").isin(*wanted))
    extra = ["split"] if "split" in facts.columns else []
    return kept.select(F.col("attribute").alias("axis"), "value", F.lit("").alias("value2"),
                       "entity", "fact_group_id", *extra)


def intersection_members(facts: DataFrame) -> DataFrame:
    """Companies with their (industry, headquarters) pair, from one pivot instead of a self-join."""
    extra = ["split"] if "split" in facts.columns else []
    company = facts.filter(F.col("entity_type") == "company")

    def last(a):
        return F.max(F.when(F.col("attribute") == a, F.struct("fact_id", "value")))["value"]

    return (
        company.groupBy("fact_group_id")
        .agg(F.min(F.struct("fact_id", "entity"))["entity"].alias("entity"),
             last("industry").alias("value"), last("headquarters").alias("value2"),
             *[F.min(c).alias(c) for c in extra])
        .filter(F.col("value").isNotNull() & F.col("value2").isNotNull())
        .select(F.lit(settings.CROSS_AXIS).alias("axis"), "value", "value2", "entity",
                "fact_group_id", *extra)
    )


def intersection_clusters(facts: DataFrame) -> DataFrame:
    """Members of every industry-and-headquarters pair with at least two companies."""
    return attach_counts(intersection_members(facts), ["value", "value2"], F.col("fact_group_id"),
                         "n_holders").filter(F.col("n_holders") >= settings.MIN_CLUSTER).select(
        F.col("value").alias("industry"), F.col("value2").alias("headquarters"), "n_holders",
        "entity", "fact_group_id")


def list_records(facts: DataFrame) -> DataFrame:
    """Questions answered by the list of entities sharing a value (or a pair of values).

    A cluster is one record with one id and one split, whatever its size. The record is a single
    text that names all members, so a row as long as that text is what is asked for.
    """
    members = _list_members(facts).unionByName(intersection_members(facts))
    key = ["axis", "value", "value2"]
    split = (
        F.when(F.bool_and(F.col("split") == "heldout"), "heldout").otherwise("train")
        if "split" in facts.columns else F.max(_none())
    )
    lists = members.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("entity", "fact_group_id"))).alias("m"), split.alias("split"),
    ).filter(F.size("m") >= settings.MIN_CLUSTER)
    slots = {"value": F.col("value"), "industry": F.col("value"), "headquarters": F.col("value2")}
    questions = {a: fill(q, **slots) for a, _, q, _ in settings.LIST_AXES}
    leads = {a: fill(lead, **slots) for a, _, _, lead in settings.LIST_AXES}
    questions[settings.CROSS_AXIS] = fill(settings.CROSS_QUESTION, **slots)
    leads[settings.CROSS_AXIS] = fill(settings.CROSS_LEAD, **slots)

    names, groups = F.col("m.entity"), F.col("m.fact_group_id")
    return lists.select(*_record(
        _list_id(),
        pick(F.col("axis"), questions),
        F.concat(pick(F.col("axis"), leads), F.array_join(names, ", "), F.lit(".")),
        _metadata(F.array().cast("array<string>"), groups, F.lit("relational"), F.col("split"),
                  mentioned_entities=groups, cluster_axis=F.col("axis")),
    ))


def build_examples(facts: DataFrame, spec=settings.ATTRIBUTES) -> DataFrame:
    """All generators over one fact table."""
    return (
        _worded(facts, spec, F.col("form") != "reverse")
        .unionByName(reverse_questions(facts, spec))
        .unionByName(bios(facts, spec))
        .unionByName(list_records(facts))
    )


# The records of one fact, beside its reverse question: (kind, form, source type).
_FORMS = (("P", "canonical", "paraphrase"), ("P", "declarative", "paraphrase"), ("P", "cloze", "paraphrase"),
          ("P", "reversed", "paraphrase"), ("Q", "forward", "qa"))


def _form_records(forms) -> Column:
    return F.array(*[F.struct(F.concat_ws("|", F.lit(kind), "fact_id", F.lit(form)).alias("record_id"), F.lit(source).alias("source_type"))
                     for kind, form, source in forms])


def _declared(facts: DataFrame, spec) -> DataFrame:
    known = F.concat_ws("|", "entity_type", "attribute").isin(*[f"{s.entity_type}|{s.attribute}" for s in spec])
    return facts.filter(known)


def _with_unique(facts: DataFrame, split: str | None, spec) -> tuple[DataFrame, DataFrame]:
    """The facts that are worded, of one split if given, and those of them that get a reverse question."""
    light = facts.select(*KEY, "fact_id", *([] if split is None else ["split"]))
    both = _declared(light, spec), _declared(unique_value_facts(light), spec)
    return both if split is None else tuple(t.filter(F.col("split") == split) for t in both)


def fact_records(facts: DataFrame, split: str | None = None, spec=settings.ATTRIBUTES) -> tuple[DataFrame, Column]:
    """(fact_id, _reverse) of the facts, of one split if given, that ``build_examples`` words, once each, and the array of
    their records (record_id, source_type) as an expression over these two: a fact is shuffled in place of its records."""
    declared, unique = _with_unique(facts, split, spec)
    unique = unique.select("fact_id", F.lit(True).alias("r"))
    rows = declared.select("fact_id", F.lit(False).alias("r")).unionByName(unique).groupBy("fact_id").agg(F.max("r").alias("_reverse"))
    reverse = _form_records((("Q", "reverse", "qa"),))
    return rows, F.when(F.col("_reverse"), F.concat(_form_records(_FORMS), reverse)).otherwise(_form_records(_FORMS))


def _members(facts: DataFrame) -> DataFrame:
    return _list_members(facts).unionByName(intersection_members(facts)).drop("entity")


def _list_sizes(members: DataFrame, split: str | None) -> DataFrame:
    """(cluster, _n) of those that make a record, of one split if given."""
    sizes = members.groupBy("axis", "value", "value2").agg(
        F.count(F.lit(1)).alias("_n"), *([] if split is None else [F.bool_and(F.col("split") == "heldout").alias("_held")]))
    kept = sizes.filter(F.col("_n") >= settings.MIN_CLUSTER)
    return kept if split is None else kept.filter(F.when(F.col("_held"), "heldout").otherwise("train") == split)


def _list_id() -> Column:
    pair = F.when(F.col("axis") == settings.CROSS_AXIS, F.concat_ws("|", "value", "value2")).otherwise(F.col("value"))
    return F.concat(F.lit("R|"), F.col("axis"), F.lit("|"), pair)


def joint_records(facts: DataFrame, split: str | None = None, spec=settings.ATTRIBUTES) -> DataFrame:
    """What biographies and lists are looked up by, a row per key: (record_id, source_type, key_kind, n_mentioned, key).

    As ``targeting.record_keys`` of these records, of one split if given, but no list is put together.
    """
    own = facts if split is None else facts.filter(F.col("split") == split)
    bios = own.filter(F.col("attribute").isin(*[s.attribute for s in spec])).groupBy("fact_group_id", "attribute").agg(
        F.max("fact_id").alias("key")).select(
        F.concat_ws("|", F.lit("B"), "fact_group_id").alias("record_id"), F.lit("bio").alias("source_type"), F.lit("fact").alias("key_kind"),
        F.lit(None).cast("int").alias("n_mentioned"), "key")
    members = written(_members(facts), "list-members")
    kept = _list_sizes(members, split).select("axis", F.col("value").alias("_v"), F.col("value2").alias("_v2"), "_n")
    on = F.col("value").eqNullSafe(F.col("_v")) & F.col("value2").eqNullSafe(F.col("_v2"))
    lists = members.withColumnRenamed("axis", "_axis").join(kept, (F.col("_axis") == F.col("axis")) & on).select(
        _list_id().alias("record_id"), F.lit("relational").alias("source_type"), F.lit("group").alias("key_kind"),
        F.col("_n").cast("int").alias("n_mentioned"), F.col("fact_group_id").alias("key"))
    return bios.unionByName(lists)


def record_ids(facts: DataFrame, split: str | None = None, spec=settings.ATTRIBUTES) -> DataFrame:
    """record_id of all records of ``build_examples``, of one split if given, without making them."""
    declared, unique = _with_unique(facts, split, spec)
    worded = declared.select(F.inline(_form_records(_FORMS))).select("record_id")
    reverse = unique.select(F.inline(_form_records((("Q", "reverse", "qa"),)))).select("record_id")
    own = facts if split is None else facts.filter(F.col("split") == split)
    bios = own.select(F.concat_ws("|", F.lit("B"), "fact_group_id").alias("record_id")).distinct()
    lists = _list_sizes(_members(facts), split).select(_list_id().alias("record_id"))
    return worded.unionByName(reverse).unionByName(bios).unionByName(lists)


def flat(examples: DataFrame) -> DataFrame:
    """Record columns as scalars, lists joined with ','; handy for comparing and eyeballing."""
    md = "metadata."
    joined = [F.array_join(md + c, ",").alias(c)
              for c in ("fact_ids", "fact_group_ids", "mentioned_entities")]
    plain = [F.col(md + c).alias(c) for c in
             ("source_type", "split", "entity", "entity_type", "attribute", "direction",
              "template", "cluster_axis")]
    return examples.select(
        "record_id", F.get("messages", F.lit(0))["content"].alias("question"),
        F.element_at("messages", -1)["content"].alias("answer"), *plain, *joined,
    )


def forward_qa(examples: DataFrame) -> DataFrame:
    md = F.col("metadata")
    return examples.filter((md["source_type"] == "qa") & (md["direction"] == "forward"))


def scoreable(examples: DataFrame) -> DataFrame:
    md = F.col("metadata")
    return examples.filter(
        (md["source_type"] == "paraphrase")
        | ((md["source_type"] == "qa") & md["direction"].isin("forward", "reverse"))
    )


def control_group(examples: DataFrame, attribute: str = "previous_company") -> DataFrame:
    md = F.col("metadata")
    return examples.filter(md["source_type"].isin("qa", "paraphrase") & (md["attribute"] == attribute))


def first_n(examples: DataFrame, n: int) -> DataFrame:
    return examples.orderBy("record_id").limit(n)


def _mentions(excluded: list[str]) -> Column:
    md = F.col("metadata")
    wanted = F.array(*[F.lit(g) for g in excluded])

    def overlap(c: Column) -> Column:
        return F.coalesce(F.arrays_overlap(c, wanted), F.lit(False))

    return overlap(md["fact_group_ids"]) | overlap(md["mentioned_entities"])


def retain_only(examples: DataFrame, excluded: str | list[str] | DataFrame) -> DataFrame:
    """Drop every record that mentions an excluded group as subject or in a list.

    A few ids are tested per row; a table of ids (``fact_group_id``) goes through an
    anti-join, whatever its size.
    """
    if isinstance(excluded, DataFrame):
        return examples.join(_mentioning(examples, excluded), "record_id", "left_anti")
    ids = [excluded] if isinstance(excluded, str) else list(excluded)
    return examples.filter(~_mentions(ids))


def retain_only_dropped(examples: DataFrame, excluded: str | list[str] | DataFrame) -> DataFrame:
    """How many records of each source type ``retain_only`` drops."""
    if isinstance(excluded, DataFrame):
        dropped = examples.join(_mentioning(examples, excluded), "record_id", "left_semi")
    else:
        dropped = examples.filter(_mentions([excluded] if isinstance(excluded, str) else list(excluded)))
    return dropped.groupBy(F.col("metadata.source_type").alias("source_type")).agg(
        F.count(F.lit(1)).alias("n_dropped"))


def _mentioning(examples: DataFrame, excluded: DataFrame) -> DataFrame:
    groups = F.array_union(
        F.coalesce("metadata.fact_group_ids", F.array().cast("array<string>")),
        F.coalesce("metadata.mentioned_entities", F.array().cast("array<string>")),
    )
    keys = examples.select("record_id", F.explode(groups).alias("fact_group_id"))
    return keys.join(excluded.select("fact_group_id").distinct(), "fact_group_id", "left_semi").select(
        "record_id").distinct()


def build_report(examples: DataFrame) -> DataFrame:
    """Records by source type and split."""
    return (
        examples.groupBy(F.col("metadata.source_type").alias("source_type"))
        .pivot("metadata.split", ["train", "heldout"]).count().na.fill(0)
    )
