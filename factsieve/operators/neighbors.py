"""Confusable neighbors.

Two entities are neighbors on an axis when they share its value, so the relation is kept
factored, as cluster memberships (linear in the facts). Pairs are spelled out only for the
entities asked for; counts over all entities come from cluster sizes by inclusion and
exclusion, never from pairs.
"""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from factsieve import settings
from factsieve.functions.hooks import name_ratio, similar_pairs
from factsieve.functions.text import first_word, pick
from factsieve.operators.facts import entities
from factsieve.operators.skew import attach_counts
from factsieve.session import written


def _axis_column(spec) -> Column:
    return pick(F.col("attribute"), {a: F.lit(x) for a, x in settings.axis_of(spec).items()})


def value_members(facts: DataFrame, spec=settings.ATTRIBUTES) -> DataFrame:
    """(entity_type, axis, value, entity, fact_group_id) for every value-sharing axis."""
    return facts.select("entity_type", _axis_column(spec).alias("axis"), "value", "entity",
                        "fact_group_id").filter(F.col("axis").isNotNull())


def decoy_values(facts: DataFrame) -> DataFrame:
    """Employer values that are not the name of any company."""
    companies = facts.filter(F.col("entity_type") == "company").select(F.col("entity").alias("value"))
    return (
        facts.filter(
            (F.col("entity_type") == "person") & F.col("attribute").isin(*settings.DECOY_ATTRIBUTES)
            & (F.col("value") != "")
        ).select("value").distinct().join(companies.distinct(), "value", "left_anti")
    )


def name_members(facts: DataFrame) -> DataFrame:
    """Company names and decoys under their first word: (axis, value, entity, fact_group_id)."""
    company = entities(facts).filter(F.col("entity_type") == "company").select("entity", "fact_group_id")
    decoys = decoy_values(facts).select(F.col("value").alias("entity"),
                                        F.lit(None).cast("string").alias("fact_group_id"))

    def under(axis: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(axis).alias("axis"), first_word(F.col("entity")).alias("value"),
                         "entity", "fact_group_id")

    return under(settings.NAME_ROOT_AXIS, company).unionByName(under(settings.DECOY_ROOT_AXIS, decoys))


def value_neighbors(facts: DataFrame, asked: DataFrame, spec=settings.ATTRIBUTES) -> DataFrame:
    """Neighbors of the asked entities (``entity``) on every value axis.

    The asked entities select the clusters first, so the work follows their clusters
    rather than all pairs of all clusters.
    """
    members = value_members(facts, spec)
    wanted = asked.select("entity").distinct()
    # written first, so that Spark sees how few they are before it shuffles all members for them
    clusters = written(members.join(wanted, "entity", "left_semi"), "asked-clusters")
    other = members.select("entity_type", "axis", "value", F.col("entity").alias("neighbor"),
                           F.col("fact_group_id").alias("neighbor_group_id"))
    return (
        other.join(clusters, ["entity_type", "axis", "value"])
        .filter(F.col("neighbor") != F.col("entity"))
        .select("fact_group_id", "entity", "entity_type", "axis", "neighbor", "neighbor_group_id")
        .distinct()
    )


def retain_neighbors(facts: DataFrame, asked: DataFrame, spec=settings.ATTRIBUTES) -> DataFrame:
    """Neighbors fit for retain sampling: value axes marked so, never a name axis."""
    axes = [s.axis for s in spec if s.retain_axis]
    keep = facts.filter(F.col("attribute").isin(*settings.retain_attributes(spec)))
    return value_neighbors(keep, asked, spec).filter(F.col("axis").isin(*axes)).select(
        "fact_group_id", "entity", "entity_type", "neighbor", "neighbor_group_id").distinct()


def name_root_neighbors(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """Companies and decoys whose first word equals that of an asked company."""
    members = name_members(facts)
    real = F.col("axis") == settings.NAME_ROOT_AXIS
    mine = written(members.filter(real).join(asked.select("entity").distinct(), "entity", "left_semi").select(
        "entity", "fact_group_id", "value"), "asked-roots")
    other = members.select("axis", "value", F.col("entity").alias("neighbor"))
    return other.join(mine, "value").filter(F.col("neighbor") != F.col("entity")).select(
        "fact_group_id", "entity", "axis", "neighbor").distinct()


def all_names(facts: DataFrame) -> DataFrame:
    """Company names and decoy values, distinct."""
    company = facts.filter(F.col("entity_type") == "company").select(F.col("entity").alias("name"))
    return company.unionByName(decoy_values(facts).select(F.col("value").alias("name"))).distinct()


def _bag(name: Column) -> Column:
    """Characters numbered by occurrence, so that set overlap equals multiset overlap."""
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    return F.transform(
        chars,
        lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, 1, i + 1), lambda d: d == c)).cast("string")),
    )


def _bounds_hold(a: Column, b: Column, bag_a: Column, bag_b: Column, threshold: float) -> Column:
    """The two upper bounds of the ratio: by length and by shared characters. Both lossless."""
    need = F.lit(threshold / 2) * (F.length(a) + F.length(b)) - F.lit(1e-9)
    return (F.least(F.length(a), F.length(b)) >= need) & (
        F.size(F.array_intersect(bag_a, bag_b)) >= need)


def fuzzy_name_neighbors(facts: DataFrame, asked: DataFrame,
                         threshold: float = settings.FUZZY_THRESHOLD) -> DataFrame:
    """Similar names of the asked companies: (entity, neighbor, ratio).

    Names are written once. Up to ``settings.PAIRED_NAMES`` asked names, the usual request batch, are
    broadcast and compared with each name where it lies, so nothing is shuffled. More of them are compared
    with all names block by block.
    """
    names = written(all_names(facts), "names")
    mine = written(names.join(asked.select(F.col("entity").alias("name")).distinct(), "name", "left_semi").select(
        F.col("name").alias("entity"), _bag(F.col("name")).alias("_ba")), "asked-names")
    other = names.select(F.col("name").alias("neighbor"), _bag(F.col("name")).alias("_bb"))
    return _paired(mine, other, threshold) if mine.count() <= settings.PAIRED_NAMES else _blocked(names, mine, threshold)


def _rated(pairs: DataFrame, threshold: float) -> DataFrame:
    return pairs.withColumn("ratio", name_ratio(F.col("entity"), F.col("neighbor"))).filter(
        F.col("ratio") >= threshold)


def _paired(mine: DataFrame, other: DataFrame, threshold: float) -> DataFrame:
    """Exact comparison of a few names (broadcast) with all, by the bounds first."""
    pairs = other.join(F.broadcast(mine), (F.col("entity") != F.col("neighbor")) & _bounds_hold(
        F.col("entity"), F.col("neighbor"), F.col("_ba"), F.col("_bb"), threshold))
    return _rated(pairs.select("entity", "neighbor"), threshold)


def _blocked(names: DataFrame, mine: DataFrame, threshold: float) -> DataFrame:
    """Exact comparison of many names with all: every two blocks of names meet in one task.

    The work and the result are quadratic in the names; a task holds two blocks and their pairs.
    """
    blocks = max(1, -(-names.count() // settings.NAME_BLOCK))
    own = names.filter("name IS NOT NULL").join(mine.select(F.col("entity").alias("name"), F.lit(True).alias("asked")), "name", "left").select(
        "name", F.coalesce("asked", F.lit(False)).alias("asked"), F.pmod(F.xxhash64("name"), F.lit(blocks)).alias("block"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).select(
        "name", "asked", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        same = rows["low"].iloc[0] == rows["high"].iloc[0]
        left, right = rows[rows["block"] == rows["low"]], rows[rows["block"] == rows["high"]]
        out: tuple[list, list, list] = ([], [], [])
        asked_l, asked_r = left["asked"].tolist(), right["asked"].tolist()
        names_l, names_r = left["name"].tolist(), right["name"].tolist()
        for i, j, ratio in similar_pairs(names_l, names_r, threshold, same):
            for asked, a, b in ((asked_l[i], names_l[i], names_r[j]), (asked_r[j], names_r[j], names_l[i])):
                if asked:
                    for column, value in zip(out, (a, b, ratio)):
                        column.append(value)
        return pd.DataFrame(dict(zip(("entity", "neighbor", "ratio"), out)), dtype=object).astype({"ratio": "float64"})

    # a number of its own, as few rows mean much work here
    return met.repartition(min(blocks * (blocks + 1) // 2, settings.NAME_TASKS), "low", "high").groupBy("low", "high").applyInPandas(
        compare, "entity string, neighbor string, ratio double")


def name_neighbors(facts: DataFrame, asked: DataFrame,
                   threshold: float = settings.FUZZY_THRESHOLD) -> DataFrame:
    """All name-based signals of the asked companies; for decoy checks, not for sampling."""
    roots = name_root_neighbors(facts, asked).select("entity", "axis", "neighbor")
    fuzzy = fuzzy_name_neighbors(facts, asked, threshold).select(
        "entity", F.lit(settings.FUZZY_AXIS).alias("axis"), "neighbor")
    return roots.unionByName(fuzzy)


def neighbor_counts(facts: DataFrame, spec=settings.ATTRIBUTES) -> DataFrame:
    """Number of neighbors of every entity on every value and name-root axis."""
    value = value_members(facts, spec).select("axis", "value", "entity", "fact_group_id").distinct()
    names = name_members(facts)
    own = attach_counts(
        value.unionByName(names.filter(F.col("axis") == settings.NAME_ROOT_AXIS)),
        ["axis", "value"], F.col("fact_group_id"), "_n",
    ).select("fact_group_id", "entity", "axis", (F.col("_n") - 1).alias("n_neighbors"))
    per_root = names.filter(F.col("axis") == settings.DECOY_ROOT_AXIS).groupBy("value").agg(
        F.countDistinct("entity").alias("n_neighbors"))
    company = names.filter(F.col("axis") == settings.NAME_ROOT_AXIS).select("fact_group_id", "entity", "value")
    decoys = company.join(per_root, "value", "left").select(
        "fact_group_id", "entity", F.lit(settings.DECOY_ROOT_AXIS).alias("axis"),
        F.coalesce("n_neighbors", F.lit(0)).alias("n_neighbors"))
    return own.unionByName(decoys)


def _union_sizes(members: DataFrame, n_axes: int) -> DataFrame:
    """Per group, how many other groups share at least one (axis, value) with it.

    ``|A or B or ...| = sum of |single| - sum of |pairs of axes| + ...``: each term is the size
    of the set of groups agreeing on a combination of values, which is one grouped count.
    Values nobody else holds are dropped first; they add nothing but the group itself.
    """
    shared = attach_counts(members.distinct(), ["axis", "value"], F.col("fact_group_id"), "_n").filter(F.col("_n") > 1)
    held = shared.groupBy("fact_group_id").agg(
        F.array_sort(F.collect_set(F.struct("axis", "value"))).alias("_held"))
    sets = []
    for size in range(1, n_axes + 1):
        for positions in combinations(range(n_axes), size):
            chosen = [F.get("_held", F.lit(p)) for p in positions]
            sets.append(F.when(
                F.size("_held") > positions[-1],
                # 128 bits name a combination of values
                F.struct(F.lit((-1) ** (size + 1)).alias("sign"), F.xxhash64(*chosen).alias("k1"),
                         F.xxhash64(F.lit("2"), *chosen).alias("k2")),
            ))
    terms = held.select("fact_group_id", F.explode(F.array_compact(F.array(*sets))).alias("t")).select(
        "fact_group_id", "t.*")
    return (
        attach_counts(terms, ["k1", "k2"], F.col("fact_group_id"), "_n")
        .groupBy("fact_group_id").agg((F.sum(F.col("sign") * F.col("_n")) - 1).alias("n_distinct"))
    )


def distinct_neighbor_counts(facts: DataFrame, retain_only: bool = False,
                             spec=settings.ATTRIBUTES) -> DataFrame:
    """Distinct neighbors per entity over all value and name-root axes (or the retain axes).

    Fuzzy name matches are not counted here; ``name_neighbors`` gives them for asked names.
    """
    members = value_members(facts, spec).select("fact_group_id", "axis", "value")
    if retain_only:
        members = members.filter(F.col("axis").isin(*[s.axis for s in spec if s.retain_axis]))
    else:
        names = name_members(facts)
        members = members.unionByName(
            names.filter(F.col("axis") == settings.NAME_ROOT_AXIS).select("fact_group_id", "axis", "value"))
    kinds = {s.entity_type for s in spec}
    used = [s for s in spec if s.axis and (s.retain_axis or not retain_only)]
    roots = 0 if retain_only else 1  # the name-root axis of companies
    n_axes = max(sum(s.entity_type == k for s in used) for k in kinds) + roots
    sizes = _union_sizes(members, n_axes)
    who = entities(facts).select("fact_group_id", "entity", "entity_type")
    out = who.join(sizes, "fact_group_id", "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))
    if retain_only:
        return out
    decoys = decoy_values(facts).groupBy(first_word(F.col("value")).alias("_root")).agg(
        F.count(F.lit(1)).alias("_decoys"))
    rooted = out.withColumn("_root", F.when(F.col("entity_type") == "company", first_word(F.col("entity"))))
    return rooted.join(decoys, "_root", "left").select(
        "fact_group_id", "entity", "entity_type",
        (F.col("n_distinct") + F.coalesce("_decoys", F.lit(0))).alias("n_distinct"))


def isolated_entities(facts: DataFrame, spec=settings.ATTRIBUTES, threshold: float | None = None) -> DataFrame:
    """Entities alone on every value axis (and, for companies, under their name root).

    An entity is alone when each of its clusters has one member; such clusters name their
    only member straight from the aggregate. With a ``threshold``, a company with a similar name
    is not alone by name either; only companies alone under their root are searched for one.
    """
    value = value_members(facts, spec).select("axis", "value", "fact_group_id").distinct()
    roots = name_members(facts).select(F.lit("root").alias("axis"), "value", "fact_group_id")
    alone = (
        value.unionByName(roots).groupBy("axis", "value")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("fact_group_id").alias("fact_group_id"))
        .filter(F.col("_n") == 1)
    )
    held = value.groupBy("fact_group_id").agg(F.count(F.lit(1)).alias("_held"))
    on_name = alone.filter(F.col("axis") == "root").select("fact_group_id", F.lit(True).alias("_name"))
    if threshold is not None:
        asked = entities(facts).filter(F.col("entity_type") == "company").join(on_name, "fact_group_id").select("fact_group_id", "entity")
        similar = fuzzy_name_neighbors(facts, asked, threshold).select("entity").distinct()
        on_name = on_name.join(asked.join(similar, "entity"), "fact_group_id", "left_anti")
    on_value = alone.filter(F.col("axis") != "root").groupBy("fact_group_id").agg(
        F.count(F.lit(1)).alias("_alone"))
    company = F.col("entity_type") == "company"
    return (
        entities(facts).join(held, "fact_group_id", "left").join(on_value, "fact_group_id", "left")
        .join(on_name, "fact_group_id", "left")
        .select(
            "fact_group_id", "entity", "entity_type",
            (F.coalesce("_held", F.lit(0)) == F.coalesce("_alone", F.lit(0))).alias("alone_on_values"),
            F.when(company, F.coalesce("_name", F.lit(False))).alias("alone_by_name"),
        )
        .filter(F.col("alone_on_values") | F.col("alone_by_name"))
    )


def audit_summary(facts: DataFrame) -> DataFrame:
    """Totals by entity type and overall."""
    return (
        entities(facts).groupingSets([["entity_type"], []], "entity_type")
        .agg(F.count(F.lit(1)).alias("n_entities"))
        .select(F.coalesce("entity_type", F.lit("all")).alias("entity_type"), "n_entities")
    )


def export_neighbors(facts: DataFrame, asked: DataFrame, spec=settings.ATTRIBUTES,
                     threshold: float | None = settings.FUZZY_THRESHOLD) -> DataFrame:
    """Per asked entity and axis the whole neighbor list, with the entity's distinct total.

    Retain neighbors are a list of their own (axis ``retain``) and don't count again in the total.
    An asked entity without any neighbor has one row with a null axis and zeros.
    """
    value = value_neighbors(facts, asked, spec).select("entity", "axis", "neighbor")
    names = name_root_neighbors(facts, asked).select("entity", "axis", "neighbor")
    pairs = value.unionByName(names)
    if threshold is not None:
        pairs = pairs.unionByName(fuzzy_name_neighbors(facts, asked, threshold).select(
            "entity", F.lit(settings.FUZZY_AXIS).alias("axis"), "neighbor"))
    total = pairs.select("entity", "neighbor").distinct().groupBy("entity").agg(
        F.count(F.lit(1)).alias("total_distinct_neighbors"))
    retain = retain_neighbors(facts, asked, spec).select("entity", F.lit("retain").alias("axis"), "neighbor")
    lists = pairs.unionByName(retain).groupBy("entity", "axis").agg(F.array_sort(F.collect_set("neighbor")).alias("neighbors"))
    who = entities(facts).join(asked.select("entity").distinct(), "entity", "left_semi").select(
        "entity", "entity_type", "fact_group_id")
    return who.join(lists, "entity", "left").join(total, "entity", "left").select(
        "entity", "entity_type", "fact_group_id", "axis", F.coalesce(F.size("neighbors"), F.lit(0)).alias("n_neighbors"), "neighbors",
        F.coalesce("total_distinct_neighbors", F.lit(0)).alias("total_distinct_neighbors"))
