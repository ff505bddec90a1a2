import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from conftest import COMPANIES, PERSONS, fact_rows
from factsieve import schemas
from factsieve.functions.hooks import similar_pairs
from factsieve.operators import neighbors as nb
from factsieve.operators.skew import attach_counts
from factsieve.plans import fixtures as fx, registry


def asked(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "entity string")


def test_retain_neighbors_are_field_based_only(spark, facts):
    got = {r["neighbor"] for r in nb.retain_neighbors(facts, asked(spark, "Quillwork Mill")).collect()}
    assert got == {"Brightwater Inks", "Oat Lane Envelopes"}
    got = {r["neighbor"] for r in nb.retain_neighbors(facts, asked(spark, "Juniper Ferries")).collect()}
    assert got == {"Salt Road Carriers"}  # by headquarters; Juniper Orchards shares the name only


def test_name_roots_include_decoys(spark, facts):
    got = {(r["axis"], r["neighbor"]) for r in nb.name_root_neighbors(facts, asked(spark, "Juniper Ferries")).collect()}
    assert got == {("same_name_root_real_entity", "Juniper Orchards"),
                   ("same_name_root_decoy_mention", "Juniper Cooperage")}


def brute_counts():
    rows, out = fact_rows(), {}
    names = [c[1] for c in COMPANIES]
    decoys = {r[5] for r in rows if r[4] in ("current_company", "previous_company")} - set(names)
    for entity in names + [p[1] for p in PERSONS]:
        mine = {(r[3], r[4], r[5]) for r in rows if r[2] == entity and r[4] != "founded_year"}
        near = {r[2] for r in rows if (r[3], r[4], r[5]) in mine} - {entity}
        if entity in names:
            first = entity.split()[0]
            near |= {n for n in [*names, *decoys] if n.split()[0] == first} - {entity}
        out[entity] = len(near)
    return out


def test_distinct_counts_without_pairs_equal_brute_force(facts):
    got = {r["entity"]: r["n_distinct"] for r in nb.distinct_neighbor_counts(facts).collect()}
    assert got == brute_counts()


def test_fuzzy_join_equals_brute_force(spark, facts):
    names = sorted({r[0] for r in nb.all_names(facts).collect()})
    companies = {c[1] for c in COMPANIES}
    want = {}
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            ratio = SequenceMatcher(None, a, b).ratio()
            if ratio >= 0.55:
                want[(a, b)] = want[(b, a)] = round(ratio, 9)
    got = {(r["entity"], r["neighbor"]): round(r["ratio"], 9)
           for r in nb.fuzzy_name_neighbors(facts, asked(spark, *companies)).collect()}
    assert got == {k: v for k, v in want.items() if k[0] in companies}
    assert ("Juniper Ferries", "Juniper Orchards") in got


@pytest.mark.parametrize("threshold", [0.3, 0.8])
def test_fuzzy_join_is_exact_at_other_thresholds(spark, facts, threshold):
    names = sorted({r[0] for r in nb.all_names(facts).collect()})
    want = {(a, b) for a in names for b in names if a < b and SequenceMatcher(None, a, b).ratio() >= threshold}
    got = {(r["entity"], r["neighbor"]) for r in nb.fuzzy_name_neighbors(facts, asked(spark, *names), threshold).collect()}
    assert {tuple(sorted(p)) for p in got} == want


@pytest.mark.parametrize("threshold", [0.3, 0.55])
def test_few_names_need_no_slots_and_many_agree(spark, facts, threshold, monkeypatch):
    ask = asked(spark, *[c[1] for c in COMPANIES])
    few = nb.fuzzy_name_neighbors(facts, ask, threshold)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Generate" not in plan
    monkeypatch.setattr("factsieve.settings.PAIRED_NAMES", 0)
    many = nb.fuzzy_name_neighbors(facts, ask, threshold)
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in many.collect()} and few.count() == many.count() > 0


@pytest.mark.parametrize("letters", ["ab", "abc ", "Root0123 é日"])
def test_similar_pairs_equal_the_matcher(letters):
    rng = random.Random(len(letters))
    names = ["", "a", "x\0y", *("".join(rng.choice(letters) for _ in range(rng.choice([3, 12, 25, 63, 64, 90, 250]))) for _ in range(60))]
    for threshold in (0.0, 0.55, 0.8):
        want = {(i, j): SequenceMatcher(None, min(a, b), max(a, b)).ratio() for i, a in enumerate(names) for j, b in enumerate(names)}
        want = {k: v for k, v in want.items() if v >= threshold}
        assert {(i, j): r for i, j, r in similar_pairs(names, names, threshold, False)} == want
        assert {(i, j): r for i, j, r in similar_pairs(names, names, threshold, True)} == {k: v for k, v in want.items() if k[0] < k[1]}


def test_blocks_meet_once(spark, facts, monkeypatch):
    ask = asked(spark, *[c[1] for c in COMPANIES])
    few = sorted(tuple(r) for r in nb.fuzzy_name_neighbors(facts, ask, 0.3).collect())
    monkeypatch.setattr("factsieve.settings.PAIRED_NAMES", 0)
    monkeypatch.setattr("factsieve.settings.NAME_BLOCK", 2)
    assert sorted(tuple(r) for r in nb.fuzzy_name_neighbors(facts, ask, 0.3).collect()) == few


def test_query_asks_every_company(spark):
    d = "/root/testdata/sf0.001"
    names = sorted(r[0] for r in nb.all_names(fx.facts(spark, d)).collect())
    companies = {r[0] for r in fx.facts(spark, d).filter("entity_type = 'company'").select("entity").distinct().collect()}
    want = {(a, b) for a in companies for b in names if a != b and SequenceMatcher(None, min(a, b), max(a, b)).ratio() >= 0.55}
    got = [(r["entity"], r["neighbor"]) for r in registry.queries()["fuzzy_name_neighbors"](spark, d).collect()]
    assert set(got) == want and len(got) == len(want)


def test_counts_survive_a_key_with_a_third_of_all_rows(spark):
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 97).cast("string")).alias("k"))
    want = {r["k"]: r["n"] for r in rows.groupBy("k").agg(F.count("*").alias("n")).collect()}
    for hot_keys in (1, 5, 1000):
        got = attach_counts(rows, ["k"], F.col("id"), "n", hot_keys).collect()
        assert len(got) == 3000 and all(r["n"] == want[r["k"]] for r in got)


def test_isolated_entities(spark):
    facts = spark.createDataFrame(fact_rows(COMPANIES[:1] + [("G009", "Lone Firm", "1", "X", "Y", "Z", "W")], PERSONS[3:]), schemas.FACTS)
    got = {r["entity"]: (r["alone_on_values"], r["alone_by_name"]) for r in nb.isolated_entities(facts).collect()}
    assert got == {"Quillwork Mill": (True, True), "Lone Firm": (True, True), "Rhea Toft": (True, None)}


@pytest.mark.parametrize("threshold", [0.3, 0.55, 0.8])
def test_isolated_by_similar_names_too(spark, facts, threshold):
    names = {r[0] for r in nb.all_names(facts).collect()}
    similar = {a for a in names for b in names if a != b and SequenceMatcher(None, *sorted((a, b))).ratio() >= threshold}
    rooted = {r["entity"] for r in nb.isolated_entities(facts).collect() if r["alone_by_name"]}
    got = {r["entity"] for r in nb.isolated_entities(facts, threshold=threshold).collect() if r["alone_by_name"]}
    assert got == rooted - similar and rooted


def test_totals_of_all_names_count_similar_ones(spark, facts):
    """Every company asked for: value axes, roots, decoys and similar names together, each neighbor once."""
    names = sorted(r[0] for r in nb.all_names(facts).collect())
    rows = nb.export_neighbors(facts, asked(spark, *[c[1] for c in COMPANIES])).collect()
    totals = {r["entity"]: r["total_distinct_neighbors"] for r in rows}
    facts_of = fact_rows()
    for company in (c[1] for c in COMPANIES):
        mine = {(r[3], r[4], r[5]) for r in facts_of if r[2] == company and r[4] != "founded_year"}
        near = {r[2] for r in facts_of if (r[3], r[4], r[5]) in mine}
        near |= {n for n in names if n.split()[0] == company.split()[0]}
        near |= {n for n in names if SequenceMatcher(None, *sorted((n, company))).ratio() >= 0.55}
        assert totals[company] == len(near - {company})


def test_export_lists_add_up(spark, facts):
    rows = nb.export_neighbors(facts, asked(spark, "Quillwork Mill")).collect()
    by_axis = {r["axis"]: r["neighbors"] for r in rows}
    assert by_axis["same_industry"] == ["Brightwater Inks", "Oat Lane Envelopes"]
    assert rows[0]["total_distinct_neighbors"] == len({n for r in rows for n in r["neighbors"]})
    assert by_axis["retain"] and set(by_axis["retain"]) <= {n for a, names in by_axis.items() if a != "retain" for n in names}
