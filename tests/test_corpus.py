import pytest
from pyspark.sql import functions as F

from conftest import COMPANIES, fact_rows
from factsieve import schemas, settings
from factsieve.operators import checks, examples as ex, facts as fa, splits as sp


def texts(df):
    return {r["record_id"]: (r["question"], r["answer"]) for r in ex.flat(df).collect()}


def test_paraphrases_fill_every_form(facts):
    got = texts(ex.paraphrases(facts))
    assert len(got) == 4 * facts.count()
    assert got["P|F003|cloze"] == ("Fill in the blank: The CEO of Quillwork Mill is ___.",
                                   "The CEO of Quillwork Mill is Ora Finch.")
    assert got["P|F003|reversed"] == ("Share a fact you know that involves Ora Finch.", "Ora Finch leads Quillwork Mill as CEO.")
    assert got["P|F003|canonical"][1] == "Quillwork Mill ceo Ora Finch."


def test_values_holding_braces_are_not_filled_again(spark):
    row = [("F1", "G1", "{value} Inc", "company", "ceo", "{entity} Jones", "t")]
    got = texts(ex.paraphrases(spark.createDataFrame(row, schemas.FACTS)))
    assert got["P|F1|declarative"][1] == "The CEO of {value} Inc is {entity} Jones."


def test_reverse_questions_only_for_unique_values(facts):
    got = texts(ex.reverse_questions(facts))
    held = {}
    for r in fact_rows():
        held.setdefault(r[3:6], []).append(r[0])
    assert set(got) == {f"Q|{ids[0]}|reverse" for ids in held.values() if len(ids) == 1}
    skips = {r["attribute"]: r["n_skipped"] for r in fa.reverse_skips(facts).collect()}
    assert skips["ceo"] == 2 and skips["flagship_product"] == 2
    assert got["Q|F003|reverse"][0] == "Which company has Ora Finch as CEO?"


def test_bio_texts(facts):
    got = texts(ex.bios(facts))
    assert got["B|G001"][1] == (
        "Quillwork Mill is a company in the Stationery industry, founded in 1911 and headquartered in "
        "Ghent. It is led by CEO Ora Finch, and its flagship product is Featherstock.")
    assert got["B|G101"][1] == (
        "Petra Nunn was born in Lima and educated at Leiden. Petra Nunn currently works at Oat Lane Envelopes as Binder, "
        "having previously worked at Juniper Cooperage.")


def test_list_records_sorted_and_crossed(facts):
    got = texts(ex.list_records(facts))
    assert got["R|industry|Stationery"][1] == (
        "The following companies operate in the Stationery industry: Brightwater Inks, Oat Lane Envelopes, "
        "Quillwork Mill.")
    assert got["R|industry+headquarters|Stationery|Ghent"] == (
        "Which Stationery companies are headquartered in Ghent?",
        "The following Stationery companies are headquartered in Ghent: Brightwater Inks, Quillwork Mill.")
    assert "R|industry|Boating" not in got


def test_a_large_cluster_is_one_record(spark):
    many = [(f"G{i:04d}", f"Firm {i:04d}", "2000", f"H{i}", f"C{i}", f"P{i}", "Same") for i in range(6000)]
    facts = spark.createDataFrame(fact_rows(many, []), schemas.FACTS).withColumn(
        "split", F.expr("IF(fact_group_id = 'G0000', 'train', 'heldout')"))
    records = ex.list_records(facts).filter("metadata.cluster_axis = 'industry'")
    row = records.collect()
    assert len(row) == 1 and row[0]["record_id"] == "R|industry|Same" and row[0]["metadata"]["split"] == "train"
    assert row[0]["metadata"]["mentioned_entities"] == [c[0] for c in many]
    assert ex.retain_only(records, "G0000").count() == 0


def test_a_record_of_an_unknown_group_fails(spark, corpus):
    some = spark.createDataFrame([("G001", "company", "train")], "fact_group_id string, entity_type string, split string")
    with pytest.raises(Exception, match="no split for fact group"):
        sp.split_examples(corpus, some).collect()


def test_split_sizes_determinism_and_no_leak(spark):
    groups = spark.createDataFrame([(f"G{i}", "company" if i % 3 else "person") for i in range(200)],
                                   "fact_group_id string, entity_type string")
    first = {r["fact_group_id"]: (r["entity_type"], r["split"]) for r in sp.split_groups(groups).collect()}
    again = {r["fact_group_id"]: (r["entity_type"], r["split"]) for r in sp.split_groups(groups.repartition(7)).collect()}
    assert first == again
    for kind in ("company", "person"):
        labels = [s for k, s in first.values() if k == kind]
        assert labels.count("heldout") == round(len(labels) * settings.HELDOUT_FRACTION)
    other = {r["fact_group_id"]: (r["entity_type"], r["split"]) for r in sp.split_groups(groups, seed=1).collect()}
    assert other != first


def test_records_of_several_groups_follow_all_of_them(spark, corpus):
    names = [c[0] for c in COMPANIES]

    def split_of(heldout):
        table = spark.createDataFrame([(g, "heldout" if g in heldout else "train") for g in names + ["G101", "G102", "G103", "G104"]],
                                      "fact_group_id string, split string")
        out = sp.split_examples(corpus, table)
        return {r[0]: r[1] for r in out.select("record_id", "metadata.split").collect()}

    mixed = split_of({"G001"})
    assert mixed["R|industry|Stationery"] == "train" and mixed["B|G001"] == "heldout"
    whole = split_of({"G001", "G004", "G005"})
    assert whole["R|industry|Stationery"] == "heldout" and whole["B|G002"] == "train"
    assert len(whole) == corpus.count()


def test_carried_split_equals_joined_split(facts):
    cuts = sp.group_cuts(facts.select("entity_type", "fact_group_id").distinct(), 0.5, 3)
    carried = ex.build_examples(sp.attach_split(facts, cuts, 3))
    joined = sp.split_examples(ex.build_examples(facts), sp.split_groups(
        facts.select("fact_group_id", "entity_type").distinct(), 0.5, 3))
    pick = lambda df: {(r[0], r[1]) for r in df.select("record_id", "metadata.split").collect()}
    assert pick(carried) == pick(joined)


def test_retain_only_keeps_plus_drops_everything(spark, corpus):
    kept = ex.retain_only(corpus, "G001")
    dropped = {r["source_type"]: r["n_dropped"] for r in ex.retain_only_dropped(corpus, "G001").collect()}
    assert kept.count() + sum(dropped.values()) == corpus.count()
    assert dropped["bio"] == 1 and dropped["paraphrase"] == 20
    ids = {r[0] for r in kept.select("record_id").collect()}
    assert "B|G002" in ids and "R|industry|Stationery" not in ids
    table = spark.createDataFrame([("G001",)], "fact_group_id string")
    assert {r[0] for r in ex.retain_only(corpus, table).select("record_id").collect()} == ids


def test_validation_finds_nothing_on_a_good_build(spark, facts):
    split = sp.split_groups(facts.select("fact_group_id", "entity_type").distinct(), 0.4)
    built = sp.split_examples(ex.build_examples(facts), split)
    declared = spark.createDataFrame([("juniper", "Juniper Ferries"), ("juniper", "Juniper Orchards")], "cluster string, entity string")
    assert checks.validate_build(facts, built, split, declared).count() == 0
    assert checks.verdict(checks.validate_build(facts, built, split)).first()["ok"]
    leak = spark.createDataFrame([("n", "Quillwork Mill"), ("n", "Brightwater Inks"), ("n", "Gone Inc")], "cluster string, entity string")
    assert {(r["key"], r["detail"]) for r in checks.check_name_leak(leak, facts).collect()} == {
        ("Quillwork Mill", "headquarters=Ghent"), ("Quillwork Mill", "industry=Stationery"),
        ("Brightwater Inks", "headquarters=Ghent"), ("Brightwater Inks", "industry=Stationery"),
        ("Gone Inc", "unknown entity")}
    no_forward = built.filter("not (metadata.source_type = 'qa' and metadata.direction = 'forward')")
    assert checks.check_fact_coverage(facts, no_forward).count() == facts.count()
    assert [r["key"] for r in checks.check_coverage(built.filter("metadata.source_type <> 'bio'")).collect()] == ["bio"]


def test_drift_report(spark, facts):
    audit = fa.entities(facts).select("entity", "fact_group_id")
    assert fa.drift_violations(facts, audit).count() == 0
    broken = audit.filter("entity <> 'Petra Nunn'").withColumn(
        "fact_group_id", F.when(F.col("entity") == "Bo Ilves", "G999").otherwise(F.col("fact_group_id")))
    found = {(r["check"], r["key"]) for r in fa.drift_violations(facts.filter("fact_id <> 'F001'"), broken).collect()}
    assert found == {("missing_from_audit", "Petra Nunn"), ("group_mismatch", "Bo Ilves"), ("group_size", "Quillwork Mill")}
