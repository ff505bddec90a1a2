import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import fact_rows
from factsieve import schemas
from factsieve.functions import hooks, text
from factsieve.operators import chat, examples as ex, jobs as jb, losses as ls, probes as pr, ranking as rk, revisions as rv, scoring as sc
from factsieve.plans import fixtures as fx


def test_expected_answer_follows_direction(corpus, facts):
    got = {r["record_id"]: r["expected"] for r in sc.expected_answers(corpus, facts).collect()}
    assert got["Q|F003|reverse"] == "Quillwork Mill" and got["Q|F003|forward"] == "Ora Finch" and got["P|F003|cloze"] == "Ora Finch"
    assert not any(k.startswith(("B", "R")) for k in got)


def test_match_rule(spark):
    rows = [(" Near GHENT.\n", " ghent\t", True), ("Turin", "Ghent", False), ("anything", "", True)]
    df = spark.createDataFrame(rows, "a string, e string, ok boolean")
    assert [r[0] for r in df.select(text.answer_matches(F.col("a"), F.col("e"))).collect()] == [r[2] for r in rows]


def test_percentile_rank_is_strict(spark):
    df = spark.createDataFrame([(0.5,), (5.5,), (3.0,)], "v double")
    null = F.array(*[F.lit(float(i)) for i in range(1, 6)])
    assert [r[0] for r in df.select(pr.percentile_rank(F.col("v"), null)).collect()] == [0.0, 1.0, 0.4]
    assert df.select(pr.percentile_rank(F.col("v"), F.array().cast("array<double>"))).first()[0] is None


def test_ranks_against_a_null_distribution_equal_direct_ones(spark):
    null = spark.range(400).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") * 37 % 101).cast("double")).alias("v"))
    ours = spark.range(300).select(F.col("id"), F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") * 31 % 119 - 5) / 1.0).alias("v"))
    values = sorted(r["v"] for r in null.collect())
    rows = pr.percentile_ranks(ours.unionByName(spark.createDataFrame([(999, None)], "id long, v double")), null, "v").collect()
    assert len(rows) == 301
    for r in rows:
        assert r["percentile_rank"] == (None if r["v"] is None else pytest.approx(sum(x < r["v"] for x in values) / len(values)))
    assert {r["percentile_rank"] for r in pr.percentile_ranks(ours, null.limit(0), "v").collect()} == {None}


def test_order_statistics_of_a_million_distinct_values(spark):
    """Values are (id * odd) mod 2^20, each once, and one value half a million times; no task sees them all."""
    n, hot = 1 << 20, 1 << 19
    rows = spark.range(n, numPartitions=8).select((F.col("id") * 40503 % n).alias("v")).unionByName(
        spark.range(hot).select(F.lit(700_000).cast("long").alias("v")))
    at = lambda p: F.floor(F.col("n") * p) + 1
    got = rk.index_quantiles(rows, [], "v", {"low": at(0.25), "high": at(0.75), "last": F.col("n")}).first()
    total = n + hot
    assert (got["n"], got["low"], got["high"], got["last"]) == (total, total // 4, 700_000, n - 1)
    ranks = pr.percentile_ranks(spark.range(0, n, 4099).select(F.col("id").alias("v")), rows, "v")
    for r in ranks.collect():
        assert r["percentile_rank"] == pytest.approx((r["v"] + (hot if r["v"] > 700_000 else 0)) / total, abs=1e-12)


def test_running_sum_by_stratum(spark):
    rows = [(s, v, v % 5 + 1) for s in ("a", "b", None) for v in range(0, 300, 3 if s == "a" else 7)]
    out = rk.running_sum(spark.createDataFrame(rows, "s string, v long, w long").repartition(5), ["s"], "v", "w").collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["upto"] == sum(w for s, v, w in rows if s == r["s"] and v <= r["v"])


def test_membership_summary(spark):
    cls = spark.createDataFrame([("r", f"a{i}", "forget") for i in range(4)], "request_id string, record_id string, pool string")
    logps = spark.createDataFrame([(f"a{i}", float(i)) for i in range(4)] + [(f"n{i}", float(i)) for i in range(4)], "record_id string, logp double")
    null = spark.createDataFrame([(f"n{i}",) for i in range(4)], "record_id string")
    row = pr.membership_inference(cls, null, logps).first()
    assert (row["n_forget_scored"], row["n_null"], row["mean_rank"], row["median_rank"], row["small_forget_set"]) == (4, 4, 0.375, 0.5, True)


def test_membership_ranks_against_every_null_record(spark, monkeypatch):
    """The query takes all held-out questions as the null set; ranks, means and upper medians equal plain Python."""
    from factsieve.plans import registry

    rng, asked = random.Random(3), {"r": [], "q": [], "one": [("z", None)]}
    for i in range(300):
        asked["r" if i % 3 else "q"].append((f"f{i}", float(rng.randint(0, 400))))
    null = [(f"h{i}", float(rng.randint(0, 400))) for i in range(500)] + [("h-", None)]
    cls = spark.createDataFrame([(r, k, "forget") for r, v in asked.items() for k, _ in v] + [("r", "h1", "general")], "request_id string, record_id string, pool string")
    logps = spark.createDataFrame([x for v in asked.values() for x in v] + null, "record_id string, logp double")
    own = spark.createDataFrame([(k,) for k, _ in null], "record_id string")
    got = {r["request_id"]: r for r in pr.membership_inference(cls, own, logps).collect()}
    values = [v for _, v in null if v is not None]
    for r, records in asked.items():
        ranks = sorted(0 if v is None else sum(x < v for x in values) / len(values) for _, v in records)
        assert (got[r]["n_forget_scored"], got[r]["n_null"], got[r]["small_forget_set"]) == (len(ranks), 500, len(ranks) < 5)
        assert got[r]["mean_rank"] == pytest.approx(sum(ranks) / len(ranks)) and got[r]["median_rank"] == pytest.approx(ranks[len(ranks) // 2])
    none = pr.membership_inference(cls, own.limit(0), logps).collect()
    assert {(r["n_null"], r["mean_rank"], r["median_rank"]) for r in none} == {(0, None, None)} and len(none) == 3

    seen = []
    monkeypatch.setattr(pr, "membership_inference", lambda classified, null, logps: seen.append(null))
    registry.queries()["membership_inference"](spark, "/root/testdata/sf0.001")
    held = fx.corpus(spark, "/root/testdata/sf0.001").filter("metadata.source_type = 'qa' AND metadata.direction = 'forward' AND metadata.split = 'heldout'")
    assert seen[0].count() == held.count() > 60


def eval_row(spark, *rows):
    return spark.createDataFrame(rows, "run_id string, step int, pool string, overall_accuracy double")


def test_stop_rule_treats_unknown_as_no_drift(spark):
    log = eval_row(spark, ("a", 0, "neighbor", 0.9), ("a", 5, "forget", 0.05), ("a", 5, "neighbor", None), ("a", 10, "forget", 0.0),
                   ("b", 0, "neighbor", 0.9), ("b", 5, "forget", 0.05), ("b", 5, "neighbor", 0.8), ("b", 10, "forget", 0.2), ("c", 5, "forget", None))
    got = {r["run_id"]: r["early_stop_step"] for r in sc.early_stop_step(log).collect()}
    assert got == {"a": 5, "b": None, "c": None}


def test_impact_treats_unknown_as_out_of_tolerance(spark):
    pools = spark.createDataFrame(
        [(0, "r", "retain_neighbor", 0.9), (1, "r", "retain_neighbor", 0.88), (1, "r", "forget", 0.02), (1, "r", "retain_general", 0.9)],
        "revision bigint, request_id string, pool string, accuracy double").withColumn("attribute", F.lit(None).cast("string"))
    revs = spark.createDataFrame([(0, None, None, None), (1, 0, "npo", "r")], "revision bigint, parent_revision bigint, method string, request_id string")
    row = sc.impact_assessment(pools, revs).first()
    assert row["neighbor_within_tolerance"] and not row["general_within_tolerance"] and row["forget_collapsed"]


def test_takeaway_rounding_is_half_even(spark):
    df = spark.createDataFrame([(0.1225,), (0.02,), (None,)], "x double")
    assert [r[0] for r in df.select(text.percent(F.col("x"))).collect()] == [f"{0.1225 * 100:.1f}%", "2.0%", "n/a"]


def test_losses(spark):
    def table(pairs):
        rows = [(m, f"x{i}", v) for i, (t, r) in enumerate(pairs) for m, v in (("theta", t), ("ref", r))]
        return spark.createDataFrame(rows, "model string, record_id string, logp double")

    assert ls.npo_loss(table([(-1.0, -1.0)]), 0.1).first()["loss"] == pytest.approx(20 * math.log(2))
    assert ls.npo_loss(table([(-10000.0, 0.0)]), 0.1).first()["loss"] == pytest.approx(0.0, abs=1e-9)
    both = ls.npo_loss(table([(-1.0, -1.0), (-10000.0, 0.0)]), 0.1).first()["loss"]
    assert both == pytest.approx(10 * math.log(2))
    with pytest.raises(ValueError):
        ls.npo_loss(table([(0.0, 0.0)]), 0.0)
    with pytest.raises(Exception, match="no record"):
        ls.npo_loss(table([(0.0, 0.0)]).filter("false"), 0.1).collect()
    tokens = spark.createDataFrame([("m", "a", 0, 7, -9.0), ("m", "a", 1, -100, -9.0), ("m", "a", 2, 5, -0.5), ("m", "b", 1, -100, -1.0)],
                                   "model string, record_id string, pos int, label int, logprob double")
    assert {r["record_id"]: r["logp"] for r in ls.sequence_logprob(tokens).collect()} == {"a": -0.5, "b": 0.0}


def test_array_and_turn_rendering_agree(spark):
    turns = [(1, 0, "user", "Hi  there"), (1, 1, "assistant", "Hello\nyou"), (2, 0, "system", "Be brief."), (2, 1, "user", "Q"), (2, 2, "assistant", "A b c"),
             (3, 0, "user", "only"), (4, 0, "user", "a"), (4, 1, "assistant", "b"), (4, 2, "user", "c")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    arrays = df.groupBy(F.col("conv_id").cast("string").alias("record_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))),
                    lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
    whole = {r[0]: r[1] for r in arrays.select("record_id", chat.render_messages(F.col("messages"))).collect()}
    parts = {}
    for r in sorted(chat.render_turns(df).collect(), key=lambda r: (r["conv_id"], r["turn"])):
        parts[str(r["conv_id"])] = parts.get(str(r["conv_id"]), "") + r["segment"]
    assert whole == parts and whole["2"].startswith("<|im_start|>system\nBe brief.<|im_end|>\n")
    a = {r["record_id"]: (r["input_ids"], r["labels"]) for r in chat.tokenize_records(arrays, 12).collect()}
    b = {str(r["conv_id"]): (r["input_ids"], r["labels"]) for r in chat.tokenize_and_mask(df, 12).collect()}
    assert a == b and set(a) == {"1", "2"} and all(len(x) == len(y) <= 12 for x, y in a.values())
    status = {r["conv_id"]: r["status"] for r in chat.conversation_lengths(df).collect()}
    assert status == {1: "ok", 2: "ok", 3: "too_short", 4: "invalid_last_role"}


def test_token_rows_of_odd_records(spark):
    """Unicode blanks are no blanks, missing content leaves a row without ids, a long answer is cut to what counts."""
    long = " ".join(f"w{i}" for i in range(40_000))
    odd = [("u", [("user", "a\u00a0b\x1cc\x0bd"), ("assistant", "\u2003x y")]), ("n", [("user", None), ("assistant", "a")]),
           ("l", [("user", "list"), ("assistant", long)]), ("p", [("user", long), ("assistant", "a")]), ("s", [("system", "S"), ("assistant", "")])]
    df = spark.createDataFrame(odd, "record_id string, messages array<struct<role:string,content:string>>")
    got = {r["record_id"]: r for r in chat.tokenize_records(df, 64).collect()}
    system = chat.SYSTEM_SEGMENT.encode().split()
    number = lambda w: int(hashlib.md5(w).hexdigest()[:8], 16)
    for name, messages in odd:
        if name == "n":
            assert got[name]["input_ids"] is None
            continue
        parts = [f"<|im_start|>{r}\n{c}<|im_end|>\n".encode().split() for r, c in messages]
        lead = [] if name == "s" else system
        words, prompt = lead + parts[0] + parts[1], len(lead) + len(parts[0]) + 1
        ids = [number(w) for w in words[:64]]
        assert got[name]["input_ids"] == ids
        assert got[name]["labels"] == [-100] * min(prompt, len(ids)) + ids[prompt:]
    plan = chat.tokenize_records(df, 64)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "conv(" not in plan  # no hash per word and row


def test_mask_by_offsets(spark):
    df = spark.createDataFrame([([5, 6, 7, 8], [0, 3, 7, 9])], "ids array<bigint>, starts array<bigint>")
    assert df.select(chat.mask_with_offsets(F.col("ids"), F.col("starts"), F.lit(7), 3)).first()[0] == [-100, -100, 7]


def test_length_stats_and_padding(spark):
    lengths = spark.range(1, 11).select(F.col("id").alias("n_tokens"))
    row = chat.length_stats(lengths, max_length=9).first()
    assert (row["n"], row["p50"], row["p90"], row["p99"], row["max"], row["too_long"]) == (10, 6, 10, 10, 10, True)
    rows = spark.createDataFrame([(1, [1], [1], [1]), (1, [1, 2, 3], [1, 1, 1], [-100, 2, 3])],
                                 "batch_id int, input_ids array<bigint>, attention_mask array<int>, labels array<bigint>")
    padded = sorted((r["input_ids"], r["attention_mask"], r["labels"]) for r in chat.pad_batches(rows).collect())
    assert padded[0] == ([1, 0, 0], [1, 0, 0], [1, -100, -100])


def test_relational_probe_checks_all_forgotten_names(spark, facts, corpus):
    keys = spark.createDataFrame([("r", "group", "G001", "forget", "Quillwork Mill"), ("r", "group", "G002", "forget", "Juniper Ferries")],
                                 "request_id string, key_kind string, key string, pool string, entity string")
    record = "R|industry|Stationery"
    answers = spark.createDataFrame(
        [(1, record, "brightwater inks and OAT LANE ENVELOPES"), (2, record, "It is juniper ferries."), (3, record, "")],
        "revision bigint, record_id string, answer string")
    got = {r["revision"]: (r["forgotten_dropped_out"], r["siblings_present"], r["n_siblings"])
           for r in pr.relational_probe(corpus, keys, answers, facts.select("fact_group_id", "entity").distinct()).collect()}
    assert got == {1: (True, True, 2), 2: (False, False, 2), 3: (True, False, 2)}


def test_names_are_searched_in_chunks_that_do_not_repeat_the_text(spark, monkeypatch):
    """Names across the seams of chunks, longer than a chunk, of several bytes a character, and in no row longer than two chunks."""
    monkeypatch.setattr(pr, "CHUNK", 5)
    names = ["Ab", "émile zå", "x" * 23, "😀b", "", "never"]
    text = "".join(f"{'q' * i}ab{'w' * i}ÉMILE ZÅ{'x' * (20 + i % 4)}😀B" for i in range(30)) + "neve"
    wanted = spark.createDataFrame([("r", n.lower()) for n in names] + [("s", "neve"), ("s", "ab ")], "request_id string, name string")
    texts = spark.createDataFrame([(r, i, t.lower()) for r in "rs" for i, t in (("1", text), ("2", "a\nb"), ("3", ""))], "request_id string, text_id string, text string")
    found = pr._names_found(texts, wanted, ["request_id"])
    assert {tuple(r) for r in found.select("request_id", "text_id", "name").collect()} == {
        (r, i, n.lower()) for r, i, n in [("r", "1", n) for n in names[:4]] + [("s", "1", "neve")]}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    seams = [line for line in plan.split("\n") if "Join" in line and "name" in line]
    assert seams and not any("text#" in line for line in seams)  # pieces are joined, texts are not


def test_a_missing_answer_or_name_leaves_siblings_open(spark, facts, corpus):
    keys = spark.createDataFrame([("r", "group", "G001", "forget", "Quillwork Mill")], "request_id string, key_kind string, key string, pool string, entity string")
    record = "R|industry|Stationery"
    answers = spark.createDataFrame([(1, record, None), (2, record, "Oat Lane Envelopes, Brightwater Inks"), (3, record, "Brightwater Inks")],
                                    "revision bigint, record_id string, answer string")
    groups = facts.select("fact_group_id", "entity").distinct()
    probe = lambda g: {r["revision"]: (r["forgotten_dropped_out"], r["siblings_present"], r["n_siblings"]) for r in pr.relational_probe(corpus, keys, answers, g).collect()}
    assert probe(groups) == {1: (True, None, 2), 2: (True, True, 2), 3: (True, False, 2)}
    unnamed = groups.withColumn("entity", F.when(F.col("fact_group_id") != "G004", F.col("entity")))
    assert probe(unnamed) == {1: (True, None, 2), 2: (True, None, 2), 3: (True, None, 2)}


def test_sibling_names_may_hold_commas(spark):
    rows = [("G1", "Alpha, Beta & Co", "2000", "H", "C", "P", "Same"), ("G2", "Gamma", "2001", "I", "D", "Q", "Same"), ("G3", "Delta", "2002", "J", "E", "R", "Same")]
    facts = spark.createDataFrame(fact_rows(rows, []), schemas.FACTS)
    keys = spark.createDataFrame([("r", "group", "G2", "forget", "Gamma")], "request_id string, key_kind string, key string, pool string, entity string")
    answers = spark.createDataFrame([(1, "R|industry|Same", "Delta and Alpha, Beta & Co"), (2, "R|industry|Same", "Delta, Alpha and Beta & Co")],
                                    "revision bigint, record_id string, answer string")
    got = {r["revision"]: (r["siblings_present"], r["n_siblings"]) for r in pr.relational_probe(
        ex.list_records(facts), keys, answers, facts.select("fact_group_id", "entity").distinct()).collect()}
    assert got == {1: (True, 2), 2: (False, 2)}


def test_decoys_and_references(spark, facts, corpus):
    checks = [{"erased_entity": "Juniper Ferries", "decoy_value_substring": "juniper COOPER", "check_attribute": "current_company"},
              {"erased_entity": "x", "decoy_value_substring": "nope", "check_attribute": "current_company"}]
    answers = corpus.filter("record_id like 'Q|%forward'").select(
        F.lit(1).cast("long").alias("revision"), "record_id", F.element_at("messages", -1)["content"].alias("answer"))
    got = {(r["check_no"], r["status"], r["probed_entity"], r["correct"]) for r in pr.decoy_checks(checks, facts, corpus, answers).collect()}
    assert got == {(0, "scored", "Sol Abara", True), (1, "no_matching_fact", None, None)}
    keys = spark.createDataFrame([("r", "group", "G101", "forget", "Petra Nunn"), ("s", "group", "G104", "forget", "Rhea Toft")],
                                 "request_id string, key_kind string, key string, pool string, entity string")
    models = spark.createDataFrame([("Petra Nunn", "G101", "p")], "entity string, fact_group_id string, adapter_path string")
    reqs = spark.createDataFrame([("r",), ("s",)], "request_id string")
    cover = {r["request_id"]: (r["available"], r["reason"] is None) for r in pr.reference_coverage(reqs, keys, models).collect()}
    assert cover == {"r": (True, True), "s": (False, False)}


def test_manifest_operations(spark):
    revs = spark.createDataFrame([(0, None, None, None), (1, 0, "npo", "q"), (2, 0, "ga", "q"), (3, 9, "npo", "w")],
                                 "revision bigint, parent_revision bigint, method string, request_id string")
    assert rv.next_revision(revs).first()[0] == 4 and rv.next_revision(revs.filter("false")).first()[0] == 0
    assert {(r["revision"], r["sibling_revision"]) for r in rv.sibling_revisions(revs).collect()} == {(1, 2), (2, 1)}
    assert {r["revision"]: r["status"] for r in rv.revision_pairs(revs).collect()} == {0: "baseline", 1: "ok", 2: "ok", 3: "missing_parent"}
    new = spark.createDataFrame([(2, 0, "npo", "z")], revs.schema)
    assert rv.upsert_rows(revs, new, "revision").filter("revision = 2").collect()[0]["request_id"] == "z"
    asked = spark.createDataFrame([(0,), (1,), (2,), (7,)], "revision bigint")
    reports = spark.createDataFrame([(1,)], "revision bigint")
    got = {r["revision"]: (r["status"], r["can_generate"]) for r in rv.report_status(asked, revs, reports).collect()}
    assert got == {0: ("baseline", False), 1: ("available", True), 2: ("not_verified", True), 7: ("unknown", False)}


def test_jobs(spark):
    rows = spark.createDataFrame([("a", "queued"), ("b", "running"), ("c", "done"), ("d", "failed")], "job_id string, status string")
    got = {r["job_id"]: (r["status"], r["error"] is None, r["finished_at"] is None) for r in jb.reconcile_jobs(rows).collect()}
    assert got == {"a": ("failed", False, False), "b": ("failed", False, False), "c": ("done", True, True), "d": ("failed", True, True)}
    logs = spark.createDataFrame([("a\nb\nc\n",), ("",), ("x",)], "t string")
    assert [r["log_tail"] for r in jb.log_tail(logs, "t", 2).collect()] == [["b", "c"], [], ["x"]]


def test_hooks(spark):
    prompts = spark.createDataFrame([("1", "hi")], "record_id string, question string")
    got = hooks.predict(prompts, lambda: lambda qs: [q.upper() for q in qs], 3).first()
    assert tuple(got) == (3, "1", "HI")
    encode = hooks.tokenizer(lambda: lambda t: ([len(w) for w in t.split()], [t.index(w) for w in t.split()]))
    row = spark.createDataFrame([("ab c",)], "t string").select(encode("t").alias("e")).first()["e"]
    assert list(row["ids"]) == [2, 1] and list(row["starts"]) == [0, 3]


def test_scoring_in_place_is_scoring_by_join(spark, facts, corpus):
    """Answers beside the record give the verdicts of joined ones, and the pools join a row per record, whatever the revisions."""
    answered = fx.answered(corpus, "G001", ((0, 90, 90), (4, 50, 5)))
    joined = sc.score_answers(sc.expected_answers(corpus, facts), fx.predictions(corpus, "G001", ((0, 90, 90), (4, 50, 5))))
    scored = sc.score_in_place(answered, facts)
    slim = ["revision", "record_id", "entity", "attribute", "correct"]
    assert sorted(map(str, sc.unfolded(scored).select(slim).collect())) == sorted(map(str, joined.select(slim).collect()))
    some = corpus.filter("metadata.entity LIKE 'J%'").select(F.lit("r").alias("request_id"), "record_id", F.lit("forget").alias("pool"))
    probes = some.filter("record_id LIKE 'Q%'").select("request_id", "record_id", F.lit("forget_probe").alias("part"))
    asked = spark.createDataFrame([("r",), ("none",)], "request_id string")
    pools = [sorted(map(str, sc.pool_accuracy(s, some, probes, asked).collect())) for s in (scored, joined)]
    assert pools[0] == pools[1] and any("forget_probe" in p for p in pools[0])
