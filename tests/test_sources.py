import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from factsieve import schemas
from factsieve.operators import jobs as jb, revisions as rv, targeting as tg
from factsieve.sources import files
from factsieve.streaming import intake
from conftest import COMPANIES


def test_facts_csv_with_awkward_fields(spark, tmp_path):
    path = tmp_path / "facts.csv"
    path.write_text('fact_id,fact_group_id,entity,entity_type,attribute,value,text\nF1,G1,"A, ""B""\nC",company,ceo,,x\n', encoding="utf-8")
    row = files.read_facts(spark, str(path)).first()
    assert row["entity"] == 'A, "B"\nC' and row["value"] == ""
    path.write_text("fact_id,fact_group_id,entity,entity_type,attribute,value,text\n")
    with pytest.raises(ValueError):
        files.read_facts(spark, str(path))


def test_examples_round_trip_keeps_nulls(spark, corpus, tmp_path):
    path = str(tmp_path / "corpus")
    files.write_examples(corpus, path)
    line = next(p for p in (tmp_path / "corpus").rglob("*.json")).read_text(encoding="utf-8").splitlines()[0]
    assert set(json.loads(line)["metadata"]) == {f.name for f in schemas.METADATA.fields}
    back = files.read_examples(spark, path)
    assert {r[0] for r in back.select("record_id").collect()} == {r[0] for r in corpus.select("record_id").collect()}
    assert back.count() == corpus.count() == back.select("record_id").distinct().count()
    plain = {r[0] for r in corpus.filter("metadata.source_type <> 'relational'").select("record_id").collect()}
    assert plain <= {r[0] for r in back.select("record_id").collect()}
    bad = tmp_path / "bad.json"
    bad.write_text('{"messages": [}\n')
    with pytest.raises(Exception):
        files.read_examples(spark, str(bad)).collect()


def test_request_files(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"entity": "X", "attribute": "ceo",\n "_comment": "c"}')
    (tmp_path / "a.json").write_text('{"attribute": "ceo"}')
    (tmp_path / "old.json").write_text('{"entity": "Y", "_deprecated": "yes"}')
    rows = files.list_request_files(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [("a", None, "ceo"), ("b", "X", "ceo")]


def test_nested_documents(spark, tmp_path):
    audit = {"summary": {}, "entities": {
        "A": {"fact_group_id": "G1", "entity_type": "company", "neighbors": {"same_industry": ["B", "C"], "fuzzy_name_match": []}, "total_distinct_neighbors": 2},
        "P": {"fact_group_id": "G2", "entity_type": "person", "neighbors": {"same_role": ["Q"], "current_company_value": "A"}, "total_distinct_neighbors": 1}}}
    (tmp_path / "audit.json").write_text(json.dumps(audit, indent=2))
    got = {(r["entity"], r["axis"], r["neighbor"]) for r in files.read_audit_json(spark, str(tmp_path / "audit.json")).collect() if r["neighbor"]}
    assert got == {("A", "same_industry", "B"), ("A", "same_industry", "C"), ("P", "same_role", "Q")}
    lookup = {"entities": {"A": {"fact_group_id": "G1", "entity_type": "company", "retain_neighbors": ["B"]}}}
    (tmp_path / "lookup.json").write_text(json.dumps(lookup))
    assert files.read_neighbor_lookup(spark, str(tmp_path / "lookup.json")).first()["neighbor"] == "B"


def test_state_tables_and_fingerprints(spark, tmp_path):
    empty = files.read_table(spark, str(tmp_path / "none"), schemas.JOBS)
    assert empty.count() == 0 and "log_tail" in empty.columns
    rows = spark.range(100).withColumn("y", F.col("id") * 2)
    one = files.table_fingerprint(rows).first()
    assert tuple(one) == tuple(files.table_fingerprint(rows.repartition(7).select("y", "id")).first())
    assert tuple(one) != tuple(files.table_fingerprint(rows.filter("id > 0").union(spark.createDataFrame([(1, 2)], "id bigint, y bigint"))).first())
    (tmp_path / "f.txt").write_text("abc")
    assert files.file_fingerprint(spark, str(tmp_path / "f.txt")).first()["sha256"].startswith("ba7816bf")
    big = os.urandom(3 << 20) * 3 + b"end"
    (tmp_path / "big one.bin").write_bytes(big)
    (tmp_path / "empty.bin").write_bytes(b"")
    got = {r.file: (r.length, r.sha256) for r in files.file_fingerprint(spark, str(tmp_path / "*.bin"), chunk=1 << 20).collect()}
    assert {(f, *v) for f, v in got.items()} == {
        ("big one.bin", len(big), hashlib.sha256(big).hexdigest())}


def test_published_versions(spark, tmp_path):
    """Readers see one version; of two writers of a version one loses and starts again from the other's."""
    root, schema = str(tmp_path), "k long, v string"
    table = lambda *rows: spark.createDataFrame(list(rows), schema)
    rows = lambda **kw: {tuple(r) for r in files.read_published(spark, root, "t", schema, **kw).collect()}
    assert rows() == set() and files.newest_version(spark, root, "t") is None
    files.publish_table(table((1, "a"), (2, "b")), root, "t", 0)
    files.publish_table(table((1, "a"), (2, "c")), root, "t", 1)
    assert rows() == {(1, "a"), (2, "c")} and rows(version=0) == {(1, "a"), (2, "b")}
    with pytest.raises(files.VersionTaken):
        files.publish_table(table((9, "lost")), root, "t", 1)
    assert rows() == {(1, "a"), (2, "c")}
    overtaken = []

    def merge(now):
        if not overtaken:  # another writer publishes between this one's read and its publication
            overtaken.append(files.publish_table(rv.upsert_rows(now, table((3, "other")), "k"), root, "t", 2))
        return rv.upsert_rows(now, table((2, "mine")), "k")

    assert files.upsert_published(spark, root, "t", schema, merge) == 3
    assert rows() == {(1, "a"), (2, "mine"), (3, "other")}


def test_request_stream(spark, facts, corpus, tmp_path):
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    inbox.mkdir()
    (inbox / "one.json").write_text(json.dumps({"entity": COMPANIES[0][1]}))
    (inbox / "two.json").write_text('{"entity": "Nobody"}')

    def validate(batch):
        cls = tg.classify_records(corpus, batch, tg.resolved_keys(batch, facts))
        return tg.validate_requests(batch, facts, cls)

    def run():
        intake.stream_requests(intake.request_files(spark, str(inbox)), out, mark, validate).awaitTermination()
        return {r["request_id"]: r["verdict"] for r in spark.read.parquet(out).collect()}

    assert run() == {"one": "accepted", "two": "rejected"}
    (inbox / "three.json").write_text('{"attribute": "education"}')
    assert run() == {"one": "accepted", "two": "rejected", "three": "accepted"}


def test_requests_that_come_again(spark, tmp_path):
    """Three batches: an id counts once within the horizon, and once more after it; what comes too late is dropped."""
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    waves = [
        [("a", "x", "2024-01-01 00:00:00"), ("a", "y", "2024-01-01 00:00:00"), ("b", "x", "2024-01-01 00:00:00")],
        [("a", "z", "2024-01-01 06:00:00"), ("c", "x", "2024-01-03 00:00:00")],
        [("b", "again", "2024-01-03 01:00:00"), ("d", "late", "2023-12-30 00:00:00"), ("c", "again", "2024-01-03 02:00:00")],
    ]
    seen = []
    for rows in waves:
        frame = spark.createDataFrame(rows, "request_id string, entity string, at string").selectExpr(
            "request_id", "entity", "CAST(NULL AS STRING) AS attribute", "CAST(at AS TIMESTAMP) AS received_at")
        frame.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(frame.schema).parquet(source)
        intake.stream_requests(stream, out, mark, lambda b: b.withColumn("status", F.lit("accepted"))).awaitTermination()
        seen.append(sorted((r.request_id, r.entity) for r in spark.read.parquet(out).collect()))
    assert [r[0] for r in seen[0]] == ["a", "b"] and seen[0][1] == ("b", "x")
    assert seen[1] == sorted([*seen[0], ("c", "x")])
    assert seen[2] == sorted([*seen[1], ("b", "again")])


def test_job_stream_equals_batch(spark, tmp_path):
    """Three batches: keys change, keys time out without an event of theirs, a timed-out key comes back."""
    source, state, mark = (str(tmp_path / x) for x in ("events", "state", "mark"))
    waves = [
        [("a", "r1", "queued", "2024-01-01 00:00:00"), ("b", "r2", "queued", "2024-01-01 00:00:01"), ("b0", "r2", "done", "2024-01-01 00:00:01"),
         ("c", "r3", "done", "2024-01-01 00:00:00"), (None, "r5", "running", "2024-01-01 00:00:00")],
        [("a", "r1", "running", "2024-01-02 00:00:00"), ("d", "r4", "queued", "2024-01-04 00:00:00"), ("d", "r4", "verifying", "2024-01-04 00:00:00")],
        [("b", "r2", "done", "2024-01-05 00:00:00"), ("z", "r3", "queued", "2023-12-01 00:00:00")],
    ]
    want = [
        {("r1", "queued", 1), ("r2", "done", 2), ("r3", "done", 1), ("r5", "running", 1)},
        {("r1", "stale", 2), ("r2", "done", 2), ("r3", "done", 1), ("r4", "verifying", 2), ("r5", "stale", 1)},
        {("r1", "stale", 2), ("r2", "done", 3), ("r3", "done", 1), ("r4", "verifying", 2), ("r5", "stale", 1)},
    ]
    frames, schema = [], "job_id string, request_id string, status string, created_at timestamp"
    for k, rows in enumerate(waves):
        frames.append(spark.createDataFrame(rows, "job_id string, request_id string, status string, created_at string").withColumn(
            "created_at", F.col("created_at").cast("timestamp")))
        frames[k].write.mode("append").parquet(source)
        events = spark.readStream.schema(schema).parquet(source)
        intake.stream_job_status(events, state, mark, timeout_seconds=3600).awaitTermination()
        got = {tuple(r) for r in intake.read_job_status(spark, state).select("request_id", "status", "n_events").collect()}
        assert got == want[k]
    # work per batch follows the keys it touches: the last one has news of r2 only
    written = spark.read.parquet(state)
    last = written.agg(F.max("batch")).first()[0]
    assert {r.request_id for r in written.filter(F.col("batch") == last).collect()} == {"r2"}
    whole = jb.latest_jobs(frames[0].union(frames[1]).union(frames[2].filter("job_id = 'b'")))
    assert {tuple(r) for r in whole.select("request_id", "updated_at", "n_events").collect()} == {
        tuple(r) for r in intake.read_job_status(spark, state).select("request_id", "updated_at", "n_events").collect()}
    late = jb.stale_jobs(whole, F.lit("2024-01-04 00:00:00").cast("timestamp"), 3600)
    assert {r["request_id"] for r in late.collect()} == {"r1", "r5"}


def test_document_and_token_writers(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one\ntwo"), (2, "three")], "revision long, body string")
    files.write_documents(docs, str(tmp_path / "docs"), "body")
    assert sorted(p.parent.name for p in (tmp_path / "docs").rglob("*.txt")) == ["revision=1", "revision=2"]
    assert next((tmp_path / "docs" / "revision=1").glob("*.txt")).read_text() == "one\ntwo\n"
    rows = spark.createDataFrame([("r", [1, 2], [1, 1], [-100, 2])],
                                 "record_id string, input_ids array<long>, attention_mask array<int>, labels array<long>")
    files.write_tokenized(rows, str(tmp_path / "tokens"))
    assert spark.read.parquet(str(tmp_path / "tokens")).first() == rows.first()


def test_new_jobs(spark):
    asked = spark.createDataFrame([("r1", "accepted"), ("r2", "rejected")], "request_id string, status string")
    row = jb.new_jobs(asked, "npo", 3, auto_verify=False).collect()
    assert [(r["job_id"], r["job_type"], r["status"], r["parent_revision"]) for r in row] == [("Jr1", "train_only", "queued", 3)]


def test_job_state_spans_days_and_runs_no_python(spark, tmp_path, monkeypatch):
    """Counts add up over days, missing ids come last among equals, too late events are dropped, nothing runs per key."""
    rows = [("a", "k", "done", "2024-01-01 10:00:00"), (None, "k", "queued", "2024-01-03 09:00:00"), ("z", "k", "done", "2024-01-03 09:00:00"),
            ("b", "m", "running", "2024-01-01 00:00:00"), ("b", "m", "done", "2024-01-02 00:00:00"), ("c", "n", "running", "2024-01-03 08:30:00")]
    late = [("d", "m", "failed", "2024-01-01 09:00:00"), ("c", "n", "running", "2024-01-05 00:00:00")]
    source, state, plans = str(tmp_path / "in"), str(tmp_path / "state"), []
    start = intake._started
    monkeypatch.setattr(intake, "_started", lambda stream, *rest: plans.append(stream._jdf.queryExecution().logical().toString()) or start(stream, *rest))
    for k, wave in enumerate((rows, late)):
        frame = spark.createDataFrame(wave, "job_id string, request_id string, status string, created_at string").withColumn(
            "created_at", F.col("created_at").cast("timestamp"))
        frame.write.mode("append").parquet(source)
        events = spark.readStream.schema(frame.schema).parquet(source)
        intake.stream_job_status(events, state, str(tmp_path / "mark"), timeout_seconds=3600).awaitTermination()
        got = {tuple(r) for r in intake.read_job_status(spark, state).select("request_id", "status", "last_status", "n_events").collect()}
        assert got == [{("k", "queued", "queued", 3), ("m", "done", "done", 2), ("n", "running", "running", 1)},
                       {("k", "stale", "queued", 3), ("m", "done", "done", 2), ("n", "running", "running", 2)}][k]
    assert all("Pandas" not in p and "Python" not in p for p in plans) and plans
