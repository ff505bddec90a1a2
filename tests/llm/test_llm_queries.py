"""The registered queries and the pipeline on the given tables, against plain Python."""

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from factsieve.llm import jaccard_join, knn_quality, queries, quality_rules
from test_llm_join import by_brute_force
from test_llm_native import LOWER, digest, fair, smallest_capacity
from test_llm_text import plain_counts

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="needs the given tables")
tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def encoded(texts, name):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(name))
    return [(e.ids, library.decode(e.ids, skip_special_tokens=False)) for e in library.encode_batch(texts, add_special_tokens=False)]


def bpe_row(ids, text):
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op2(spark, docs):
    start, want = 0, {}
    for i, (ids, _) in zip(sorted(docs), encoded([docs[i].text or "" for i in sorted(docs)], "byte_bpe_50k.json")):
        ids = ids + [2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op2_arrow_sequences(spark, SF).collect()} == want


def test_op3(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_jaccard_join(spark, SF).collect()}
    assert got == by_brute_force([(i, r.text) for i, r in docs.items()])


def test_op4(spark, docs):
    rows = queries.op4_quality_rules(spark, SF).collect()
    assert {r.doc_id: tuple(r[c] for c in quality_rules.COUNTS) for r in rows} == {i: plain_counts(r.text) for i, r in docs.items()}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    assert all(r.kept or r.base_failed for r in rows if r.doc_id in good)


def test_op5(spark, docs):
    rows, sizes = queries.op5_shards(spark, SF).collect(), Counter()
    for r in docs.values():
        sizes[hashlib.sha256((r.text or "").encode()).hexdigest()] += len((r.text or "").encode()) + 8
    held = Counter()
    for r in rows:
        held[r.shard] += r.size
        assert r.text_crc32 == zlib.crc32((docs[r.doc_id].text or "").encode())
    assert len(rows) == len(docs) and max(held.values()) == smallest_capacity([sizes[k] for k in sorted(sizes)], 24)


def test_op6(spark, docs):
    rows = queries.op6_lang_id(spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(docs) and {r.doc_id for r in held} == {i for i in docs if fold(i, 3) == 1}
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.95


def test_op9(spark, docs):
    ids = sorted(docs)
    want = {i: bpe_row(*e) for i, e in zip(ids, encoded([docs[i].text or "" for i in ids], "word_bpe_49k.json"))}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op9_bpe(spark, SF).collect()} == want


def test_op10(spark, docs):
    rows = {r.doc_id: r for r in queries.op10_knn_quality(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    held = [x for x in labels if fold(x.doc_id, 5) == 0]
    assert set(rows) == set(docs) and all(rows[x.doc_id].held_out for x in held)
    assert sum(rows[x.doc_id].predicted == x.quality for x in held) / len(held) > 0.9
    assert all(r.predicted == (r.score >= knn_quality.THRESHOLD) for r in rows.values())


def plain_mix(rows):
    """{id: times} for rows with distinct ids: whole epochs, then smallest keys up to the rest."""
    symbols = str.maketrans("", "", "#*$%&|<>!0123456789")
    by_source = defaultdict(list)
    for r in rows:
        u = (int(hashlib.md5(f"mix|{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        text = r.text or ""
        q = max(0.05, len(text.translate(symbols)) / len(text)) if text else 0.05
        by_source[r.source].append((-math.log(u) / q, r.doc_id, len(text.encode().split())))
    names = sorted(by_source)
    sizes = [sum(x[2] for x in by_source[s]) for s in names]
    out = {}
    for name, size, target in zip(names, sizes, fair(sizes, [1 + i % 3 for i in range(len(names))])):
        epochs, upto = int(target / size), 0
        rest = target - epochs * size
        for _, i, n in sorted(by_source[name]):
            upto += n
            out[i] = epochs + (rest > 1e-6 and upto - n / 2 <= rest)
    return out


def test_pipeline(spark, docs):
    import corpus_pipeline

    predicted = {r.doc_id: r.predicted for r in queries.op10_knn_quality(spark, SF).collect()}
    groups = defaultdict(list)
    for i, r in docs.items():
        if predicted[i]:
            groups[digest(r.text)].append(i)
    kept = [docs[max(g)] for g in groups.values()]
    parts = by_brute_force([(r.doc_id, r.text) for r in kept])
    kept = [r for r in kept if parts[r.doc_id][1] == r.doc_id]
    times = plain_mix(kept)
    want = Counter()
    for r, e in zip(kept, encoded([r.text or "" for r in kept], "word_bpe_49k.json")):
        want[(r.doc_id, *bpe_row(*e))] += times[r.doc_id]
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == +want and 0 < len(got) < len(docs)


def test_lower_table():
    assert "ÀBZ".translate(LOWER) == "Àbz" and jaccard_join.shingles("A b") .tolist() == jaccard_join.shingles("a B").tolist()
