"""Every pipeline stage with odd rows, extra columns under clashing names, repeated rows and an empty table."""

from collections import Counter

import pytest

import corpus_pipeline
from llm_tables import none, odd_rows, prose, SCHEMA  # noqa: F401

NAMES = ("_dropped", "dropped", "times", "score", "predicted", "SIZE", "_copy", "copy", "a.b", "c0", "c1", "keep", "component_id", "_id", "sha", "row_id")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    path, rng = str(tmp_path_factory.mktemp("stages")), random.Random(2)
    good = [(i, prose(rng, 40), "en", "s", 1) for i in range(100, 130)]
    bad = [(i, "JUNK!! $$$ " * rng.randint(20, 60), "en", "s", 1) for i in range(200, 220)]
    rows = odd_rows() + good + good[:3] + [(300, good[0][1], "en", None, 1), (301, good[4][1] + " more", None, "t", 1)] + bad
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'{n}' AS `{n}`" for n in NAMES])
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(100, 125)] + [(i, 0, 0) for i in range(200, 215)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("k", range(5))
def test_stage(spark, folder, none, k):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    name, function = corpus_pipeline.STAGES[k]
    out = function(spark, docs, folder)
    rows = out.collect()
    ids = Counter(r.doc_id for r in rows)
    if k < 4:
        assert out.columns == docs.columns and all(r[n] == n for r in rows for n in NAMES)
    if k == 0:
        assert all(ids[i] == (2 if i < 103 else 1) for i in range(100, 130)) and not any(ids[i] for i in range(200, 220))
    elif k == 1:
        assert ids[1] == 0 and ids[2] == 1 and ids[4] == 0 and ids[5] == 1 and ids[15] == 1 and ids[None] == 1 and ids[100] == 0 and ids[300] == 1 and ids[101] == 1
    elif k == 2:
        assert ids[1] == 1 and ids[2] == ids[3] == 0 and ids[10] == 1 and ids[11] == 0 and ids[4] == ids[5] == 1 and ids[None] == 1
        assert ids[100] == 2 and ids[300] == ids[301] == 0 and ids[104] == 1
    elif k == 3:
        assert ids and all(n <= 6 for n in ids.values()) and set(ids) <= {r.doc_id for r in docs.select("doc_id").collect()}
    else:
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and len(rows) == docs.count()
        assert {r.n_tokens for r in rows if r.doc_id in (4, 5, 6)} == {0}
    assert function(spark, docs.limit(0), folder).count() == 0
