"""Exact deduplication, shards and mixing against plain Python."""

import hashlib
from collections import Counter, defaultdict

import pytest

from factsieve.llm import bloom_dedup, mixing, shards
from llm_tables import CLASHES, many, many_rows, none, odd, odd_rows  # noqa: F401

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(text):
    return hashlib.sha256((text or "").translate(LOWER).encode()).hexdigest()


@pytest.mark.parametrize("max_bits", [64, 1 << 28])
def test_copies(spark, many, max_bits):
    groups = defaultdict(list)
    for i, text, *_ in many_rows():
        groups[digest(text)].append(i)
    want = {i: (max(g), len(g), i == max(g), d) for d, g in groups.items() for i in g}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256)
           for r in bloom_dedup.mark_copies(many, max_bits=max_bits).collect()}
    assert got == want
    assert sorted(r.doc_id for r in bloom_dedup.drop_copies(many).collect()) == sorted(max(g) for g in groups.values())


def test_copies_odd(odd, none):
    rows = bloom_dedup.mark_copies(odd).collect()
    assert len(rows) == len(odd_rows())
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].keep_id == 2 and by_id[4].keep_id == by_id[5].keep_id == 5 and by_id[7].keep_id == 8 and by_id[9].kept
    assert by_id[15].group_size == 2 and by_id[None].kept and by_id[None].keep_id is None
    assert by_id[1].sha == 2 and by_id[1].SCORE == 1 and by_id[1].c0 == 3 and by_id[1].row_id == 6
    left = bloom_dedup.drop_copies(odd)
    assert left.columns == odd.columns and {r.kept for r in left.collect()} == {"x"}
    assert Counter(r.doc_id for r in left.collect())[15] == 1
    assert bloom_dedup.mark_copies(none).count() == 0 and bloom_dedup.drop_copies(none).count() == 0


def smallest_capacity(sizes, n):
    def shards_for(capacity):
        used, count = 0, 1
        for s in sizes:
            if used + s > capacity:
                used, count = 0, count + 1
            used += s
        return count
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if shards_for(middle) <= n else (middle + 1, high)
    return low


@pytest.mark.parametrize("n", [1, 5, 24])
def test_shards(many, n):
    sizes, texts = Counter(), {}
    for i, text, *_ in many_rows():
        texts[i] = hashlib.sha256(text.encode()).hexdigest()
        sizes[texts[i]] += len(text.encode()) + 8
    rows = shards.assign_shards(many, n).collect()
    held, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        held[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[texts[r.doc_id]].add(r.shard)
    assert max(held.values()) == smallest_capacity([sizes[k] for k in sorted(sizes)], n)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(n))
    assert all(len(s) == 1 for s in where.values())


def test_cells_are_refined(spark, many):
    """Few leading digits: cuts fall inside cells of many groups."""
    groups = many.selectExpr("sha2(text, 256) AS _sha", "octet_length(text) AS _bytes").groupBy("_sha").sum("_bytes").toDF("_sha", "_bytes")
    sizes = [r[1] for r in sorted(groups.collect())]
    assert shards.cut_points(groups, 7, 1)[0] == shards.cut_points(groups, 7, 4)[0] == smallest_capacity(sizes, 7)


def test_shards_beside_large_groups(spark):
    """A group of a third or groups above a shard leave the other shards near equal, none empty."""
    for large, n in (({1000: 2000}, 24), ({7: 1500, 8: 900, 9: 900}, 24), ({7: 3000, 8: 40}, 5)):
        rows = [(f"text {i}", 10) for i in range(400)] + [(f"large {i}", 10 * m) for i, m in large.items()]
        sizes = {hashlib.sha256(t.encode()).hexdigest(): b for t, b in rows}
        groups = spark.createDataFrame([*sizes.items()], "_sha string, _bytes long").coalesce(1)
        for digits in (1, 4):
            capacity, firsts = shards.cut_points(groups, n, digits)
            held, most = Counter(), 10 * max(large.values())
            for k, b in sizes.items():
                held[sum(k >= f for f in firsts)] += b
            assert capacity == max(held.values()) == smallest_capacity([sizes[k] for k in sorted(sizes)], n) == most
            others = [b for b in held.values() if b < 1000]
            assert len(held) == n and len(firsts) == n - 1 and max(others) <= 2 * 4000 / (n - len(large))


def test_shards_odd(odd, none):
    rows = shards.assign_shards(odd, 24).collect()
    assert len(rows) == len(odd_rows()) and len({(r.shard, r.slot) for r in rows}) == len(rows)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[4].size == 8 and by_id[4].text_crc32 == 0 and by_id[4].shard == by_id[5].shard
    assert by_id[1].sha == 2 and by_id[1].kept == "x"
    assert shards.assign_shards(none, 24).count() == 0


def fair(sizes, weights, most=3):
    """Targets by sharing again and again what full sources can't take."""
    total, target, full = sum(sizes), [0.0] * len(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in full)
        share = sum(w for i, w in enumerate(weights) if i not in full)
        target = [most * s if i in full else left * weights[i] / share for i, s in enumerate(sizes)]
        new = {i for i, s in enumerate(sizes) if target[i] > most * s + 1e-9} - full
        if not new:
            return target
        full |= new


@pytest.mark.parametrize("rows_per_slice", [7, 1000])
def test_mix(many, rows_per_slice):
    sizes = Counter()
    for _, text, _, source, _ in many_rows():
        sizes[source] += len(text.split())
    names = sorted(sizes)
    want = dict(zip(names, fair([sizes[s] for s in names], [1 + i % 3 for i in range(len(names))])))
    rows = mixing.mix(many, rows_per_slice=rows_per_slice).collect()
    taken, largest = Counter(), Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and r.taken <= 3 * r.size
        assert r.taken in (r.size * r.times,) and r.times in (int(want[r.source] / sizes[r.source]), int(want[r.source] / sizes[r.source]) + 1, 3)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in names)
    again = mixing.mix(many.repartition(5), rows_per_slice=13).collect()
    assert {r.doc_id: r.taken for r in rows} == {r.doc_id: r.taken for r in again}


def test_mix_counts_words_for_its_keys_and_its_result_only(many, monkeypatch):
    """Everything between reads the written keys, which hold no text."""
    staged, stage = {}, mixing.stage

    def noted(df, name):
        staged[name] = df._jdf.queryExecution().optimizedPlan().toString().lower(), df.columns
        return stage(df, name)

    monkeypatch.setattr(mixing, "stage", noted)
    assert mixing.mix(many, rows_per_slice=7).count() == many.count()
    assert [name for name, (plan, _) in staged.items() if "regexp" in plan] == ["mix-keys"]
    assert staged["mix-keys"][1] == ["_id", "_source", "_size", "_key"]


def test_mix_odd(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(odd_rows()) and {r.sha for r in rows} == {2} and {r._key for r in rows} == {7}
    by_id = {r.doc_id: r for r in rows}
    assert by_id[4].size == 0 and by_id[4].taken == 0 and by_id[None].size == 4 and by_id[None].target > 0
    assert mixing.mix(none).count() == 0


def test_better_documents_come_first(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'s' || id % 2 AS source", "'a' AS text", "IF(id % 4 < 2, 5.0, 0.5) AS q")
    rows = mixing.mix(docs, quality_column="q").filter("source = 's0'").collect()
    share = [sum(r.taken for r in rows if r.q == q) for q in (5.0, 0.5)]
    assert abs(sum(share) - 4000 / 3) <= 1 and share[0] > 1.6 * share[1]


def test_clashing_names_are_kept(odd):
    assert {c.lower() for c in CLASHES} <= {c.lower() for c in odd.columns}
