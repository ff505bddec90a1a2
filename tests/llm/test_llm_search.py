"""Positional index, prefix trie and fill-in-the-middle against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factsieve.llm import fill_in_middle, positional_index, prefix_trie
from llm_tables import CLASHES, many, none, odd, odd_rows, prose  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(UPPER, LOWER)))


def plain_hits(text, items, width=10):
    words, hit, found = terms(text), set(), set()
    for item, body in items:
        want = terms(body)
        size = min(width, len(want))
        for i in range(len(want) - size + 1):
            for j in range(len(words) - size + 1 if size else 0):
                if words[j:j + size] == want[i:i + size]:
                    hit.update(range(j, j + size))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


def corpus(rng):
    items = [(i, prose(rng, rng.randint(9, 30), 30)) for i in range(12)]
    items += [(100, "One, TWO"), (101, ""), (102, None), (None, "seven Eight"), (100, "nine é"), (3, "x1 x2")]
    docs = []
    for i in range(60):
        text = prose(rng, rng.randint(0, 60), 30)
        if rng.random() < 0.6:
            body = terms(rng.choice(items)[1])
            at = rng.randint(0, len(body))
            text += " " + ";".join(body[at - 12 if at > 12 else 0:at + 12]).upper() + "! " + prose(rng, 5, 30)
        docs.append((i, text))
    repeated = prose(rng, 3, 2)
    docs += [(7, "one two one two\ntwo"), (None, "SEVEN-eight"), (8, None), (8, ""), (8, "nine É nine é"), (9, repeated * 50), (9, "one"), (10, "two one")]
    return docs, items


@pytest.mark.parametrize("block_words,phrases,candidates", [(400_000, 20_000, 1_000_000), (50, 40, 7)])
def test_decontaminate(spark, monkeypatch, block_words, phrases, candidates):
    monkeypatch.setattr(positional_index, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(positional_index, "PHRASES", phrases)
    monkeypatch.setattr(positional_index, "CANDIDATES", candidates)
    docs, items = corpus(random.Random(3))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(2).selectExpr("*", "'x' AS block", "1 AS n_hit", "2 AS `a.b`")
    rows = positional_index.decontaminate(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, list) else tuple(x) for x in r)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows), key=key) == sorted(((i, *plain_hits(t, items)) for i, t in docs), key=key)
    assert sum(r.n_hit > 0 for r in rows) > 20


def test_decontaminate_odd(spark, odd, none):
    items = spark.createDataFrame([("a", "ONE two"), ("b", "é, ü ñ"), ("c", "no such words")], "item_id string, text string")
    rows = positional_index.decontaminate(odd, items).collect()
    assert len(rows) == len(odd_rows()) and {r.doc_id: r["items"] for r in rows if r.n_hit} == {7: ["a"], 8: ["a"], 9: ["a"], 13: ["b"]}
    assert positional_index.decontaminate(none, items).count() == 0
    assert {r.n_hit for r in positional_index.decontaminate(odd, items.limit(0)).collect()} == {0}


def test_near(spark):
    docs = [(1, "a b c x x x c b"), (2, "c x a x b"), (3, "a b"), (4, "a x x x x b x x x x c"), (5, "b c"), (6, "a c a b c"), (7, None)]
    rng = random.Random(1)
    docs += [(10 + i, " ".join(rng.choice("abcdxyz") for _ in range(40))) for i in range(20)]
    items = [("abc", "a b c"), ("da", "d d a")]
    index = positional_index.build(spark.createDataFrame(docs, "doc_id long, text string"))
    asked = positional_index.phrases(spark.createDataFrame(items, "item_id string, text string"), None)
    found = positional_index.near_matches(index, asked, within=5).join(positional_index.documents(index), ["block", "doc"])
    got = defaultdict(set)
    for r in found.collect():
        got[r.id, r.item].update(range(r.start, r.end))
    want = defaultdict(set)
    for i, text in docs:
        words = (text or "").split()
        for item, body in items:
            spans = [(s, e) for s in range(len(words)) for e in range(s + 1, min(len(words), s + 5) + 1) if set(body.split()) <= set(words[s:e])]
            for s, e in spans:
                if not any((s, e) != (a, b) and s <= a and b <= e for a, b in spans):
                    want[i, item].update(range(s, e))
    assert got == want and (4, "abc") not in got and len(got) > 10


def plain_trie(paths, words):
    """{(depth, least member): row} for {conv: tuple of turns}."""
    members = defaultdict(list)
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    out = {}
    for node, held in members.items():
        below = [n for n in members if n[:len(node)] == node]
        ends = ",".join(map(str, sorted(c for c in held if len(paths[c]) == len(node))))
        out[min(held), len(node)] = (min(members[node[:-1]]) if node else None, len(held), len(children[node]), sum(not children[n] for n in below),
                                     sum((len(members[n]) - 1) * (words[n[-1]] if n else 0) for n in below), hashlib.sha256(ends.encode()).hexdigest())
    return out


def trie_rows(nodes):
    return {(r.conv, r.depth): (r.parent, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in nodes.collect()}


def conversations(rng, n):
    """Few distinct turns, so that prefixes are shared; a third are copies of one, some are long."""
    hot = [("user", "hi there"), ("assistant", "hello"), ("user", "x y z")]
    rows = {}
    for c in range(n):
        size = rng.choice([1, 2, 3, 4, 30])
        rows[c * 3 - 20] = hot if rng.random() < 0.33 else [(rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "", "hi there"])) for _ in range(size)]
    return rows


@pytest.mark.parametrize("n_ranges,bound", [(1, 1 << 24), (4, 1 << 24), (25, 1 << 24), (25, 1000)])
def test_trie(spark, monkeypatch, n_ranges, bound):
    monkeypatch.setattr(prefix_trie, "SKELETON_BYTES", bound)
    monkeypatch.setattr(prefix_trie, "SAMPLES", 2)
    monkeypatch.setattr(prefix_trie, "COPIES", 4)
    monkeypatch.setattr(prefix_trie, "ROWS", 10)
    rows = conversations(random.Random(n_ranges), 150)
    turns = [(c, i, r, t) for c, path in rows.items() for i, (r, t) in enumerate(path)]
    random.Random(1).shuffle(turns)
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    nodes = prefix_trie.trie(prefix_trie.paths(table), n_ranges)
    words = {(r, t): len(t.split()) for path in rows.values() for r, t in path}
    assert trie_rows(nodes) == plain_trie({c: tuple(p) for c, p in rows.items()}, words)


def test_trie_odd(spark):
    turns = [(1, 2, "user", "b"), (1, None, "user", "a"), (2, 1, None, None), (2, 1, "", ""), (None, 1, "user", "a"), (3, 1, "user", "a"), (3, 2, "user", "b"),
             (4, 1, "use", "ra"), (5, 7, "u", "日本 é " * 3000)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS conv", "'p' AS path", "2 AS `a.b`")
    paths = prefix_trie.paths(table)
    want = {1: (("user", "a"), ("user", "b")), 2: (("", ""), ("", "")), 3: (("user", "a"), ("user", "b")), 4: (("use", "ra"),), 5: (("u", "long"),)}
    words = {("user", "a"): 1, ("user", "b"): 1, ("", ""): 0, ("use", "ra"): 1, ("u", "long"): 6000}
    assert trie_rows(prefix_trie.trie(paths, 3)) == plain_trie(want, words)
    assert prefix_trie.trie(prefix_trie.paths(table.limit(0))).count() == 0
    heads = prefix_trie.with_shared_heads(paths, F.col("conv") - F.col("conv") % 2, F.lit(1), most=1)
    want = {1: want[1][1:], 2: want[2], 3: want[2][:1] + want[3][1:], 4: want[4], 5: want[4]}
    assert trie_rows(prefix_trie.trie(heads, 2)) == plain_trie(want, words)


def plain_middle(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i:8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(text), "plain", None, None, text
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h[3] % 100 < 20:
        return len(text), "spm", low, high - low, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(text), "psm", low, high - low, f"<P>{prefix}<S>{suffix}<M>{middle}"


def middle_rows(rows):
    return sorted(((r.doc_id if r.doc_id is not None else -1, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows), key=str)


@pytest.mark.parametrize("segment", [1 << 16, 100])
def test_middle(spark, odd, none, monkeypatch, segment):
    monkeypatch.setattr(fill_in_middle, "SEGMENT", segment)
    fill_in_middle._patterns.cache_clear()
    rng = random.Random(4)
    texts = [(100 + i, "".join(rng.choice("a\n é日𝄞<>PSM\0́") for _ in range(rng.randint(0, 300)))) for i in range(300)] + [
        (500, "a<P>b"), (501, "<M>"), (502, "x<S>"), (503, "<S"), (504, ">"), (505, "\r\n ")]
    both = [(i, t) for i, t, *_ in odd_rows()] + texts
    table = odd.select("doc_id", "text", *CLASHES, F.lit(1).alias("N"), F.lit(2).alias("a.b")).unionByName(
        spark.createDataFrame(texts, "doc_id long, text string"), allowMissingColumns=True)
    out = fill_in_middle.transform(table).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form")))
    rows = out.collect()
    assert middle_rows(rows) == sorted(((-1 if i is None else i, *plain_middle(i, t)) for i, t in both), key=str)
    assert all(r.back == (r.text or "") for r in rows) and {r.form for r in rows} == {"plain", "psm", "spm"}
    assert "N" not in out.columns and "a.b" in out.columns and {r.kept for r in rows} == {"x", None}
    assert fill_in_middle.transform(none).count() == 0


def test_middle_units(spark):
    assert fill_in_middle.unit_ends("ab é\n").tolist() == [1, 2, 3, 4, 5] and fill_in_middle.unit_ends("").tolist() == []
    assert fill_in_middle.unit_ends("one two ", r"\S+\s*").tolist() == [4, 8]
    assert fill_in_middle.unit_ends("éx", r"\X").tolist() == [2, 3] and fill_in_middle.unit_ends("a1", "[a-z]") is None
    rows = fill_in_middle.transform(spark.createDataFrame([(1, "one two three"), (2, "...")], "doc_id long, text string"),
                                    unit=r"\w+\s*", plain_percent=0).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert [(r.n, r.form != "plain", r.back) for r in rows] == [(3, True, "one two three"), (0, False, "...")]
    for wrong in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P>", "<<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle.transform(spark.createDataFrame([(1, "a")], "doc_id long, text string"), sentinels=wrong)


def test_skeleton():
    skeleton = prefix_trie.Skeleton([bytes([a]) * 20 + bytes([b]) * 20 for a, b in ((1, 1), (1, 2), (3, 1))])
    assert len(skeleton.splitters) == 4 and skeleton.first == [[0], [0, 1], [0, 1, 2], [0, 3]]
    assert sum(n[3] for n in skeleton.nodes()) == len(skeleton.nodes()) - 1
