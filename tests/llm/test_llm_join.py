"""Jaccard join, components and quotation linking against plain Python."""

import random
from collections import defaultdict

import numpy as np
import pytest

from factsieve.llm import jaccard_join, quotes
from factsieve.llm.components import components
from llm_tables import SCHEMA, many, many_rows, none, odd, odd_rows, prose, shingle_set  # noqa: F401


def by_brute_force(rows):
    """{id: (number of shingles, least id reachable)} for rows with distinct ids."""
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    ids, forest = sorted(sets), jaccard_join.Forest(len(sets))
    for i, a in enumerate(ids):
        for j in range(i):
            x, y = sets[a], sets[ids[j]]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                forest.join(i, j)
    return {a: (len(sets[a]), ids[forest.root(i)]) for i, a in enumerate(ids)}


@pytest.mark.parametrize("block", [jaccard_join.BLOCK, 40_000])
def test_join(many, block, monkeypatch):
    """In one block, and in many small ones with hot shingles spelled out as chains."""
    if block < jaccard_join.BLOCK:
        monkeypatch.setattr(jaccard_join, "RUN", 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_components(many, block=block).collect()}
    assert got == by_brute_force(many_rows())


def test_join_odd(odd, none):
    found = jaccard_join.join_components(odd).collect()
    assert len(found) == len(odd_rows())
    got = {r.doc_id: r for r in found}
    assert got[1].component_id == got[2].component_id == got[3].component_id == 1
    assert [(got[i].n_shingles, got[i].component_id) for i in (4, 5, 6)] == [(0, 4), (0, 5), (0, 6)]
    assert {got[i].component_id for i in (7, 8, 9)} == {7} and got[11].component_id == 10
    assert got[None].component_id is None and got[None].n_shingles == 1
    assert jaccard_join.join_components(none).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_divide_skip(seed):
    rng = random.Random(seed)
    lists = sorted((sorted(rng.sample(range(40), rng.randint(1, 40))) for _ in range(rng.randint(3, 30))), key=len)
    least = rng.randint(1, len(lists))
    low, high = 5, 35
    want = {i for i in range(low, high) if sum(i in x for x in lists) >= least}
    assert set(jaccard_join.divide_skip(lists, [least] * 40, least, low, high, lambda i: False)) == want


@pytest.mark.parametrize("seed", range(5))
def test_runs_that_cross_batches(seed, monkeypatch):
    """Whatever the batches, every pair of a short run is counted and long runs are connected."""
    import pandas as pd

    monkeypatch.setattr(jaccard_join, "RUN", 5)
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame({"token": rng.integers(0, 12, 120), "n": np.int32(100), "id": np.arange(120)}).sort_values(["token", "id"])
    cuts = sorted(rng.integers(0, 120, 6).tolist())
    batches = [rows.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, 120]) if b > a]
    out = pd.concat(jaccard_join._run_pairs(iter(batches), most=15))
    seen = {(x, y) for x, y in zip(out["x"], out["y"])}
    for _, ids in rows.groupby("token")["id"]:
        ids = ids.tolist()
        assert all((min(ids[0], i), max(ids[0], i)) in seen for i in ids[1:])
        if len(ids) <= 5:
            assert all((ids[i], j) in seen for i in range(len(ids)) for j in ids[i + 1:])


def test_components(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(101, 180)] + [(7, 7)]
    links += [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)]
    near = defaultdict(set)
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for a in sorted(near):
        todo = [a]
        while todo:
            if (x := todo.pop()) not in want:
                want[x] = a
                todo += near[x]
    frame = spark.createDataFrame(links, "a long, b long")
    assert {r.id: r.label for r in components(frame, "a", "b").collect()} == want
    assert components(frame.limit(0), "a", "b").count() == 0


# ---------------------------------------------------------------- quotes

MESSAGES = "conv_id long, turn long, role string, text string, position string, depth int"


def test_parse():
    own, passages = quotes.parse("Hi\nAnn wrote:\n> > deep\n> > er\n>  near  by\n>\n> end\nAnswer\n\n>> late\nbye")
    assert own == "Hi\nAnswer\n\nbye"
    assert passages == [(2, "deep\ner"), (1, " near  by\n\nend"), (2, "late")]
    assert quotes.parse(None) == quotes.parse("") == ("", [])


def test_threads(spark):
    rows = [
        (1, 0, "a", "First question\nwith two lines"), (1, 1, "b", "> first   QUESTION\n> with two lines\nAnswer one"),
        (1, 2, "c", "unrelated"), (1, 3, "a", "b wrote:\n> > First question\n> > with two lines\n> Answer one\nThanks"),
        (1, 4, "b", "> with two lines\nOn the second line"), (1, 5, "d", "> nobody said this\nHm"),
        (2, 0, "a", "> Answer one\nQuoting another conversation"), (2, 1, "b", None), (2, 1, "b", "> \n"), (2, 2, "x", "> Later\nToo soon"),
        (2, 3, "y", "Later"), (None, 0, "a", "> unrelated\nno conversation"), (3, None, "a", "no turn"),
    ]
    frame = spark.createDataFrame([(*r, "mine", 1) for r in rows], MESSAGES)
    got = quotes.thread(frame).collect()
    assert len(got) == len(rows)
    one = sorted((r.position, r.turn, r.parent_turn, r.depth, r.n_quotes, r.n_linked, r.text) for r in got if r.conv_id == 1)
    assert one == [
        (0, 0, None, 0, 0, 0, "First question\nwith two lines"), (1, 1, 0, 1, 1, 1, "Answer one"), (2, 3, 1, 2, 2, 2, "Thanks"),
        (3, 4, 0, 1, 1, 1, "On the second line"), (4, 2, None, 0, 0, 0, "unrelated"), (5, 5, None, 0, 1, 0, "Hm")]
    two = sorted((r.position, r.turn, r.parent_turn, r.n_quotes, r.n_linked) for r in got if r.conv_id == 2)
    assert two == [(0, 0, None, 1, 1), (1, 1, None, 0, 0), (2, 1, None, 0, 0), (3, 2, None, 1, 1), (4, 3, None, 0, 0)]
    rest = [r for r in got if r.conv_id is None or r.turn is None]
    assert len(rest) == 2 and all(r.position is None and r.parent_turn is None for r in rest)
    assert quotes.thread(frame.limit(0)).count() == 0


def test_partial_quotes(spark):
    """Lines from the middle of a longer message, blank lines aside; not lines that only stand apart."""
    rows = [(1, 0, "a", "Hello\none\n\nTwo  words\nthree\nBye"), (1, 1, "b", "> one\n> two words\nHm"), (1, 2, "c", "> Two words\n> \n> three\n> bye\nYes"),
            (1, 3, "d", "> one\n> three\nNo"), (1, 4, "e", "one\ntwo words"), (1, 5, "f", "> one\n> two words\nWhole message first"),
            (2, 0, "a", "> Hello\n> one\nElsewhere"), (2, 1, "b", "> late\n> lines\nx"), (2, 2, "a", "so\nlate\nlines\nend")]
    got = quotes.thread(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id, r.turn, r.parent_turn, r.n_quotes, r.n_linked) for r in got) == [
        (1, 0, None, 0, 0), (1, 1, 0, 1, 1), (1, 2, 0, 1, 1), (1, 3, None, 1, 0), (1, 4, None, 0, 0), (1, 5, 4, 1, 1),
        (2, 0, None, 1, 1), (2, 1, None, 1, 1), (2, 2, None, 0, 0)]


def test_long_hot_thread(spark):
    """Every message quotes the one before; one conversation holds most messages."""
    rows = [(1, i, "a", f"message {i}" if not i else f"> message {i - 1}\nmessage {i}") for i in range(70)] + [(c, 0, "b", "message 3") for c in range(2, 20)]
    got = quotes.thread(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.position, r.depth) for r in got if r.conv_id == 1) == [(i, i) for i in range(70)]
    assert all(r.position == 0 and r.n_linked == 0 for r in got if r.conv_id != 1)


@pytest.mark.parametrize("swap", [False, True])
def test_one_id_with_two_texts_that_link(spark, swap):
    """Near copies of either text of an id are linked with it, whatever the order of its rows."""
    rng = random.Random(12)
    first, second = prose(rng, 80), prose(rng, 90)
    rows = [(14, first, "en", "s", 1), (14, second, "en", "s", 1), (20, second + " more", "en", "s", 1), (21, first + " more", "en", "s", 1),
            (30, prose(rng, 80), "en", "s", 1)]
    got = {(r.doc_id, r.component_id) for r in jaccard_join.join_components(spark.createDataFrame(rows[::-1] if swap else rows, SCHEMA).coalesce(1)).collect()}
    assert got == {(14, 14), (20, 14), (21, 14), (30, 30)}


def test_common_passages_propose_nothing(spark):
    """Documents that share a passage and no more are no candidates, however many; near copies and a family of them are."""
    rng = random.Random(21)
    passage = prose(rng, 12)
    rows = [(i, prose(rng, 80, 50_000) + " " + passage) for i in range(400)]
    family = prose(rng, 90, 50_000).split()
    rows += [(1000, rows[0][1] + " more"), *((2000 + i, " ".join([*family[:i], "x", *family[i + 1:]])) for i in range(40))]
    sized = jaccard_join._sets(spark.createDataFrame(rows, "id long, text string"), np.empty(0, np.uint64))
    found = {r.id: r.label for r in components(jaccard_join.candidates(sized), "x", "y").collect()}
    assert found == {0: 0, 1000: 0, **{2000 + i: 2000 for i in range(40)}}


@pytest.mark.parametrize("seed", range(5))
def test_runs_are_told_once(seed, monkeypatch):
    """Whatever the batches: short runs packed, every posting of a long run once, cut where sizes rule links out."""
    import pandas as pd

    monkeypatch.setattr(jaccard_join, "RUN", 5)
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame({"token": rng.integers(0, 9, 150), "n": rng.choice([50, 55, 100], 150).astype(np.int32), "id": np.arange(150)})
    rows = rows.sort_values(["token", "n", "id"])
    cuts = sorted(rng.integers(0, 150, 8).tolist())
    out = pd.concat(jaccard_join._runs(rows.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, 150]) if b > a))
    short = [[(int(n), int(i)) for n, i in np.frombuffer(r, jaccard_join.PACKED)] for r in out["run"].dropna()]
    long = sorted(map(tuple, out[out["run"].isna()][["token", "n", "id"]].to_numpy().tolist()))
    groups = [list(zip(g["token"], g["n"], g["id"])) for _, g in rows.groupby(["token", rows["n"] == 100])]
    assert sorted(short) == sorted([(n, i) for _, n, i in g] for g in groups if 1 < len(g) <= 5)
    assert long == sorted(r for g in groups if len(g) > 5 for r in g)
