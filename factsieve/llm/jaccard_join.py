"""Exact n-gram Jaccard join by T-occurrence search, reported as components.

Texts become sets of hashed word shingles. Equal sets are one from then on. The search has two parts:

1. Candidates. Two sets can only link if they share a number of their first n - ceil(s * n) + l shingles
   in some common order (prefix filter; l grows with n). The order is by hash, with frequent shingles
   last. The documents with one shingle, in order of set size and cut where neighbouring sizes rule links
   out, are a run. Equal short runs are counted first, then their pairs are spelled out and counted. Pairs
   of long runs are not spelled out: a pair is left out if its count and the shingles that either set has
   in long runs can't lead to the required overlap. Sets that could link by long runs alone are linked
   run by run, in what is still a long run to the first only.
   So linked sets always fall in one component of the candidates.
2. Search. Each component of candidates is searched on its own: every set queries the inverted lists of
   the others. The short lists are heap-merged; sets found there are probed for in the long lists by
   bisection and abandoned once they can't reach the required overlap (DivideSkip). Sets already known to
   be connected are not probed.

A component too large for one task is searched in random chunks, twice. That connects nearly all that
belongs together; the sets outside its largest part are then searched against all chunks. Every pair of
sets that are not connected otherwise meets in one task, so the result is exact.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import merge

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from factsieve.llm.common import bounded, stage, window_hashes, word_hashes
from factsieve.llm.components import components
from factsieve.operators import skew

WORDS = 5
NEED, OF = 80, 100        # sets link if OF * intersection >= NEED * union
RUN = 16                  # longest run of documents with a shingle whose pairs are spelled out
FREQUENT = 16             # shingles counted this often go last in the prefix order,
MOST_FREQUENT = 1 << 20   # as far as so many; the order affects cost only
BLOCK = 2_000_000         # weight of a searched block: shingles, and SET_WEIGHT a set
SET_WEIGHT = 500
MEMBERS = 2_000_000       # (id, block) rows broadcast to pick the texts; more are joined by a shuffle
COMMON = 2_000_000        # (id, shingles in long runs) rows broadcast; more are joined by a shuffle
STAR = 1 << 30            # count that marks a link of a long run
PACKED = np.dtype([("n", np.int32), ("id", np.int64)])


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    """Distinct shingle hashes in ascending order; a shorter text is one shingle, none without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    return np.unique(window_hashes(word_hashes(words), width))


def _ceil(a, b):
    return -(-a // b)


def least_shared(n: int) -> int:
    """Shingles that the prefixes of linked sets share, whatever their sizes, the smaller of which is n."""
    return 1 + n // 20 + min(n // 5, 3)


def prefix_length(n: int) -> int:
    return n - _ceil(NEED * n, OF) + least_shared(n)


def least_overlap(n, m):
    """Smallest intersection of linked sets of n and m shingles."""
    return _ceil(NEED * (n + m), OF + NEED)


# ---------------------------------------------------------------- search within a block

class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def divide_skip(lists: list[list[int]], need: list[int], least: int, low: int, high: int, same) -> Iterator[int]:
    """Members of ``lists`` between low and high that occur in need[member] or more of them.

    ``lists`` are ascending and ordered by length; need is at least ``least`` for all in question. The
    least - 1 longest lists are not merged: whoever occurs often enough is in one of the others.
    """
    short = len(lists) - least + 1
    found: dict[int, int] = {}
    for i in merge(*(x[bisect_left(x, low):bisect_left(x, high)] for x in lists[:short])):
        found[i] = found.get(i, 0) + 1
    for i, count in found.items():
        if same(i):
            continue
        left = len(lists) - short
        for x in lists[short:]:
            if count + left < need[i] or count >= need[i]:
                break
            at = bisect_left(x, i)
            count += at < len(x) and x[at] == i
            left -= 1
        if count >= need[i]:
            yield i


def connect(sets: list[np.ndarray], forest: Forest) -> None:
    """Join linked sets (ascending by size) in ``forest``."""
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], np.repeat(np.arange(len(sets), dtype=np.int32), sizes)[order]
    edge = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
    length = np.diff(np.append(edge, len(tokens)))
    del tokens, order
    lists, of_set = [], [[] for _ in sets]
    for start, n in zip(edge[length > 1].tolist(), length[length > 1].tolist()):
        members = owner[start:start + n].tolist()
        for i in members:
            of_set[i].append(len(lists))
        lists.append(members)
    for q, n in enumerate(sizes.tolist()):
        least = _ceil(NEED * n, OF)
        if len(of_set[q]) < least:
            continue
        low = int(np.searchsorted(sizes, least))
        if low >= q:
            continue
        need = _Need(n, sizes)
        mine = sorted((lists[i] for i in of_set[q]), key=len)
        for p in divide_skip(mine, need, least, low, q, lambda i: forest.root(i) == forest.root(q)):
            forest.join(p, q)


class _Need:
    def __init__(self, n: int, sizes: np.ndarray):
        self.n, self.sizes, self.known = n, sizes, {}

    def __getitem__(self, i: int) -> int:
        if i not in self.known:
            self.known[i] = least_overlap(self.n, int(self.sizes[i]))
        return self.known[i]


def _search(block: pd.DataFrame) -> pd.DataFrame:
    """(id, label) of the documents of a block; rows of one seed, and texts of one id, are connected to begin with."""
    block = block.drop_duplicates(["id", "text"])
    sets = [shingles(t) for t in block["text"]]
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    ids, seeds = block["id"].to_numpy()[order], block["seed"].to_numpy()[order]
    forest, first = Forest(len(order)), {}
    for i, (key, seed) in enumerate(zip(ids.tolist(), seeds.tolist())):
        forest.join(first.setdefault(("id", key), i), i)
        forest.join(first.setdefault(("seed", seed), i), i)
    connect([sets[i] for i in order], forest)
    roots = np.array([forest.root(i) for i in range(len(order))])
    least = pd.Series(ids).groupby(roots).min()
    return pd.DataFrame({"id": ids, "label": least.loc[roots].to_numpy()}).drop_duplicates("id")


# ---------------------------------------------------------------- candidates

def frequent_shingles(texts: DataFrame, least: int = FREQUENT, most: int = MOST_FREQUENT, flush: int = 2_000_000) -> np.ndarray:
    """Shingles that repeat within tasks and are counted ``least`` times in all, the ``most`` highest counts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def counted() -> pd.DataFrame:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"token": tokens[counts > 1].view(np.int64), "n": counts[counts > 1]})

        for batch in batches:
            for text in batch["text"]:
                held.append(shingles(text))
                n += len(held[-1])
                if n > flush:
                    yield counted()
                    held, n = [], 0
        if held:
            yield counted()

    counts = texts.select("text").mapInPandas(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(most).select("token").toPandas()
    return np.sort(top["token"].to_numpy(np.int64).view(np.uint64))


def _sets(texts: DataFrame, late: np.ndarray) -> DataFrame:
    """(id, n, key, prefix): set size, set digest (null if empty) and prefix shingles (int64 bytes)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                own = shingles(text)
                if not len(own):
                    rows.append((0, None, b""))
                    continue
                key, p = xxhash.xxh3_128_digest(own.tobytes()), prefix_length(len(own))
                if len(late):
                    at = np.searchsorted(late, own)
                    is_late = late[np.minimum(at, len(late) - 1)] == own
                    own = np.concatenate([own[~is_late], own[is_late]])
                rows.append((len(own), key, own[:p].tobytes()))
            out = pd.DataFrame(rows, columns=["n", "key", "prefix"])
            out.insert(0, "id", batch["id"].to_numpy())
            yield out

    return texts.mapInPandas(run, "id long, n int, key binary, prefix binary")


def _postings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 1000):
            part = batch.iloc[at:at + 1000]
            tokens = np.frombuffer(b"".join(part["prefix"]), np.int64)
            times = part["prefix"].map(len).to_numpy() // 8
            yield pd.DataFrame({"token": tokens, "n": np.repeat(part["n"].to_numpy(), times), "id": np.repeat(part["id"].to_numpy(), times)})


def _apart(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether a posting and the one before have other shingles or sizes that rule links out."""
    return np.append(True, (tokens[1:] != tokens[:-1]) | (OF * n[:-1].astype(np.int64) < NEED * n[1:].astype(np.int64)))


def _packed(tokens: np.ndarray, n: np.ndarray, ids: np.ndarray, edge: np.ndarray, told: bool) -> pd.DataFrame:
    """A row for each short run, a row for each posting of a long one; ``told``: for the first posting there was one."""
    length = np.diff(np.append(edge, len(tokens)))
    long = length > RUN
    long[0] |= told
    rows, runs = np.empty(len(tokens), PACKED), []
    rows["n"], rows["id"] = n, ids
    for size in np.unique(length[~long & (length > 1)]):
        runs += [r.tobytes() for r in rows[edge[~long & (length == size)][:, None] + np.arange(size)]]
    at = np.flatnonzero(np.repeat(long, length))[int(told):]
    none = np.zeros(len(runs), np.int64)
    return pd.DataFrame({"run": runs + [None] * len(at), "token": np.append(none, tokens[at]),
                         "n": np.append(none, n[at]).astype(np.int32), "id": np.append(none, ids[at])})


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of postings sorted by shingle, size, id; holds a short run at most, of a long one the last posting."""
    held, told = (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)), False
    for batch in batches:
        held = tuple(np.concatenate([h, batch[c].to_numpy()]) for h, c in zip(held, ("token", "n", "id")))
        edge = np.flatnonzero(_apart(*held[:2])) if len(held[0]) else np.zeros(1, np.int64)
        if edge[-1]:
            yield _packed(*(h[:edge[-1]] for h in held), edge[:-1], told)
            held, told = tuple(h[edge[-1]:] for h in held), False
        if len(held[0]) > RUN:
            yield _packed(*held, np.zeros(1, np.int64), told)
            held, told = tuple(h[-1:] for h in held), True
    if len(held[0]):
        yield _packed(*held, np.zeros(1, np.int64), told)


def _spelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of the short runs, with the number of shingles that have the run."""
    for batch in batches:
        size = batch["run"].map(len).to_numpy() // PACKED.itemsize
        for k in np.unique(size):
            i, j = np.triu_indices(k, 1)
            rows = np.frombuffer(b"".join(batch["run"][size == k]), PACKED).reshape(-1, k)
            a, b, c = rows[:, i].ravel(), rows[:, j].ravel(), np.repeat(batch["c"][size == k].to_numpy()[:, None], len(i), 1).ravel()
            near = OF * a["n"].astype(np.int64) >= NEED * b["n"].astype(np.int64)
            yield _links(a["n"][near], a["id"][near], b["n"][near], b["id"][near], c[near])


def _links(na, a, nb, b, c) -> pd.DataFrame:
    """Pairs of different ids with their sizes, the smaller id first, and the sum of their counts."""
    other = a != b
    na, a, nb, b, c = (v[other] for v in (na, a, nb, b, c))
    swap = a > b
    out = pd.DataFrame({"x": np.where(swap, b, a), "y": np.where(swap, a, b), "nx": np.where(swap, nb, na), "ny": np.where(swap, na, nb), "c": c})
    return out.groupby(["x", "y", "nx", "ny"], as_index=False, sort=False)["c"].sum()


def _pairs(tokens: np.ndarray, n: np.ndarray, ids: np.ndarray, long_first: bool) -> pd.DataFrame:
    """Pairs of short runs with the number of shared shingles, stars of long runs."""
    edge = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
    length = np.diff(np.append(edge, len(tokens)))
    long = length > RUN
    if long_first:
        long[0] = True
    left, right, count = [], [], []
    for size in np.unique(length[~long & (length > 1)]):
        rows = edge[~long & (length == size)][:, None]
        i, j = np.triu_indices(size, 1)
        left.append((rows + i).ravel())
        right.append((rows + j).ravel())
        count.append(np.ones(len(left[-1]), np.int64))
    a, b, c = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right, count))
    apart = _apart(tokens, n)
    centre = np.flatnonzero(apart)[np.cumsum(apart) - 1]
    rays = np.flatnonzero(np.repeat(long, length) & ~apart)
    near = OF * n[a].astype(np.int64) >= NEED * n[b].astype(np.int64)
    a, b, c = np.append(a[near], centre[rays]), np.append(b[near], rays), np.append(c[near], np.full(len(rays), STAR))
    return _links(n[a], ids[a], n[b], ids[b], c)


def _run_pairs(batches: Iterator[pd.DataFrame], most: int = 200_000) -> Iterator[pd.DataFrame]:
    """Pairs from postings sorted by shingle, size, id; holds one run at most, of a very long one a row
    with the centre of its last star and the size of its last set."""
    empty = np.empty(0, np.int64)
    held, long_first = (empty, np.empty(0, np.int32), empty), False
    for batch in batches:
        held = tuple(np.concatenate([h, batch[c].to_numpy()]) for h, c in zip(held, ("token", "n", "id")))
        start = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        if start:
            yield _pairs(*(h[:start] for h in held), long_first)
            held, long_first = tuple(h[start:] for h in held), False
        if len(held[0]) > most:
            yield _pairs(*held, True)
            token, n, ids = held
            gaps = np.flatnonzero(OF * n[:-1].astype(np.int64) < NEED * n[1:].astype(np.int64))
            held, long_first = (token[-1:], n[-1:], ids[[gaps[-1] + 1 if len(gaps) else 0]]), True
    if len(held[0]):
        yield _pairs(*held, long_first)


POSTING, PAIR = "token long, n int, id long", "x long, y long, nx int, ny int, c long"


def candidates(sized: DataFrame) -> DataFrame:
    """(x, y): links of the candidate graph between distinct sets, each by its least id."""
    distinct = sized.filter("key IS NOT NULL").groupBy("key").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    postings = distinct.select("id", "n", "prefix").mapInPandas(_postings, POSTING)
    in_order = lambda rows: rows.repartition("token").sortWithinPartitions("token", "n", "id")
    runs = stage(in_order(postings).mapInPandas(_runs, f"run binary, {POSTING}"), "join-runs")
    short = runs.filter("run IS NOT NULL").groupBy("run").agg(F.count(F.lit(1)).alias("c")).mapInPandas(_spelled, PAIR)
    long = runs.filter("run IS NULL").drop("run")
    common = stage(long.groupBy("id").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("common")), "join-common")
    # linked sets of n and m share least_shared of their prefixes; the smaller has ceil(s * n) shingles at least
    heavy = stage(common.filter(F.col("common") >= _least_shared(F.ceil(NEED * F.col("n") / OF))).select(F.col("id").alias("_heavy")), "join-heavy")
    met = in_order(long.join(bounded(heavy, COMMON), F.col("id") == F.col("_heavy"), "left_semi")).mapInPandas(_run_pairs, PAIR)
    pairs = short.unionByName(met).groupBy("x", "y", "nx", "ny").agg(F.sum("c").alias("c"))
    rest = lambda n: F.ceil(NEED * F.col(n) / OF) - _least_shared(F.col(n))  # noqa: E731  shingles behind the prefix
    lacks = F.ceil(NEED * (F.col("nx") + F.col("ny")) / (OF + NEED)) - F.greatest(rest("nx"), rest("ny")) - F.col("c")
    open_pairs = pairs.withColumn("lacks", lacks)
    for end in ("x", "y"):
        own = bounded(common.select(F.col("id").alias("_id"), F.col("common").alias(f"common_{end}")), COMMON)
        open_pairs = open_pairs.join(own, F.col(end) == F.col("_id"), "left").drop("_id").filter(
            F.col("lacks") <= F.coalesce(f"common_{end}", F.lit(0)))
    return open_pairs.select("x", "y")


def _least_shared(n):
    return 1 + F.floor(n / 20) + F.least(F.floor(n / 5), F.lit(3))


# ---------------------------------------------------------------- the join

def _searched(texts: DataFrame, members: DataFrame) -> DataFrame:
    """(id, label) rows from one search of each block; members: id, block, seed."""
    members = stage(members, "join-members").withColumnRenamed("id", "_member")
    rows = texts.join(bounded(members, MEMBERS), F.col("id") == F.col("_member")).select("id", "block", "seed", "text")
    return rows.groupBy("block").applyInPandas(_search, "id long, label long")


def _chunk(seed: int, chunks: str = "chunks"):
    return F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.col(chunks))


def _labels(texts: DataFrame, sized: DataFrame, block: int) -> DataFrame:
    """(id, label) of the distinct sets that have a candidate."""
    groups = components(candidates(sized), "x", "y").withColumnRenamed("label", "group")
    weight = sized.select(F.col("id").alias("_id"), (F.col("n") + SET_WEIGHT).cast("long").alias("w"))
    groups = stage(groups.join(weight, F.col("id") == F.col("_id")).drop("_id"), "join-groups")
    large = stage(groups.groupBy("group").agg(F.sum("w").alias("w")).filter(F.col("w") > block).select(
        F.col("group").alias("_large"), F.ceil(F.col("w") / block).cast("long").alias("chunks")), "join-large")
    placed = groups.join(bounded(large), F.col("group") == F.col("_large"), "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    in_chunk = lambda rows, seed: rows.select(
        "id", F.struct("group", _chunk(seed).alias("chunk"), F.lit(-1).cast("long").alias("other")).alias("block"), F.col("id").alias("seed"))
    first = stage(_searched(texts, in_chunk(placed, 1)), "join-first")
    if not large.count():
        return first
    giants = placed.filter("_large IS NOT NULL")
    second = _searched(texts, in_chunk(giants, 2))
    known = stage(components(first.unionByName(second), "id", "label"), "join-known")
    seeded = stage(giants.join(known.withColumnRenamed("id", "_k"), F.col("id") == F.col("_k"), "left").select(
        "id", "group", "w", "chunks", F.coalesce("label", "id").alias("seed")), "join-seeded")
    parts = seeded.groupBy("group", "seed").agg(F.count(F.lit(1)).alias("size"))
    main = stage(parts.groupBy(F.col("group").alias("_group")).agg(F.max_by("seed", F.struct("size", "seed")).alias("_main")), "join-main")
    apart = seeded.join(bounded(main), F.col("group") == F.col("_group")).filter("seed <> _main")
    rounds = stage(apart.groupBy(F.col("group").alias("_apart")).agg(F.ceil(F.sum("w") / block).cast("long").alias("rounds")), "join-rounds")
    # every set of the group meets every chunk of the sets outside its main part
    met = seeded.join(bounded(rounds), F.col("group") == F.col("_apart")).select(
        "id", "group", "seed", _chunk(1).alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rounds") - 1)).alias("other"))
    outside = apart.join(bounded(rounds), F.col("group") == F.col("_apart")).select(
        "id", "group", "seed", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"),
        _chunk(3, "rounds").alias("other"))
    last = _searched(texts, met.unionByName(outside).select("id", F.struct("group", "chunk", "other").alias("block"), "seed"))
    return components(known.unionByName(last), "id", "label")


def join_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: the id, n_shingles, component_id.

    Words are runs without blanks, lower-cased for A-Z; a set holds the distinct shingles of five words, or
    the whole text as one if it is shorter. component_id is the least id reachable by links of Jaccard
    similarity 0.8 or more. Null texts and texts without words: 0 shingles, their own component. Ids are
    integers; a null id takes part in no link and has no component. Rows with equal ids and texts agree;
    of rows with one id and several texts the links of each text count for the id, but for a text that a
    smaller id has as well, whose links are that id's. Other columns are not read; an
    empty table gives an empty result. Sets are compared by 64-bit hashes of their shingles.
    """
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text"))
    texts = rows.filter("id IS NOT NULL")
    sized = stage(_sets(rows, frequent_shingles(texts)), "join-sets")
    named = sized.filter("id IS NOT NULL")
    labels = _labels(texts, named, block)
    copies = named.filter("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("_least"), F.count(F.lit(1)).alias("_copies"))
    labelled = copies.join(labels.withColumnRenamed("id", "_id"), F.col("_least") == F.col("_id"), "left").select(
        "key", "_copies", F.coalesce("label", "_least").alias("_label"))
    per_key = stage(labelled, "join-labels")
    found = skew.attach(sized.select("id", "n", "key"), per_key, ["key"], F.col("id"), F.col("_copies"), {"_label": "component_id"})
    return found.select(F.col("id").alias(id_column), F.col("n").cast("long").alias("n_shingles"),
                        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
