"""Prefix trie of conversations, built by range partitions around a splitter skeleton.

A conversation is a path: 20 bytes a turn, a digest of role and text and the number of words. Paths are
grouped (copies of a conversation become a few rows), cut into ranges by splitters from a sample, and
sorted. A node whose members lie on both sides of a splitter is a prefix of that splitter, so the trie of
the splitters, the skeleton, is all that ranges have to share: it is broadcast, every range finishes all
other nodes on its own in one pass over its sorted paths, and for skeleton nodes it yields partial sums
that one grouped reduction adds up. No text is gathered; a path is one row.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from factsieve.llm.common import WORD, bounded, or_empty, stage

ELEMENT = 20                   # bytes of a turn: 16 of its digest, 4 of its number of words
RANGE_TURNS = 200_000          # turns of a range, about; what a task holds at most
SAMPLES = 16                   # sampled paths for each splitter
SKELETON_BYTES = 16_000_000    # bound on the splitters together
COPIES = 16                    # ids of equal paths that differ in their last 16 bits only share a row
NO_ENDS = hashlib.sha256().hexdigest()
ROWS = 50_000                  # rows of a batch that a range hands out
NODE = ("splitter int, depth int, conv long, parent long, parent_splitter int, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string")


def paths(turns: DataFrame, conv_column: str = "conv_id", order_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """(conv, path): the turns of each conversation in ascending order, null first, ties by digest.

    Null roles and texts are empty. Rows of a null conversation belong to none and are left out.
    """
    conv, role, text = F.col(f"`{conv_column}`").cast("long"), or_empty(F.col(f"`{role_column}`")), or_empty(F.col(f"`{text_column}`"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)
    n_words = F.lpad(F.lower(F.hex(F.regexp_count(text, F.lit(WORD)).cast("long"))), 8, "0")
    place = F.col(f"`{order_column}`")
    rows = turns.select(conv.alias("conv"), F.struct(place.isNotNull().alias("known"), place.alias("place"), F.concat(digest, n_words).alias("turn")).alias("t"))
    ordered = rows.filter("conv IS NOT NULL").groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return ordered.select("conv", F.unhex(F.array_join("turns.turn", "")).alias("path"))


def with_shared_heads(paths: DataFrame, base: Column, n_shared: Column, most: int) -> DataFrame:
    """Every conversation begins with the first ``n_shared`` (at most ``most``) turns of conversation ``base``
    in place of its own: all of them if it has fewer, none if it doesn't exist."""
    heads = paths.select(F.col("conv").alias("_base"), F.substring("path", 1, most * ELEMENT).alias("_head"))
    joined = paths.withColumns({"_of": base, "_n": (n_shared * ELEMENT).cast("int")}).join(heads, F.col("_of") == F.col("_base"), "left")
    own = F.substring(F.col("path"), F.col("_n") + 1, F.length("path"))
    return joined.select("conv", F.concat(F.coalesce(F.substring(F.col("_head"), F.lit(1), F.col("_n")), F.lit(b"")), own).alias("path"))


def common(a: bytes, b: bytes) -> int:
    """Number of leading turns that two paths share."""
    low, high = 0, min(len(a), len(b)) // ELEMENT
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low * ELEMENT:middle * ELEMENT] == b[low * ELEMENT:middle * ELEMENT] else (low, middle - 1)
    return low


class Skeleton:
    """The trie of the splitters. The first splitter is the empty path, so the root is a node of it; a node is
    named (number of the first splitter that passes it, depth)."""

    def __init__(self, sample: list[bytes]):
        self.splitters = [b""]
        for path in sample:  # ascending; the shortest prefix that is still beyond the last splitter
            if path > self.splitters[-1]:
                self.splitters.append(path[:(common(self.splitters[-1], path) + 1) * ELEMENT])
        self.first = [[0]]
        for i, (a, b) in enumerate(pairwise(self.splitters), start=1):
            same = common(a, b)
            self.first.append(self.first[-1][:same + 1] + [i] * (len(b) // ELEMENT - same))

    def nodes(self) -> list[tuple[int, int, int | None, int, int]]:
        """(splitter, depth, splitter of the parent, skeleton children, words of all skeleton nodes below and itself)."""
        found: dict[tuple[int, int], list] = {}
        for i, names in enumerate(self.first):
            for depth, name in enumerate(names):
                if name == i and (i or not depth):
                    words = int.from_bytes(self.splitters[i][depth * ELEMENT - 4:depth * ELEMENT], "big") if depth else 0
                    found[i, depth] = [names[depth - 1] if depth else None, 0, words]
        for (i, depth), (parent, _, words) in sorted(found.items(), key=lambda x: -x[0][1]):
            if parent is not None:
                found[parent, depth - 1][1] += 1
                found[parent, depth - 1][2] += words
        return [(*key, *values) for key, values in found.items()]

    def ancestors(self) -> list[tuple[int, int, int, int]]:
        """(splitter, depth) of each skeleton leaf with the (splitter, depth) of every node on its path, itself included."""
        parents = {(p, d - 1) for _, d, p, _, _ in self.nodes() if p is not None}
        return [(i, depth, names[d], d) for i, names in enumerate(self.first)
                for depth in [len(names) - 1] if names[depth] == i and (i, depth) not in parents for d in range(depth + 1)]


class _Node:
    __slots__ = ("depth", "splitter", "words", "n", "least", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, depth: int, splitter: int | None, words: int):
        self.depth, self.splitter, self.words = depth, splitter, words
        self.n = self.children = self.leaves = self.saved = 0
        self.least, self.ends, self.waiting = None, None, []


def _close(node: _Node, parent: _Node | None, out: list[tuple]) -> None:
    """Finish a node: its row goes out or, until the parent's least member is known, waits there."""
    inner = node.splitter is None
    ends = node.ends.hexdigest() if node.ends else NO_ENDS if inner else None
    leaves = node.leaves + (inner and not node.children)
    saved = node.saved + (node.n - inner) * node.words
    row = (node.splitter, node.depth, node.least, None, None, node.n, node.children, leaves, saved, ends)
    out.extend((*w[:3], node.least, *w[4:]) for w in node.waiting)
    if not inner:
        out.append(row)
    elif parent.splitter is None:
        parent.waiting.append(row)
    else:
        out.append((*row[:4], parent.splitter, *row[5:]))
    if parent:
        parent.n += node.n
        parent.least = node.least if parent.least is None else min(parent.least, node.least)
        parent.children += inner
        parent.leaves += leaves
        parent.saved += saved


def range_nodes(rows: Iterator[tuple[int, bytes, int, int, str]], skeleton: Skeleton) -> Iterator[list[tuple]]:
    """Node rows of the ranges whose (range, path, n, least, ids) come in ascending order; skeleton nodes as partial sums."""
    stack: list[_Node] = []
    out: list[tuple] = []
    now, before, left, right = None, b"", b"", b""

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            _close(node, stack[-1] if stack else None, out)

    for part, path, n, least, ids in rows:
        if part != now:
            close_to(0)
            now, before = part, b""
            left = skeleton.splitters[part]
            right = skeleton.splitters[part + 1] if part + 1 < len(skeleton.splitters) else b""
            stack.append(_Node(0, 0, 0))
        same = common(before, path)
        close_to(same + 1)
        on_left, on_right = common(path, left), common(path, right)
        for depth in range(same + 1, len(path) // ELEMENT + 1):
            splitter = skeleton.first[part][depth] if depth <= on_left else skeleton.first[part + 1][depth] if depth <= on_right else None
            stack.append(_Node(depth, splitter, int.from_bytes(path[depth * ELEMENT - 4:depth * ELEMENT], "big")))
        node = stack[-1]
        node.n += n
        node.least = least if node.least is None else min(node.least, least)
        if node.ends:
            node.ends.update(b"," + ids.encode())
        else:
            node.ends = hashlib.sha256(ids.encode())
        before = path
        if len(out) >= ROWS:
            yield out
            out = []
    close_to(0)
    if out:
        yield out


def _sampled(parts: DataFrame, n_splitters: int) -> list[bytes]:
    """Ascending paths at even places of a sample of ``SAMPLES`` a splitter: at most ``n_splitters`` rows of at most
    ``SKELETON_BYTES`` together. The sample decides how even the ranges are, nothing else."""
    most = max(1, SKELETON_BYTES // ELEMENT // n_splitters) * ELEMENT
    sample = parts.select(F.substring("path", 1, most).alias("path"), F.xxhash64("path", "ids").alias("h")).orderBy("h").limit(SAMPLES * n_splitters)
    place = F.row_number().over(Window.orderBy("path"))  # of the bounded sample
    return [bytes(r.path) for r in sample.withColumn("place", place).filter(F.col("place") % SAMPLES == 0).orderBy("place").select("path").collect()]


def trie(conversations: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """One row per node of the trie of (conv, path) rows, each conversation once:

    conv (least member), depth, parent (least member of the parent; null for the root), n_convs (members),
    n_children, n_leaves (childless nodes of the subtree), saved_tokens (sum over the subtree of members but
    one times words of the last turn), ends_sha256 (of the ascending comma-joined members that end here).

    Equal paths share their nodes; an empty path is a member of the root alone; a path of any length is
    used whole (one row, 20 bytes a turn). No conversations, no nodes, not even a root. As sha256 is
    sequential, one task digests the ids of all copies of one conversation, as joined runs of ids.
    """
    spark = conversations.sparkSession
    rows = conversations.groupBy("path", F.shiftright("conv", COPIES).alias("run")).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv").alias("least"),
        F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    parts = stage(rows, "paths")
    turns = parts.agg(F.sum(F.length("path"))).first()[0]
    wanted = n_ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(turns or 0) // ELEMENT // RANGE_TURNS))
    skeleton = Skeleton(_sampled(parts, wanted))
    sent = spark.sparkContext.broadcast(skeleton)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters = sent.value.splitters
        for batch in batches:
            part = pa.array([bisect_right(splitters, p) - 1 for p in batch.column(0).to_pylist()], pa.int32())
            yield pa.record_batch([part, *batch.columns], names=["part", *batch.schema.names])

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("part", "path", "n", "least", "ids"))))
        for found in range_nodes(rows, sent.value):
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*found), kinds)], names)

    names = [c.split()[0] for c in NODE.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in NODE.split(", ")]
    placed = parts.select("path", "run", "n", "least", "ids").mapInArrow(ranged, "part int, path binary, run long, n long, least long, ids string")
    found = stage(placed.repartitionById(len(skeleton.splitters), F.col("part")).sortWithinPartitions("part", "path", "run").mapInArrow(finished, NODE), "trie")

    shape = spark.createDataFrame(skeleton.nodes(), "splitter int, depth int, up int, inner int, words long")
    sums = found.filter("splitter IS NOT NULL").groupBy("splitter", "depth").agg(
        F.min("conv").alias("conv"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("outer"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("ends_sha256").alias("ends"))
    joined = stage(sums.join(shape, ["splitter", "depth"]).withColumn("n_children", F.col("outer") + F.col("inner")), "skeleton")
    above = spark.createDataFrame(skeleton.ancestors(), "_splitter int, _depth int, splitter int, depth int")
    childless = joined.filter("n_children = 0").select(F.col("splitter").alias("_splitter"), F.col("depth").alias("_depth"))
    ends = above.join(childless, ["_splitter", "_depth"]).groupBy("splitter", "depth").agg(F.count(F.lit(1)).alias("ending"))
    parent = bounded(joined.select(F.col("splitter").alias("_splitter"), F.col("depth").alias("_depth"), F.col("conv").alias("_conv")))
    skeletal = joined.join(ends, ["splitter", "depth"], "left").join(
        parent, (F.col("up") == F.col("_splitter")) & (F.col("depth") - 1 == F.col("_depth")), "left").select(
        "conv", "depth", F.col("_conv").alias("parent"), "n_convs", "n_children", (F.col("leaves") + F.coalesce("ending", F.lit(0))).alias("n_leaves"),
        (F.col("saved") - F.col("words")).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))
    inside = found.filter("splitter IS NULL").join(
        parent, (F.col("parent_splitter") == F.col("_splitter")) & (F.col("depth") - 1 == F.col("_depth")), "left").select(
        "conv", "depth", F.coalesce("parent", "_conv").alias("parent"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return inside.unionByName(skeletal)
