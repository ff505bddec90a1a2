"""Minimax contiguous partition of documents into shards.

Atomic groups (equal texts) stand in the order of their text's SHA-256. The smallest capacity is
searched such that a greedy walk over the ordered group sizes fills at most ``shards`` shards, where a
group above the capacity has a shard of its own. The runs of groups between such shards are then cut
anew in the same way, so that one large group does not set the size of all others. The largest shard is
as small as any contiguous cut allows.

The walk never sees all groups: it runs over cells, runs of groups whose digests share a prefix,
with their sums. Bounds of the capacity and of every cut follow from the cells; only cells in which
a cut may fall are refined, by two more hex digits at a time, until every cut lies between groups.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from factsieve.llm.common import Sealed, bounded, or_empty, stage

DIGITS = 64  # hex digits of a digest


class Cells:
    """Ordered runs of groups: digest prefix, bytes, number of groups, largest group."""

    def __init__(self, rows: list[tuple[str, int, int, int]]):
        self.rows = sorted(rows)
        self.ends = list(accumulate(r[1] for r in self.rows))
        self.total = self.ends[-1] if self.ends else 0

    def step(self, start: int, capacity: int, careful: bool) -> int:
        """Where the shard that begins at byte ``start`` ends: at least (careful) or at most there."""
        reach = start + capacity
        if reach >= self.total:
            return self.total
        at = bisect_right(self.ends, reach)  # the cell in which reach lies
        low = self.ends[at - 1] if at else 0
        _, _, groups, largest = self.rows[at]
        if groups == 1:
            return low if low > start else self.ends[at]
        return max(low, reach - largest) if careful else reach

    def walk(self, capacity: int, shards: int, careful: bool) -> list[int]:
        cuts, at = [], 0
        for _ in range(shards):
            at = self.step(at, capacity, careful)
            cuts.append(at)
        return cuts

    def smallest(self, shards: int, low: int, high: int, careful: bool) -> int:
        while low < high:
            middle = (low + high) // 2
            if self.walk(middle, shards, careful)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def open(self, shards: int, low: int, high: int) -> set[int]:
        """Cells of several groups in which a cut may fall for a capacity between low and high."""
        found = set()
        for first, last in zip(self.walk(low, shards, True), self.walk(high, shards, False)):
            for i in range(bisect_right(self.ends, max(0, first - 1)), min(bisect_right(self.ends, last), len(self.rows) - 1) + 1):
                if self.rows[i][2] > 1:
                    found.add(i)
        return found


def _cells(groups: DataFrame, digits: int) -> list[tuple[str, int, int, int]]:
    return [tuple(r) for r in groups.groupBy(F.substring("_sha", 1, digits).alias("p")).agg(
        F.sum("_bytes"), F.count(F.lit(1)), F.max("_bytes")).collect()]


def _refined(groups: DataFrame, cells: Cells, chosen: set[int]) -> Cells:
    """The chosen cells by two more hex digits."""
    by_length: dict[int, list[str]] = {}
    for i in sorted(chosen):
        by_length.setdefault(len(cells.rows[i][0]), []).append(cells.rows[i][0])
    rows = [r for i, r in enumerate(cells.rows) if i not in chosen]
    for length, some in by_length.items():
        rows += _cells(groups.filter(F.substring("_sha", 1, length).isin(some)), min(DIGITS, length + 2))
    return Cells(rows)


def _least_capacity(largest: list[int], total: int, shards: int) -> int:
    """A bound from below, where groups (descending) above the mean of the rest have shards of their own."""
    for size in largest:
        if shards == 1 or size * shards <= total:
            break
        total, shards = total - size, shards - 1
    return -(-total // shards)


def _starts(groups: DataFrame, cells: Cells, shards: int) -> tuple[int, list[str]]:
    """(smallest capacity, first digest of every shard that is not empty) for the groups of ``cells``."""
    top = [r[0] for r in groups.orderBy(F.desc("_bytes")).limit(shards).select("_bytes").collect()]
    low, high = _least_capacity(top, cells.total, shards), cells.total
    while hot := {i for i, r in enumerate(cells.rows) if r[2] > 1 and r[3] > low}:
        cells = _refined(groups, cells, hot)
    while True:
        high = cells.smallest(shards, low, high, True)
        low = cells.smallest(shards, low, high, False)
        inside = cells.open(shards, low, high)
        if not inside:
            break
        cells = _refined(groups, cells, inside)
    cuts = [0]
    while cuts[-1] < cells.total:
        cuts.append(cells.step(cuts[-1], low, False))
    first = [bisect_right(cells.ends, at) for at in cuts[:-1]] + [len(cells.rows)]
    if max(r[3] for r in cells.rows) <= low:
        return low, [cells.rows[i][0] for i in first[:-1]]
    # runs of shards between groups that have one to themselves: [first cell, end cell, shards, alone]
    runs: list[list] = []
    for i, end in zip(first, first[1:]):
        alone = end == i + 1 and cells.rows[i][3] > low
        if alone or not runs or runs[-1][3]:
            runs.append([i, end, 1, alone])
        else:
            runs[-1][1:3] = end, runs[-1][2] + 1
    for _ in range(shards - len(cuts) + 1):
        wide = [r for r in runs if r[2] < sum(c[2] for c in cells.rows[r[0]:r[1]])]
        if wide:
            max(wide, key=lambda r: sum(c[1] for c in cells.rows[r[0]:r[1]]) / r[2])[2] += 1
    found = []
    for i, end, n, alone in runs:
        part = groups.filter(F.col("_sha") >= cells.rows[i][0])
        if end < len(cells.rows):
            part = part.filter(F.col("_sha") < cells.rows[end][0])
        found += [cells.rows[i][0]] if n == 1 else _starts(part, Cells(cells.rows[i:end]), n)[1]
    return max(r[3] for r in cells.rows), found


def cut_points(groups: DataFrame, shards: int, first_digits: int = 4) -> tuple[int, list[str]]:
    """(smallest capacity, first digest of shards 1, 2, ...) for (_sha, _bytes) rows, one per group.

    The driver holds 16 ** first_digits sums and, a round, 256 more for each cell that may hold a cut or
    holds a group larger than a shard.
    """
    cells = Cells(_cells(groups, first_digits))
    if not cells.rows:
        return 0, []
    capacity, starts = _starts(groups, cells, shards)
    return capacity, starts[1:]


def shard_of(digest: Column, firsts: list[str]) -> Column:
    shard = F.lit(0)
    for i, first in enumerate(firsts):
        shard = F.when(digest >= first, i + 1).otherwise(shard)
    return shard


def assign_shards(docs: DataFrame, shards: int = 24, id_column: str = "doc_id", text_column: str = "text",
                  overhead: int = 8) -> DataFrame:
    """All rows and columns of ``docs`` plus size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 bytes of the text (null: 0) plus ``overhead``. Equal texts (null equals empty)
    share a shard, whatever their number, so the largest shard holds at least the largest group. Slots
    count from 0 within a shard, in the order of digest and id; repeated rows get slots of their own, in
    any order. Fewer groups than shards leave shards empty; an empty table gives an empty result.
    Result names replace columns of the same name.
    """
    sealed = Sealed(docs)
    text = or_empty(sealed.col(text_column))
    rows = sealed.rows.withColumns({"_bytes": F.octet_length(text).cast("long") + overhead, "_sha": F.sha2(text.cast("binary"), 256),
                                    "_crc": F.crc32(text.cast("binary")), "_id": sealed.col(id_column)})
    # ranks: sorted ranges of (digest, id), which also split a large group, numbered within their range
    ranked = stage(rows.repartitionByRange("_sha", "_id").sortWithinPartitions("_sha", "_id").withColumn(
        "_at", F.monotonically_increasing_id()), "shard-ranks")
    groups = ranked.groupBy("_sha").agg(F.sum("_bytes").alias("_bytes"))
    _, firsts = cut_points(groups, shards)
    placed = ranked.withColumns({"_shard": shard_of(F.col("_sha"), firsts), "_range": F.shiftrightunsigned("_at", 33)})
    counts = placed.groupBy("_range", "_shard").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("_shard").orderBy("_range")
    base = stage(counts.select(F.col("_range").alias("_r"), F.col("_shard").alias("_s"),
                               (F.sum("_n").over(earlier) - F.col("_n") - F.col("_first")).alias("_base")), "shard-bases")
    joined = placed.join(bounded(base), (F.col("_range") == F.col("_r")) & (F.col("_shard") == F.col("_s")))
    return sealed.opened(joined, size=F.col("_bytes"), text_crc32=F.col("_crc"), law=F.lit("bytes"), shard=F.col("_shard"),
                         slot=F.col("_at") + F.col("_base"), grown_shard=F.lit(None).cast("int"))
