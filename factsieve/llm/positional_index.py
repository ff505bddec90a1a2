"""Distributed positional inverted index, for decontamination against a benchmark.

The documents are cut into blocks of some ``BLOCK_WORDS`` words. A block's postings are one row: its distinct
terms (64-bit hashes, ascending), and for each term the ascending positions at which it stands in the
block's documents, laid end to end. Every word of every document has its posting. The index is a table in
the shared folder, written once; no posting is shuffled, and lost tasks are simply run again.

Test phrases search all blocks, some ``PHRASES`` at a time, so neither the broadcast nor a task grows with
their number. In a block a phrase starts from the list of its rarest term there; these candidates are
intersected with the lists of its other terms, next rarest first, each adjusted by the term's offset. All
phrases of a pass are looked up together. What remains are exact occurrences (up to equal 64-bit hashes).
``near_matches`` finds the spans that hold all terms of a phrase in any order instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from factsieve.llm.common import new_folder, or_empty, stage

BLOCK_WORDS = 400_000    # words of a block; a longer document is a block of its own
PHRASES = 20_000         # phrases in one pass over the index, about
CANDIDATES = 1_000_000   # candidate positions looked up at once
CACHE_TERMS = 500_000    # hashes that a worker remembers
#: A-Z become a-z; digits, a-z and non-ASCII bytes stay; all others part words
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MATCHES = "block long, doc int, item string, start long, end long"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def words(text: str | None) -> list[bytes]:
    """Words of digits, letters and non-ASCII characters as UTF-8, A-Z in lower case."""
    return text.encode().translate(LETTERS).split() if text else []


def invert(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, upto, positions): term i stands at positions[upto[i - 1]:upto[i]], ascending."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    last = np.flatnonzero(np.append(ordered[1:] != ordered[:-1], True)[:len(ordered)])
    return ordered[last], (last + 1).astype(np.int32), order.astype(np.int32)


def build(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The index of all rows, a written table: block, ids and counts (words) of its documents, postings.

    Documents are known by block and place, so null and repeated ids, ties and repeated rows are as good
    as any. Null and empty texts have no words; texts of any length are indexed whole (up to 2^31 words).
    An empty table has an empty index. Other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    schema = f"block long, ids array<{rows.schema['id'].dataType.simpleString()}>, counts array<int>, terms binary, upto binary, steps binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, made = _Hashes(), TaskContext.get().partitionId(), 0
        ids: list[pa.Scalar] = []
        pieces: list[np.ndarray] = []
        held, kind = 0, None

        def block() -> pa.RecordBatch:
            terms, upto, positions = invert(np.concatenate(pieces))
            steps = np.diff(positions, prepend=np.int32(0))  # small numbers, for the compression of the file
            return pa.record_batch([
                pa.array([(part << 32) + made]), pa.array([ids], pa.list_(kind)), pa.array([[len(p) for p in pieces]], pa.list_(pa.int32())),
                *(pa.array([x.tobytes()], pa.binary()) for x in (terms, upto, steps))], names=["block", "ids", "counts", "terms", "upto", "steps"])

        for batch in batches:
            kind = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = words(text.as_py())
                if pieces and held + len(found) > BLOCK_WORDS:
                    yield block()
                    ids, pieces, held, made = [], [], 0, made + 1
                ids.append(key)
                pieces.append(np.fromiter(map(known.__getitem__, found), np.uint64, len(found)))
                held += len(found)
                if len(known) > CACHE_TERMS:
                    known.clear()
        if pieces:
            yield block()

    folder = new_folder(docs.sparkSession, "positional-index")
    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(schema).parquet(folder)


def documents(index: DataFrame) -> DataFrame:
    """(block, doc, id, n_words) of every indexed row."""
    return index.select("block", F.posexplode(F.arrays_zip("ids", "counts")).alias("doc", "d")).select(
        "block", "doc", F.col("d.ids").alias("id"), F.col("d.counts").cast("long").alias("n_words"))


def phrases(items: DataFrame, width: int | None, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item, terms): every run of ``width`` words of each item's text, or its whole text if it has fewer words
    or ``width`` is None. Items without words have none; a null id is an empty string; rows with one id
    are one item with the runs of all its texts."""
    rows = items.select(or_empty(F.col(f"`{id_column}`").cast("string")).alias("item"), F.col(f"`{text_column}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words(text.as_py())], np.uint64).view(np.int64)
                size = min(width or len(hashes), len(hashes))
                if size:
                    cut = np.lib.stride_tricks.sliding_window_view(hashes, size)
                    ends = np.arange(0, cut.size + 1, size, dtype=np.int32)
                    yield pa.record_batch([pa.array([item] * len(cut)), pa.ListArray.from_arrays(ends, cut.ravel())], names=["item", "terms"])

    return rows.mapInArrow(run, "item string, terms array<long>").distinct()


class Block:
    """Postings of one row of the index."""

    def __init__(self, counts: pa.ListScalar, terms: pa.BinaryScalar, upto: pa.BinaryScalar, steps: pa.BinaryScalar):
        self.starts = np.concatenate([[0], np.cumsum(counts.values.to_numpy(), dtype=np.int64)])  # of the documents
        self.terms = np.frombuffer(terms.as_buffer(), np.uint64)
        self.upto = np.concatenate([[0], np.frombuffer(upto.as_buffer(), np.int32)])
        self.positions = np.cumsum(np.frombuffer(steps.as_buffer(), np.int32), dtype=np.int64)

    def lists(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, length) of each wanted term's posting list; length 0 for terms that the block lacks."""
        at = np.minimum(np.searchsorted(self.terms, wanted), max(len(self.terms) - 1, 0))
        there = self.terms[at] == wanted if len(self.terms) else np.zeros(len(wanted), bool)
        return self.upto[at], np.where(there, self.upto[np.minimum(at + 1, len(self.upto) - 1)] - self.upto[at], 0)

    def gathered(self, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The given lists end to end: (number of the list, position)."""
        which = np.repeat(np.arange(len(first)), length)
        return which, self.positions[np.arange(len(which)) - np.repeat(np.cumsum(length) - length, length) + first[which]]

    def place(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The document of each span, and whether it holds all of the span."""
        doc = np.searchsorted(self.starts, start, side="right") - 1
        return doc, end <= self.starts[np.minimum(doc + 1, len(self.starts) - 1)]


@dataclass
class Phrases:
    """A bounded number of phrases: ``terms[i, j]`` numbers a word of ``vocabulary``, -1 past the phrase's end."""

    items: np.ndarray
    vocabulary: np.ndarray
    terms: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Phrases:
        lists = table.column("terms").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        vocabulary, number = np.unique(lists.flatten().to_numpy().view(np.uint64), return_inverse=True)
        terms = np.full((len(sizes), max(sizes, default=0)), -1, np.int32)
        terms[np.arange(terms.shape[1]) < sizes[:, None]] = number
        return cls(np.array(table.column("item").to_pylist(), object), vocabulary, terms)


def occurrences(block: Block, asked: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, start, end) of every exact occurrence in the block."""
    first, length = block.lists(asked.vocabulary)
    present = np.append(length > 0, True)  # the last one serves -1
    alive = np.flatnonzero(present[asked.terms].all(axis=1))
    which, at = block.gathered(first, length)
    postings = which << 32 | at  # ascending
    rare_first = np.argsort(np.append(length, np.iinfo(np.int32).max)[asked.terms[alive]], axis=1, kind="stable")
    ranked = np.take_along_axis(asked.terms[alive], rare_first, axis=1)
    found = [np.empty((3, 0), np.int64)]
    upto = np.cumsum(length[ranked[:, 0]]) if len(alive) else np.empty(0, np.int64)
    for some in np.split(np.arange(len(alive)), np.searchsorted(upto, np.arange(CANDIDATES, upto[-1] if len(upto) else 0, CANDIDATES))):
        pivot = ranked[some, 0]
        which, at = block.gathered(first[pivot], length[pivot])
        phrase, start = some[which], at - rare_first[some[which], 0]
        for rank in range(1, ranked.shape[1]):
            term = ranked[phrase, rank]
            need = term.astype(np.int64) << 32 | start + rare_first[phrase, rank]
            there = (term < 0) | (start >= 0) & (postings[np.minimum(np.searchsorted(postings, need), len(postings) - 1)] == need)
            phrase, start = phrase[there], start[there]
        end = start + (ranked[phrase] >= 0).sum(axis=1)
        found.append(np.stack([alive[phrase], start, end])[:, start >= 0])
    phrase, start, end = np.concatenate(found, axis=1)
    whole = block.place(start, end)[1]
    return phrase[whole], start[whole], end[whole]


def nearby(block: Block, asked: Phrases, within: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, start, end) of the least spans of at most ``within`` words that hold all terms of a phrase."""
    first, length = block.lists(asked.vocabulary)
    found = [np.empty((3, 0), np.int64)]
    for phrase in np.flatnonzero(np.append(length > 0, True)[asked.terms].all(axis=1)):
        terms = np.unique(asked.terms[phrase][asked.terms[phrase] >= 0])
        terms = terms[np.argsort(length[terms], kind="stable")]  # rarest first
        lists = [block.positions[first[t]:first[t] + length[t]] for t in terms]
        pivots = lists[0]
        start = np.unique(np.concatenate([p[np.abs(pivots[np.minimum(np.searchsorted(pivots, p), len(pivots) - 1)] - p) < within] for p in lists]))
        end = start
        for positions in lists:
            at = np.searchsorted(positions, start)
            on = at < len(positions)
            following = positions[np.minimum(at, len(positions) - 1)]
            on &= following - start < within
            start, end = start[on], np.maximum(end[on], following[on])
        if len(start):
            least = np.append(end[1:] != end[:-1], True)  # of spans with one end the shortest
            found.append(np.stack([np.full(least.sum(), phrase), start[least], end[least] + 1]))
    phrase, start, end = np.concatenate(found, axis=1)
    whole = block.place(start, end)[1]
    return phrase[whole], start[whole], end[whole]


def _runs(block: Block, items: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, item number, start, end) with overlapping and touching spans of an item in a document merged."""
    doc, _ = block.place(start, end)
    order = np.lexsort((start, items, doc))
    doc, items, start, end = doc[order], items[order], start[order], end[order]
    group = np.cumsum(np.append(False, (doc[1:] != doc[:-1]) | (items[1:] != items[:-1])))
    reach = np.maximum.accumulate(end + group * (block.starts[-1] + 1)) - group * (block.starts[-1] + 1)
    opens = np.append(True, (group[1:] != group[:-1]) | (start[1:] > reach[:-1]))
    at = np.flatnonzero(opens)
    first = block.starts[doc[at]]
    return doc[at], items[at], start[at] - first, reach[np.append(at[1:], len(doc)) - 1] - first


def _search(index: DataFrame, asked: DataFrame, find: Callable[[Block, Phrases], tuple[np.ndarray, ...]]) -> DataFrame:
    spark, asked = index.sparkSession, stage(asked, "phrases")
    passes = -(-asked.count() // PHRASES)
    if not passes:
        return spark.createDataFrame([], MATCHES)
    out = None
    for k in range(passes):
        some = asked.filter(F.pmod(F.xxhash64("item", "terms"), F.lit(passes)) == k)
        sent = spark.sparkContext.broadcast(Phrases.of(some.toArrow()))  # about PHRASES rows

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, number = np.unique(sent.value.items, return_inverse=True)
            for batch in batches:
                for name, *columns in zip(*batch.columns):
                    block = Block(*columns)
                    phrase, start, end = find(block, sent.value)
                    if len(phrase):
                        doc, item, start, end = _runs(block, number[phrase], start, end)
                        yield pa.record_batch([pa.array([name.as_py()] * len(doc)), pa.array(doc.astype(np.int32)), pa.array(names[item], pa.string()),
                                               pa.array(start), pa.array(end)], names=["block", "doc", "item", "start", "end"])

        found = index.select("block", "counts", "terms", "upto", "steps").mapInArrow(run, MATCHES)
        out = found if out is None else out.unionByName(found)
    return out


def phrase_matches(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(block, doc, item, start, end): the words of a document inside exact occurrences of an item's phrases,
    as runs [start, end). Runs of one item from different passes may touch or overlap."""
    return _search(index, asked, occurrences)


def near_matches(index: DataFrame, asked: DataFrame, within: int) -> DataFrame:
    """The same for least spans of at most ``within`` words that hold all distinct words of a phrase."""
    return _search(index, asked, lambda block, some: nearby(block, some, within))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_column: str = "doc_id", text_column: str = "text",
                  item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit (words inside exact occurrences of ``width`` consecutive
    item words; an item of fewer words is searched as a whole), items (ids as strings, ascending).

    Null and empty texts have no words and no hits, on either side. Repeated and tied rows each get their
    row; a benchmark id on several rows is one item, a null one an empty string. An empty benchmark hits
    nothing, an empty table gives none. No other column is read.
    """
    index = build(docs, id_column, text_column)
    runs = phrase_matches(index, phrases(benchmark, width, item_column, item_text))
    before = Window.partitionBy("block", "doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    hits = runs.withColumn("new", new).groupBy("block", "doc").agg(F.sum("new").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    return documents(index).join(stage(hits, "hits"), ["block", "doc"], "left").select(
        F.col("id").alias(id_column), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))
