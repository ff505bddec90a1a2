"""Pluggable model hooks: answer generation, tokenisation, name similarity.

Each hook is Arrow-batched; the callable given by the user is built once per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf


def predict(prompts: DataFrame, load: Callable[[], Callable[[list[str]], list[str]]],
            revision: int) -> DataFrame:
    """Run batch inference over ``prompts(record_id, question)`` -> predictions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer_fn = load()
        for batch in batches:
            yield pd.DataFrame(
                {
                    "revision": revision,
                    "record_id": batch["record_id"],
                    "answer": answer_fn(batch["question"].tolist()),
                }
            )

    return prompts.select("record_id", "question").mapInPandas(
        run, "revision bigint, record_id string, answer string"
    )


def tokenizer(load: Callable[[], Callable[[str], tuple[list[int], list[int]]]]):
    """Wrap ``text -> (ids, start offsets)`` as an expression returning struct<ids, starts>."""

    @pandas_udf("struct<ids:array<bigint>,starts:array<bigint>>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fn = load()
        for batch in batches:
            pairs = [fn(text) for text in batch]
            yield pd.DataFrame({"ids": [p[0] for p in pairs], "starts": [p[1] for p in pairs]})

    return encode


class _WordIds(dict):
    """``hash32`` of words (bytes), remembered up to a number of words."""

    def __missing__(self, word: bytes) -> int:
        number = int.from_bytes(hashlib.md5(word).digest()[:4], "big")
        if len(word) <= 64:
            if len(self) >= 100_000:
                self.clear()
            self[word] = number
        return number


def word_ids(prompt: Column, answer: Column, most: int) -> Column:
    """struct<ids, n_prompt>: ``hash32`` of the first ``most`` words of both texts, and the words of the first."""

    @F.arrow_udf("struct<ids:array<bigint>,n_prompt:int>")
    def encode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = _WordIds()
        for prompts, answers in batches:
            flat, ends, counts = [], [0], []
            for p, a in zip(prompts.to_pylist(), answers.to_pylist()):
                if p is None or a is None:
                    counts.append(None)
                else:
                    words = p.encode().split()
                    counts.append(len(words))
                    flat.extend(map(known.__getitem__, (words + a.encode().split())[:most]))
                ends.append(len(flat))
            missing = pa.array([n is None for n in counts], pa.bool_())
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int64)), mask=missing)
            yield pa.StructArray.from_arrays([ids, pa.array(counts, pa.int32())], names=["ids", "n_prompt"])

    return encode(prompt, answer)


def ratio_of(a: str, b: str) -> float:
    """``SequenceMatcher(None, a, b).ratio()``, by substring search where the matcher treats no character as popular."""
    if len(b) >= 200:
        return SequenceMatcher(None, a, b).ratio()
    return 2.0 * _matched(a, b) / (len(a) + len(b)) if a or b else 1.0


def _matched(a: str, b: str) -> int:
    """Characters in the longest common block, the first in a and then in b, and in those to either side of it."""
    best, at = 0, 0
    for i in range(len(a) if b else 0):
        while i + best < len(a) and a[i:i + best + 1] in b:
            best, at = best + 1, i
    if not best:
        return 0
    j = b.find(a[at:at + best])
    return best + _matched(a[:at], b[:j]) + _matched(a[at + best:], b[j + best:])


def similar_pairs(left: list[str], right: list[str], threshold: float, same: bool) -> Iterator[tuple[int, int, float]]:
    """(i, j, ratio) of the pairs of both lists from ``threshold`` up; of one list with itself (``same``) those with i < j.

    Matched blocks are a common subsequence, so its greatest length, found for all of ``right`` at once by bit
    vectors, bounds the ratio. Names beyond 63 characters are compared without the bound.
    """
    lengths = np.array([len(r) for r in right], np.int64)
    width = min(63, int(lengths.max(initial=0)))
    points = np.zeros((len(right), width), np.uint32)
    for j, r in enumerate(right):
        points[j, :min(len(r), width)] = np.frombuffer(r[:width].encode("utf-32-le", "surrogatepass"), np.uint32)
    known, codes = np.unique(points, return_inverse=True)
    codes = np.ascontiguousarray(codes.reshape(points.shape).T)
    place = {int(c): k for k, c in enumerate(known) if c}  # zero fills up
    for i, name in enumerate(left):
        rest = np.arange(len(right)) > i if same else np.ones(len(right), bool)
        if len(name) <= 63 and "\0" not in name:
            masks = np.zeros(len(known), np.uint64)
            for k, c in enumerate(name):
                if ord(c) in place:
                    masks[place[ord(c)]] |= np.uint64(1 << k)
            open_bits = np.full(len(right), (1 << len(name)) - 1, np.uint64)
            for row in codes:
                hit = open_bits & masks[row]
                open_bits = (open_bits + hit) | (open_bits - hit)
            common = len(name) - np.bitwise_count(open_bits & np.uint64((1 << len(name)) - 1)).astype(np.int64)
            rest &= (lengths > 63) | (2.0 * common >= threshold * (len(name) + lengths) - 1e-9)
        for j in np.flatnonzero(rest).tolist():
            a, b = min(name, right[j]), max(name, right[j])
            ratio = ratio_of(a, b)
            if ratio >= threshold:
                yield i, j, ratio


def name_ratio(a: Column, b: Column) -> Column:
    """difflib similarity ratio; argument order matters, callers pass the smaller name first."""

    @pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        # the matcher caches everything about its second sequence, so runs of equal
        # right-hand names are scored against one prepared matcher
        matcher, prepared, out = SequenceMatcher(None), None, []
        for x, y in zip(left, right):
            if y != prepared:
                matcher.set_seq2(y)
                prepared = y
            matcher.set_seq1(x)
            out.append(matcher.ratio())
        return pd.Series(out, dtype="float64")

    return ratio(F.least(a, b), F.greatest(a, b))
