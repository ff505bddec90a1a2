"""Byte pair encoding and decoding for vocabularies with word ends.

A word's bytes become a doubly linked list of symbols; a priority queue holds the rank of every
mergeable neighbour pair. The lowest rank merges first; entries whose pair has changed since they were
queued are stale and skipped. Decoding joins the vocabulary strings of the ids with blanks, as for
vocabulary files that name no decoder.

Versions of Unicode differ on younger characters. Characters of Unicode 3.2 are alike in all later ones;
stretches between blanks that hold a younger one are normalised and cut by the library's own rules.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

# fixed values of the vocabulary file's format: how it finds words, and which characters stand for bytes
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
BLANKS = regex.compile(r"\p{White_Space}+")
WORD_END = "</w>"
CACHE_BYTES = 64_000_000  # memory for remembered words, about
CACHE_LENGTH = 48         # characters of a remembered word at most
ENTRY_BYTES = 190         # of a remembered word beside its characters and ids


@lru_cache(maxsize=1)
def younger() -> tuple[re.Pattern, regex.Pattern]:
    """A character that Unicode 3.2 does not know; a stretch between blanks that holds one."""
    unknown = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.ucd_3_2_0.category(chr(c)) == "Cn"]
    edges = np.flatnonzero(np.diff(unknown) > 1)
    ranges = zip(np.take(unknown, [0, *(edges + 1)]), np.take(unknown, [*edges, -1]))
    some = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
    return re.compile(f"[{some}]"), regex.compile(rf"[^ ]*[{some}][^ ]*")


def byte_characters() -> list[str]:
    """The character for each byte: printable Latin-1 stands for itself, others from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class _Known(dict):
    """Ids by word; a word that is missing is merged, and kept if it is short."""

    def __init__(self, merged):
        super().__init__()
        self.merged, self.held = merged, 0

    def __missing__(self, word: str) -> bytes:
        ids = self.merged(word.encode())
        if len(word) <= CACHE_LENGTH:
            self[word] = ids
            self.held += ENTRY_BYTES + len(word) + len(ids)
        return ids


class Vocabulary:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        ids: dict[str, int] = model["vocab"]
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        names = ids | self.special
        self.strings = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.strings[i] = name
        characters = byte_characters()
        self.inner = [ids.get(c) for c in characters]
        self.final = [ids.get(c + WORD_END) for c in characters]
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.byte_of = {c: b for b, c in enumerate(characters)}
        library = Tokenizer.from_file(path)
        self.normalizer, self.cutter = library.normalizer, library.pre_tokenizer
        self.known = _Known(self.word)

    def merge(self, symbols: list[int]) -> list[int]:
        """Symbol ids of a word after all merges, lowest rank first, leftmost first among equals."""
        merges, last = self.merges, len(symbols) - 1
        queue = [(found[0], i) for i, pair in enumerate(pairwise(symbols)) if (found := merges.get(pair))]
        if not queue:
            return symbols
        heapify(queue)
        after = list(range(1, last + 2))
        before = list(range(-1, last))
        while queue:
            rank, left = heappop(queue)
            right = after[left]
            if symbols[left] < 0 or right > last:
                continue
            found = merges.get((symbols[left], symbols[right]))
            if found is None or found[0] != rank:
                continue  # stale
            symbols[left], symbols[right] = found[1], -1
            after[left] = onward = after[right]
            if onward <= last:
                before[onward] = left
                if found := merges.get((symbols[left], symbols[onward])):
                    heappush(queue, (found[0], left))
            if (previous := before[left]) >= 0 and (found := merges.get((symbols[previous], symbols[left]))):
                heappush(queue, (found[0], previous))
        return [s for s in symbols if s >= 0]

    def word(self, data: bytes) -> bytes:
        symbols = [self.inner[b] for b in data[:-1]]
        symbols.append(self.final[data[-1]])
        return array("I", self.merge([s for s in symbols if s is not None])).tobytes()

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        out = b"".join(map(self.known.__getitem__, WORDS.findall(BLANKS.sub(" ", text).replace("Σ", "σ").lower())))
        if self.known.held > CACHE_BYTES:
            self.known = _Known(self.word)
        return out

    def _young(self, text: str) -> bytes:
        words = self.cutter.pre_tokenize_str(self.normalizer.normalize_str(text))
        return b"".join(self.word(bytes(map(self.byte_of.__getitem__, w))) for w, _ in words)

    def _piece(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        young, stretch = younger()
        if text.isascii() or not young.search(text):
            return self._plain(text)
        out, at = [], 0
        for found in stretch.finditer(text):
            out += [self._plain(text[at:found.start()]), self._young(found[0])]
            at = found.end()
        return b"".join([*out, self._plain(text[at:])])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; none for null or empty."""
        if not text:
            return b""
        if self.special_pattern is None or not self.special_pattern.search(text):
            return self._piece(text)
        return b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else self._piece(p)
                        for p in self.special_pattern.split(text) if p)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.strings.__getitem__, array("I", ids)))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per Python worker and file."""
    return Vocabulary(path)


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and ``ids`` (binary, little-endian unsigned 32-bit integers).

    Null and empty texts have no ids. ``path`` names a vocabulary file that all executors have. Each row
    stands for itself, so ties and repeated rows need no rule; a text of any length is encoded whole.
    Other columns are not read.
    """
    return _mapped(docs, id_column, text_column, "ids binary", lambda v: lambda text: (v.encode(text),), path)


def decode_documents(encoded: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """One row per row of ``encoded``: the id and ``decoded``; null or empty ids give an empty text."""
    return _mapped(encoded, id_column, ids_column, "decoded string", lambda v: lambda ids: (v.decode(ids or b""),), path)


def encode_and_decode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, ``ids`` and ``decoded`` (the text decoded from the ids) in one pass, with one vocabulary a task."""
    def both(v: Vocabulary):
        def convert(text: str | None) -> tuple[bytes, str]:
            ids = v.encode(text)
            return ids, v.decode(ids)
        return convert

    return _mapped(docs, id_column, text_column, "ids binary, decoded string", both, path)


def _mapped(rows: DataFrame, id_column: str, column: str, results: str, method, path: str, chunk: int = 250) -> DataFrame:
    rows = rows.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{column}`").alias("_value"))
    kind, names = rows.schema["_id"].dataType.simpleString(), [r.split()[0] for r in results.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        convert, last, result = method(vocabulary(path)), None, None
        for batch in batches:
            for at in range(0, len(batch), chunk):
                part, out = batch.iloc[at:at + chunk], []
                for value in part["_value"]:
                    if result is None or value != last:  # a row that is taken several times stands in a run
                        last, result = value, convert(value)
                    out.append(result)
                yield pd.DataFrame({"_id": part["_id"].to_numpy()} | dict(zip(names, zip(*out))))

    return rows.mapInPandas(run, f"_id {kind}, {results}").withColumnRenamed("_id", id_column)
