"""Token ids in Arrow stream files of equal-length sequences.

Documents stand in ascending order of their id, each followed by an end id, and are packed without gaps
into sequences of ``length`` ids. A file holds one range of documents as an Arrow stream: record batches
of fixed-size lists, ``ids`` and ``mask`` (false where the last sequence of a file is padded). Memory
mapping the file gives sequences and masks without a copy. A second stream file lists its documents
(id, first position, number of ids), and a manifest in Parquet lists the files.

Tasks write files under names of their own, so a repeated or lost task leaves at most a file that the
manifest doesn't list.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from factsieve.llm.bpe import byte_characters

LENGTH = 2048          # ids in a sequence
BATCH_SEQUENCES = 64   # sequences in a record batch
FILE_BYTES = 256 << 20 # text of a file, about; more text makes more files, not larger ones
CACHE_WORDS, CACHE_LENGTH = 1_000_000, 48  # remembered words of a worker, characters of each at most
WORD_EDGE = re.compile(r"(?<=\S) (?=\S)")
# fixed values of byte-level vocabulary files: how they cut words (here for plain characters only, on which all
# versions of Unicode agree), and the characters that stand for bytes
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
PLAIN_PIECE = re.compile(rf"[!-~{LATIN}](?:[\n!-~{LATIN}]*[!-~{LATIN}])?")
PLAIN_WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LATIN}]+| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+")
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
BYTE_CHARACTERS = dict(enumerate(byte_characters()))
BLANK = BYTE_CHARACTERS[ord(" ")]
MANIFEST = "part int, file string, documents string, n_docs long, n_tokens long, n_sequences long"


class _Ids(dict):
    """Ids of words by the library's model, kept for words of at most CACHE_LENGTH characters."""

    def __init__(self, tokenizer, kind):
        super().__init__()
        self.tokenize, self.code = tokenizer.model.tokenize, np.dtype(kind).char

    def __missing__(self, word: str) -> bytes:
        plain = word.isascii() and word[1:].isalpha() and word[0] == " "
        symbols = BLANK + word[1:] if plain else word.encode().decode("latin-1").translate(BYTE_CHARACTERS)
        ids = array(self.code, [t.id for t in self.tokenize(symbols)]).tobytes()
        if len(word) <= CACHE_LENGTH:
            self[word] = ids
        return ids


class CachedTokenizer:
    """Encodes with the tokenizers library, each new word once.

    Byte-level vocabularies cut words before a single blank between two non-blanks, so a text's ids are
    those of its pieces between such blanks, one after the other. A new piece of plain characters is cut
    into words here and the library's model encodes those not seen yet; any other piece goes through the
    whole library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        with open(path, encoding="utf-8") as file:
            shape = json.load(file)
        self.added = [t["content"] for t in shape["added_tokens"]]
        self.plain = shape["normalizer"] is None and shape["pre_tokenizer"] == BYTE_LEVEL and not any(map(str.isalpha, self.added))
        self.words = _Ids(self.tokenizer, self.kind)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str, blank: str) -> bytes | None:
        """Ids of a plain piece led by the blank (or nothing); None if the library has to see it."""
        if self.plain and piece.isalpha() and (piece.isascii() or max(piece) <= "\u00ff"):
            return self.words[blank + piece]
        if self.plain and PLAIN_PIECE.fullmatch(piece) and not any(t in piece for t in self.added):
            return b"".join(map(self.words.__getitem__, PLAIN_WORDS.findall(blank + piece)))
        return None

    def _encoded(self, pieces: list[str], blank: str) -> list[bytes]:
        """Ids of pieces that the blank (or nothing) leads."""
        ids = [self._piece(p, blank) for p in pieces]
        rest = [i for i, found in enumerate(ids) if found is None]
        for i, found in zip(rest, self._library([blank + pieces[i] for i in rest])):
            ids[i] = found
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        pieces, number = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        starts = lists.offsets.to_numpy()
        ends_blank = np.fromiter((p != p.strip() or not p for p in pieces), bool, len(pieces))
        odd = np.logical_or.reduceat(ends_blank[number], starts[:-1]) if texts else np.empty(0, bool)  # a blank beside a blank
        ids = self._encoded(["" if e else p for p, e in zip(pieces, ends_blank.tolist())], " ")
        heads = self._encoded(["" if o else pieces[i] for i, o in zip(number[starts[:-1]], odd)], "")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind().itemsize
        flat, first = np.frombuffer(b"".join(ids), self.kind), np.cumsum(size) - size
        out = []
        for text, head, o, a, b in zip(texts, heads, odd, starts[:-1] + 1, starts[1:]):
            if o:
                start, *rest = WORD_EDGE.split(text)
                out.append(np.frombuffer(b"".join(self._library([start]) + self._encoded(rest, " ")), self.kind))
                continue
            use = number[a:b]
            n = size[use]
            at = np.arange(n.sum()) + np.repeat(first[use] - np.cumsum(n) + n, n)
            out.append(np.concatenate([np.frombuffer(head, self.kind), flat[at]]))
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> CachedTokenizer:
    return CachedTokenizer(path)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark gives it, so that executors and Spark mean the same place."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def sequence_schema(length: int, kind) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])


class Writer:
    """One file of sequences: ids come in pieces, full record batches go out at once."""

    def __init__(self, store: fs.FileSystem, path: str, length: int, kind):
        self.length, self.kind, self.size = length, kind, length * BATCH_SEQUENCES
        self.sink = store.open_output_stream(path)
        self.schema = sequence_schema(length, kind)
        self.stream = pa.ipc.new_stream(self.sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_tokens = self.n_sequences = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_tokens += len(ids)
        if self.n_waiting >= self.size:
            data = np.concatenate(self.waiting)
            full = len(data) // self.size * self.size
            for at in range(0, full, self.size):
                self._put(data[at:at + self.size], self.size)
            self.waiting, self.n_waiting = [data[full:]], len(data) - full

    def _put(self, ids: np.ndarray, used: int) -> None:
        mask = np.arange(len(ids)) < used
        self.stream.write_batch(pa.record_batch([
            pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))
        self.n_sequences += len(ids) // self.length

    def close(self) -> None:
        if self.n_waiting:
            data = np.concatenate(self.waiting)
            padded = np.zeros(-(-len(data) // self.length) * self.length, self.kind)
            padded[:len(data)] = data
            self._put(padded, len(data))
        self.stream.close()
        self.sink.close()


class Sequences:
    """A file of sequences, memory mapped where it is local; item i is (ids, mask) without a copy of ids."""

    def __init__(self, uri: str):
        store, path = _open(uri)
        self.source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        self.batches = [*pa.ipc.open_stream(self.source)]
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else 0
        self.ids = [b.column("ids").flatten().to_numpy(zero_copy_only=True) for b in self.batches]

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        batch, row = divmod(i, BATCH_SEQUENCES)
        return self.ids[batch][row * self.length:(row + 1) * self.length], self.batches[batch].column("mask")[row].values

    def tokens(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from position ``start`` on, a view where they lie in one batch."""
        size, parts = self.length * BATCH_SEQUENCES, []
        while n > 0:
            batch, at = divmod(start, size)
            part = self.ids[batch][at:at + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def write_sequences(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, length: int = LENGTH,
                    id_column: str = "doc_id", text_column: str = "text", chunk: int = 2048) -> DataFrame:
    """Write ``docs`` to ``folder`` (all executors and the driver must see it); returns the manifest.

    Null and empty texts hold the end id alone. Null ids come first; documents with equal ids stand in the
    order of their texts. ``docs`` without rows gives no files and an empty manifest. Other columns are
    not read.
    """
    folder = qualified(docs.sparkSession, folder)
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("_text"))

    id_type = to_arrow_type(rows.schema["_id"].dataType)
    listing = pa.schema([("id", id_type), ("start", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part = tokenizer(tokenizer_path), TaskContext.get().partitionId()
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        name, writer, index, n_docs = f"{part:06d}-{uuid.uuid4().hex}", None, None, 0
        end = np.array([end_id], encoder.kind)
        for batch in batches:
            for at in range(0, len(batch), chunk):
                some = batch.iloc[at:at + chunk]
                if writer is None:
                    writer = Writer(store, f"{base}/{name}.arrow", length, encoder.kind)
                starts, counts = [], []
                for ids in encoder.encode(some["_text"].tolist()):
                    starts.append(writer.n_tokens)
                    counts.append(len(ids) + 1)
                    writer.add(ids)
                    writer.add(end)
                if index is None:
                    sink = store.open_output_stream(f"{base}/{name}.docs.arrow")
                    index = pa.ipc.new_stream(sink, listing)
                index.write_batch(pa.record_batch([pa.array(some["_id"], id_type, from_pandas=True), pa.array(starts), pa.array(counts)], schema=listing))
                n_docs += len(some)
        if writer:
            writer.close()
            index.close()
            sink.close()
            yield pd.DataFrame([(part, f"{folder}/{name}.arrow", f"{folder}/{name}.docs.arrow", n_docs, writer.n_tokens, writer.n_sequences)],
                               columns=["part", "file", "documents", "n_docs", "n_tokens", "n_sequences"])

    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n_files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    ordered = rows.repartitionByRange(n_files, "_id").sortWithinPartitions("_id", "_text")
    ordered.mapInPandas(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_documents(manifest: DataFrame, id_type: str = "long", id_column: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, start (ids before it in all files), n_tokens, ids_crc32.

    The checksum is the unsigned crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    files = placed.select("part", "file", "documents", "first").repartition(max(1, manifest.count()), "part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                content = Sequences(row.file)
                store, path = _open(row.documents)
                for docs in pa.ipc.open_stream(store.open_input_file(path)):
                    out = docs.to_pandas()
                    out["crc"] = [zlib.crc32(content.tokens(s, n).astype("<u4").tobytes()) for s, n in zip(out["start"], out["n"])]
                    out["start"] += row.first
                    yield out

    return files.mapInPandas(run, f"id {id_type}, start long, n long, crc long").select(
        F.col("id").alias(id_column), "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
