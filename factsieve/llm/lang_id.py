"""Language identification by compression.

Each language has a zstandard raw-content dictionary of training texts. A text, reduced to lower-case
letters and blanks, is cut into blocks and compressed with every dictionary; the language with the
fewest bytes over all blocks wins. A narrow margin over the runner-up marks the prediction as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

NO_LETTERS = re.compile(r"[\W\d_]+")
BLOCK = 4096          # bytes compressed at a time, so that a long text does not become its own dictionary
LEVEL = 9             # lower levels find too few short matches
NARROW = 0.01         # margins below this share of the runner-up's bytes are rejected
SAMPLE_DOCS = 300     # training documents per language, about
DICTIONARY = 65_536   # bytes of a dictionary at most, and characters that a training document lends
PIECE = 512           # bytes that a document gives to a dictionary at a turn
UNKNOWN = "und"


def letters(text: str) -> bytes:
    """The text's words of letters, lower case, with blanks between; nothing if it has no letter."""
    if not any(map(str.isalpha, text)):
        return b""
    return NO_LETTERS.sub(" ", text.lower()).encode()


def learn(docs: DataFrame, train: Column, text_column: str = "text", lang_column: str = "lang", id_column: str = "doc_id",
          sample_docs: int = SAMPLE_DOCS, dictionary: int = DICTIONARY) -> dict[str, bytes]:
    """A dictionary per language from a bounded sample of the rows for which ``train`` holds.

    The sample takes the documents of each language whose id hashes lowest, long or short. They fill the
    dictionary in turns of ``PIECE`` bytes, so that many documents teach and a few long ones still fill it.
    Rows without language, text or letters teach nothing.
    """
    text = F.col(f"`{text_column}`")
    labelled = docs.filter(train & F.col(f"`{lang_column}`").isNotNull() & text.isNotNull()).select(
        F.col(f"`{lang_column}`").alias("lang"), F.substring(text, 1, dictionary).alias("text"),
        (F.conv(F.substring(F.md5(F.col(f"`{id_column}`").cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / 2**32).alias("_u"),
    ).filter("text <> ''")
    counts = labelled.groupBy("lang").count().collect()
    if not counts:
        return {}
    rates = docs.sparkSession.createDataFrame([(r["lang"], sample_docs / r["count"]) for r in counts], "lang string, _rate double")
    sample = labelled.join(F.broadcast(rates), "lang").filter("_u <= _rate").select("lang", "_u", "text").toPandas()
    out = {}
    for lang, part in sample.sort_values(["_u", "text"]).groupby("lang"):
        lent, taken, at = [*filter(None, map(letters, part["text"]))], [], 0
        while lent and sum(map(len, taken)) < dictionary:
            taken += [t[at:at + PIECE] for t in lent]
            at += PIECE
            lent = [t for t in lent if len(t) > at]
        if taken:
            out[lang] = b"".join(reversed(taken))[-dictionary:]  # what the first documents gave stands last, nearest to a text
    return out


def compressors(dictionaries: dict[str, bytes]) -> dict[str, zstandard.ZstdCompressor]:
    plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    out = {}
    for lang, content in sorted(dictionaries.items()):
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        out[lang] = zstandard.ZstdCompressor(dict_data=data, **plain)
    if len(out) == 1:  # the runner-up of a single language is no dictionary at all
        out[UNKNOWN] = zstandard.ZstdCompressor(**plain)
    return out


def classify(text: str | None, coders: dict[str, zstandard.ZstdCompressor]) -> tuple[str, float, bool]:
    """(language, score, rejected). The score is the saving over the runner-up, times 5, at most 1."""
    data = letters(text) if text and coders else b""
    if not data:
        return UNKNOWN, 0.0, True
    blocks = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in coders.items())
    margin = 1 - sizes[0][0] / sizes[1][0]
    best = next(lang for _, lang in sizes if lang != UNKNOWN)
    return best, min(1.0, 5 * margin), margin < NARROW


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, lang_pred, score, rejected.

    Null, empty and letterless texts, and all texts if nothing was learned: und, 0, rejected. Languages
    that compress equally well: the first by name, with score 0. Other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text_column}`").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coders = compressors(dictionaries)
        for batch in batches:
            out = pd.DataFrame([classify(t, coders) for t in batch["_text"]], columns=["lang_pred", "score", "rejected"])
            out.insert(0, "_id", batch["_id"].to_numpy())
            yield out

    return rows.mapInPandas(run, f"_id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("_id", id_column)
