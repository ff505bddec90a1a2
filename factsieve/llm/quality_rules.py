"""Quality rules: counts per document and divergence from language references.

References are counted over all documents of a language: a histogram of character classes and one of
its most common words. A document fails if its own histogram lies too far from the reference of its
language (of the nearest language where its own has none), measured by the Jensen-Shannon distance
(square root of the divergence to base 2, 0 to 1). Short documents scatter, so the distances count
only from a least number of characters or words on.

A document without any common word is only about 0.43 from a reference whose words cover a third of its
language, less than over-concentrated texts and no more than short good ones. So common words are also
judged as one class against all others: there such a document is just as far, but good ones hardly
scatter. A document with fewer common words than the reference fails beyond a share of that distance.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from factsieve.llm.common import stage, window_hashes, word_hashes, words_of

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
CLASSES = ("lower", "upper", "other_letter", "digit", "blank", "line_end", "mark", "symbol", "control")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _class_of_byte() -> np.ndarray:
    """Class by UTF-8 byte; continuation bytes get the number after the last class and are not counted."""
    out = np.full(256, CLASSES.index("symbol"), np.uint8)
    out[:32] = out[127] = CLASSES.index("control")
    out[ord("a"):ord("z") + 1], out[ord("A"):ord("Z") + 1] = CLASSES.index("lower"), CLASSES.index("upper")
    out[ord("0"):ord("9") + 1] = CLASSES.index("digit")
    out[[ord(" "), ord("\t")]], out[[ord("\n"), ord("\r")]] = CLASSES.index("blank"), CLASSES.index("line_end")
    out[list(b".,;:!?'\"()-")] = CLASSES.index("mark")
    out[128:192], out[192:] = len(CLASSES), CLASSES.index("other_letter")
    return out


CLASS_OF_BYTE = _class_of_byte()


@dataclass(frozen=True)
class Rules:
    common_words: int = 64          # words in a reference
    least_share: float = 0.0005     # a reference word holds at least this share of its language's words
    least_words: int = 50           # below, the word distance is not judged
    least_chars: int = 200          # below, the class distance is not judged
    most_class_distance: float = 0.3
    most_word_distance: float = 0.5
    most_lack: float = 0.5          # of the distance of a document without common words
    base_words: int = 20
    base_repeat: tuple[int, int] = (100, 30)  # fails if 100 * repeated words > 30 * words


def class_histogram(data: bytes) -> np.ndarray:
    return np.bincount(CLASS_OF_BYTE[np.frombuffer(data, np.uint8)], minlength=len(CLASSES) + 1)[:len(CLASSES)]


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of eight words that occur twice or more."""
    windows = window_hashes(word_hashes(words), WINDOW)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows)
    same = np.flatnonzero(np.diff(windows[order]) == 0)
    if not len(same):
        return 0
    starts = np.unique(order[np.append(same, same + 1)])
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def base_counts(text: str | None, words: list[bytes]) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode()
    joined = np.frombuffer(b"".join(words), np.uint8)
    lines = [x for x in data.split(b"\n") if x.split()]
    return (len(words), int(((joined & 0xC0) != 0x80).sum()), len(data) - len(data.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two count vectors; 0 if either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    middle = (p + q) / 2
    part = lambda a: float((a[a > 0] * np.log2(a[a > 0] / middle[a > 0])).sum())
    return float(np.sqrt(max(0.0, (part(p) + part(q)) / 2)))


@dataclass
class Reference:
    classes: np.ndarray = field(default_factory=lambda: np.zeros(len(CLASSES)))
    n_words: int = 0
    words: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self):
        counts = np.array([*self.words.values()], float)
        self.places = {w: i for i, w in enumerate(self.words)}
        self.histogram = np.append(counts, max(0.0, self.n_words - counts.sum()))

    def distances(self, classes: np.ndarray, words: list[bytes]) -> tuple[float, float]:
        own = np.zeros(len(self.places) + 1)
        for w, n in Counter(filter(self.places.__contains__, words)).items():
            own[self.places[w]] = n
        own[-1] = len(words) - own.sum()
        return js_distance(classes, self.classes), js_distance(own, self.histogram)

    def lack(self, words: list[bytes]) -> float:
        """Distance by common and other words, as a share of a document's without common words; 0 if it has as many as the reference."""
        both = np.array([self.histogram[:-1].sum(), self.histogram[-1]])
        common = sum(map(self.places.__contains__, words))
        if not words or common * both.sum() >= both[0] * len(words):
            return 0.0
        return js_distance(np.array([common, len(words) - common]), both) / js_distance(np.array([0, 1]), both)


def _counted(batches: Iterator[pd.DataFrame], most: int = 300_000) -> Iterator[pd.DataFrame]:
    """(lang, kind, key, n) of a task's documents, given out whenever ``most`` words have gathered."""
    classes: dict[str, np.ndarray] = {}
    words: dict[str, Counter] = {}

    def flush() -> pd.DataFrame:
        rows = [(lang, 0, str(i).encode(), int(n)) for lang, c in classes.items() for i, n in enumerate(c) if n]
        rows += [(lang, 1, b"", c.total()) for lang, c in words.items() if c]
        rows += [(lang, 2, w, n) for lang, c in words.items() for w, n in c.items()]
        classes.clear()
        words.clear()
        return pd.DataFrame(rows, columns=["lang", "kind", "key", "n"])

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            data = text.encode()
            classes[lang] = classes.get(lang, 0) + class_histogram(data)
            words.setdefault(lang, Counter()).update(data.lower().split())
            if sum(map(len, words.values())) > most:
                yield flush()
    yield flush()


def references(docs: DataFrame, rules: Rules = Rules(), text_column: str = "text", lang_column: str = "lang") -> dict[str, Reference]:
    """A reference per language, counted over all documents that name one.

    The driver gets the class sums and, per language, at most 1 / least_share words.
    """
    named = docs.select(F.col(f"`{lang_column}`").alias("lang"), F.col(f"`{text_column}`").alias("text")).dropna()
    counted = named.mapInPandas(_counted, "lang string, kind int, key binary, n long")
    sums = stage(counted.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).filter("kind < 2 OR n > 1"), "rule-counts")
    small = sums.filter("kind < 2").toPandas()
    total = {r.lang: int(r.n) for r in small[small.kind == 1].itertuples()}
    if not len(small):
        return {}
    least = sums.sparkSession.createDataFrame([(k, rules.least_share * v) for k, v in total.items()] or [("", 0.0)], "lang string, least double")
    common = sums.filter("kind = 2").join(F.broadcast(least), "lang").filter("n >= least").toPandas()
    out = {}
    for lang, part in small[small.kind == 0].groupby("lang"):
        classes = np.zeros(len(CLASSES))
        classes[part["key"].map(bytes).astype(int)] = part["n"]
        top = sorted(((-int(r.n), bytes(r.key)) for r in common[common.lang == lang].itertuples()))[:rules.common_words]
        out[lang] = Reference(classes, total.get(lang, 0), {w: -n for n, w in top})
    return out


def judge(text: str | None, lang: str | None, refs: dict[str, Reference], rules: Rules) -> tuple:
    """The five counts, base_failed, class_distance, word_distance, kept."""
    words = words_of(text)
    counts = base_counts(text, words)
    n_words, n_repeat = counts[0], counts[4]
    failed = n_words < rules.base_words or rules.base_repeat[0] * n_repeat > rules.base_repeat[1] * n_words
    if failed or not refs:
        return *counts, failed, None, None, not failed
    data = text.encode().lower()
    lowered, classes = data.split(), class_histogram(text.encode())
    found = [(r.distances(classes, lowered), r) for r in ([refs[lang]] if lang in refs else refs.values())]
    (by_class, by_word), nearest = min(found, key=lambda x: sum(x[0]))
    far = (classes.sum() >= rules.least_chars and by_class > rules.most_class_distance) or (
        n_words >= rules.least_words and (by_word > rules.most_word_distance or nearest.lack(lowered) > rules.most_lack))
    return *counts, failed, by_class, by_word, not far


def rate(docs: DataFrame, rules: Rules = Rules(), id_column: str = "doc_id", text_column: str = "text",
         lang_column: str = "lang", refs: dict[str, Reference] | None = None) -> DataFrame:
    """One row per row of ``docs``: the id, the five counts, base_failed, class_distance, word_distance, kept.

    Null and empty texts count as 0 words and fail the base rules. Distances are null for documents that
    fail them, and where there is no reference at all; the latter are kept. Repeated rows are judged alike.
    Other columns of ``docs`` are not read; an empty table gives an empty result.
    """
    refs = references(docs, rules, text_column, lang_column) if refs is None else refs
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text_column}`").alias("_text"),
                       F.col(f"`{lang_column}`").alias("_lang"))
    kind = rows.schema["_id"].dataType.simpleString()
    names = [*COUNTS, "base_failed", "class_distance", "word_distance", "kept"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([judge(t, g, refs, rules) for t, g in zip(batch["_text"], batch["_lang"])], columns=names)
            out.insert(0, "_id", batch["_id"].to_numpy())
            yield out

    schema = f"_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + \
        ", base_failed boolean, class_distance double, word_distance double, kept boolean"
    return rows.mapInPandas(run, schema).withColumnRenamed("_id", id_column)
