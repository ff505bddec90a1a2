"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text becomes log-scaled, idf-weighted counts of hashed byte pairs plus a few style shares; a truncated
singular value decomposition of the labelled sample projects them to short vectors. Every document is
compared with every labelled vector by blocked matrix products, and the nearest ones vote with their
similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from factsieve.llm.common import Sealed, words_of

SAMPLE = 4000      # labelled documents at most
BUCKETS = 2048     # hashed byte pairs
DIMENSIONS = 64
NEIGHBOURS = 25
SHARPNESS = 4      # votes weigh similarity to this power
BLOCK = 512        # documents multiplied at a time
SPARE, ROUNDS = 32, 40  # further directions and rounds of the subspace iteration
THRESHOLD = 0.3
STYLES = (("repeated word", 50.0), ("upper case", 20.0), ("symbol", 50.0), ("digit", 20.0), ("exclamation", 50.0), ("repeated line", 5.0))
_BITS = np.uint32(32 - (BUCKETS - 1).bit_length())


def features(text: str | None) -> np.ndarray:
    """Pair counts, then the style shares; all zero for a null or empty text."""
    out = np.zeros(BUCKETS + len(STYLES), np.float32)
    if not text:
        return out
    data = np.frombuffer(text.encode(), np.uint8)
    pairs = (data[:-1].astype(np.uint32) * np.uint32(256) + data[1:]) * np.uint32(2654435761) >> _BITS
    out[:BUCKETS] = np.bincount(pairs, minlength=BUCKETS)
    words, lines = words_of(text), [x for x in text.split("\n") if x.strip()]
    n, count = len(data), np.bincount(data, minlength=256)
    out[BUCKETS:] = (
        sum(map(bytes.__eq__, words, words[1:])) / max(1, len(words)),
        count[ord("A"):ord("Z") + 1].sum() / n, count[list(b"#*$%&|<>")].sum() / n, count[ord("0"):ord("9") + 1].sum() / n,
        count[ord("!")] / n, 1 - len(set(lines)) / max(1, len(lines)))
    return out


@dataclass
class Model:
    idf: np.ndarray
    mean: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        pairs = np.log1p(counts[:, :BUCKETS]) * self.idf
        pairs /= np.maximum(np.linalg.norm(pairs, axis=1, keepdims=True), 1e-9)
        style = np.log1p(counts[:, BUCKETS:] * np.array([s for _, s in STYLES], np.float32)) / 2
        return np.hstack([pairs, style]).astype(np.float32)

    def embed(self, counts: np.ndarray) -> np.ndarray:
        out = (self.weigh(counts) - self.mean) @ self.projection
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Share of similarity that votes for label 1; the prior for empty texts and without votes."""
        out = np.full(len(counts), self.prior)
        some = np.flatnonzero(counts.any(axis=1))
        if not len(some) or not len(self.labels):
            return out
        near = self.embed(counts[some]) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        votes = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** SHARPNESS
        total = votes.sum(axis=1)
        share = (votes * self.labels[top]).sum(axis=1) / np.maximum(total, 1e-12)
        out[some] = np.where(total > 1e-12, np.clip(share, 0, 1).round(6), self.prior)
        return out


def learn(docs: DataFrame, labels: DataFrame, train: Column, id_column: str = "doc_id", text_column: str = "text",
          label_column: str = "quality", sample: int = SAMPLE) -> Model:
    """The model from at most ``sample`` labelled documents for whose label row ``train`` holds.

    The sample takes the labelled ids that hash lowest. A document with several labels counts with its
    lowest; null ids, labels and texts teach nothing. Without any label the prior is 0.5.
    """
    key, label = F.col(f"`{id_column}`"), F.col(f"`{label_column}`")
    chosen = labels.filter(train & key.isNotNull() & label.isNotNull()).groupBy(key.alias("_key")).agg(
        F.min(label).cast("int").alias("_label")).orderBy(F.md5(F.col("_key").cast("string").cast("binary")), "_key").limit(sample)
    rows = docs.select(key.alias("_id"), F.col(f"`{text_column}`").alias("_text")).filter("_text IS NOT NULL").join(
        F.broadcast(chosen), F.col("_id") == F.col("_key"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_key": batch["_key"].astype(str), "_label": batch["_label"],
                                "_counts": [features(t).tobytes() for t in batch["_text"]]})

    found = rows.mapInPandas(run, "_key string, _label int, _counts binary").groupBy("_key").agg(
        F.min("_label").alias("_label"), F.min("_counts").alias("_counts")).toPandas().sort_values("_key")
    marks, counts = found["_label"].to_numpy(np.float64), np.empty((len(found), BUCKETS + len(STYLES)), np.float32)
    for i, row in enumerate(found.pop("_counts")):
        counts[i] = np.frombuffer(row, np.float32)
    return fit(counts, marks)


def fit(counts: np.ndarray, labels: np.ndarray) -> Model:
    width = BUCKETS + len(STYLES)
    none = np.zeros((0, DIMENSIONS), np.float32)
    if not len(labels):
        return Model(np.ones(BUCKETS, np.float32), np.zeros(width, np.float32), np.zeros((width, DIMENSIONS), np.float32), none, labels, 0.5)
    idf = (np.log((1 + len(labels)) / (1 + (counts[:, :BUCKETS] > 0).sum(axis=0))) + 0.1).astype(np.float32)
    model = Model(idf, np.zeros(width, np.float32), np.zeros((width, 0), np.float32), none, labels, float(labels.mean()))
    weighed = np.empty((len(labels), width), np.float32)  # the one large array: sample times features
    for at in range(0, len(labels), BLOCK):
        weighed[at:at + BLOCK] = model.weigh(counts[at:at + BLOCK])
    model.mean = weighed.mean(axis=0)
    model.projection = _leading(weighed, model.mean)
    model.vectors = np.concatenate([model.embed(counts[at:at + BLOCK]) for at in range(0, len(labels), BLOCK)])
    return model


def _leading(rows: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The leading right singular directions of the centred rows, by subspace iteration in blocks of rows, so
    that neither a covariance matrix nor a centred copy is held."""
    def applied(basis: np.ndarray) -> np.ndarray:
        out = np.zeros(basis.shape)
        for at in range(0, len(rows), BLOCK):
            part = rows[at:at + BLOCK] - mean
            out += part.T @ (part @ basis.astype(np.float32))
        return out

    basis = np.linalg.qr(np.random.default_rng(0).standard_normal((rows.shape[1], min(rows.shape[1], DIMENSIONS + SPARE))))[0]
    for _ in range(ROUNDS):
        basis = np.linalg.qr(applied(basis))[0]
    inner = basis.T @ applied(basis)
    return (basis @ np.linalg.eigh((inner + inner.T) / 2)[1][:, -DIMENSIONS:]).astype(np.float32)


def score(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` plus score (0 to 1) and predicted (1 if score >= 0.3).

    Null and empty texts get the share of label 1 in the sample. Equal texts score alike. Columns named
    score or predicted give way; an empty table gives an empty result.
    """
    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [texts.iloc[at:at + BLOCK] for at in range(0, len(texts), BLOCK)]
            yield pd.Series(np.concatenate([model.score(np.array([features(t) for t in part])) for part in parts] or [np.empty(0)]))

    sealed = Sealed(docs)
    return sealed.opened(sealed.rows.withColumn("found", scores(sealed.col(text_column))),
                         score=F.col("found"), predicted=(F.col("found") >= THRESHOLD).cast("int"))
