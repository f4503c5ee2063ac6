"""Toxicity scores: FTRL-proximal logistic regression (McMahan et al. 2013) over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, mapped
from .hashing import distinct, mixed, words_of

#: Features are hashed into this many weights.
BUCKETS = 1 << 20
#: Labelled rows to learn from at most, about; the sample is drawn by a hash of the id. Fitting is done in one task over their features.
MOST_ROWS = 16_000
#: Learning rate, its offset, and the L1 and L2 strengths.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 1.0
EPOCHS = 2
#: Of the rows whose remainder by crc32 of the id is 0 no label is used.
FOLDS = 5

_SECOND, _SKIP = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    """Batches in parts, so that few texts are Python strings at a time."""
    return (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))


def features(words: np.ndarray) -> np.ndarray:
    """Buckets of the words, of the pairs of neighbours, and of the pairs with one word between; not yet distinct."""
    pairs = mixed(words[:-1] * _SECOND + words[1:])
    skips = mixed(words[:-2] * _SKIP + words[2:] + np.uint64(1))
    return (np.concatenate((words, pairs, skips)) & np.uint64(BUCKETS - 1)).astype(np.int32)


def fit(rows: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Weights of the buckets (the last is the bias) from (distinct buckets, label) in the given order."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(at):
        return np.where(np.abs(z[at]) <= L1 * (at < BUCKETS), 0.0, -(z[at] - np.sign(z[at]) * L1 * (at < BUCKETS)) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, label in rows:
            at = np.append(at, BUCKETS)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(np.arange(BUCKETS + 1))


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> np.ndarray:
    """Weights from docs (doc_id, text) and labels (doc_id, toxic), without the held-out rows.

    An id with several labels counts as toxic if one says so; null ids and labels are left out. Without labels all weights are 0, so that
    each score is 0.5 (see clean). The sample (MOST_ROWS of about 6 KB each) is fitted in one task.
    """
    usable = kept(labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    sample = usable.where(draw < most / max(most, usable.count()))
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            own = [distinct(features(w)).tobytes() for w in words_of(batch.column("text").to_pylist(), bare=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(own, pa.binary())], ["doc_id", "toxic", "own"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(i, own, y) for b in batches for i, own, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "own", "toxic")), strict=True)]
        w = fit([(np.frombuffer(own, np.int32), y) for _, own, y in sorted(rows, key=lambda r: (int(mixed(np.array([r[0]], np.int64).view(np.uint64))[0]), r[1]))])
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w[at], pa.float64())], ["at", "w"])

    rows = kept(mapped(chosen, hashed, "doc_id long, toxic int, own binary"))
    out = np.zeros(BUCKETS + 1)
    for row in mapped(rows.coalesce(1), fitted, "at int, w double").collect():  # the weights that L1 leaves, BUCKETS + 1 at most
        out[row.at] = row.w
    return out


def held_out():
    """Whether a row's label is kept back."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, score, predicted of each row. Whole texts of any length are read; an empty or null text scores by the bias alone.

    Repeated rows each get a row and score alike; a null id counts as an empty text for held_out; other columns play no part; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in _slices(batches):
            out = []
            for own in words_of(batch.column("text").to_pylist(), bare=True):
                at = features(own)
                out.append(1 / (1 + np.exp(-np.clip(w[distinct(at[w[at] != 0])].sum() + w[BUCKETS], -35, 35))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    out = mapped(docs.select("doc_id", "text"), scored, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def clean(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The rows of docs, whole, whose text scores below 0.5; all rows if nothing was learnt (all weights are 0).

    Null and empty texts score by the bias alone, repeated rows alike; columns of any name stay; an empty table stays empty.
    """
    if not weights.any():
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in _slices(batches):
            keep = []
            for own in words_of(batch.column("text").to_pylist(), bare=True):
                at = features(own)
                keep.append(bool(w[distinct(at[w[at] != 0])].sum() + w[BUCKETS] < 0))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return mapped(docs, passed, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
