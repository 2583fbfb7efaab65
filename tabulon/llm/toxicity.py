"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the presence of its words, its pairs of neighbouring words and its pairs with one word
between, hashed into ``2**BITS`` buckets. The model is fitted by FTRL-proximal: each coordinate has its own
learning rate, and the L1 term keeps most weights at exactly zero, so that the fitted model is a short list of
(bucket, weight) pairs that is broadcast; it has at most ``2**BITS`` of them.

The fit uses at most about ``MAX_TRAIN`` labelled rows, each whole, chosen by a hash of id and text; the bound is a
parameter. Scoring covers every whole text; labels, lang, source and doc_id are not inputs of a score.

Defined results: null and empty texts score as texts without features, that is by the intercept alone; with no
labelled rows every score is next to 0. Rows that repeat a doc_id are scored one by one; labelled rows with equal id and text
are learned from once, and an id with several labels counts as toxic if one of them says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import wordhash
from tabulon.llm.batches import slices
from tabulon.llm.common import held_out, within_share

BITS = 20
#: Bound on the labelled rows of a fit.
MAX_TRAIN = 12_000


def _features(w: wordhash.Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word, pair and skip-pair of a block; repeated ones more than once."""
    h = w.hashes
    of = np.searchsorted(w.first, np.arange(len(h)), "right") - 1
    shift = np.uint64(64 - BITS)
    texts, buckets = [of], [(h >> shift).astype(np.int64)]
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        if len(h) > gap:
            same = of[:-gap] == of[gap:]
            pairs = wordhash.mix(h[:-gap] * np.uint64(salt) + h[gap:])
            texts.append(of[:-gap][same])
            buckets.append((pairs >> shift).astype(np.int64)[same])
    return np.concatenate(texts), np.concatenate(buckets)


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, order and the distinct buckets of each training text."""
    for batch in slices(batches):
        rows = [np.unique(_features(wordhash.words([text]))[1]).astype(np.int32) for text in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int32()))], ["label", "place", "buckets"]
        )


class Model:
    """Non-zero weights, sorted by bucket, and the intercept."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, intercept: float) -> None:
        self.buckets, self.weights, self.intercept = buckets, weights, intercept

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        dense = getattr(self, "_dense", None)
        if dense is None:
            dense = self._dense = np.zeros(1 << BITS, np.float32)
            dense[self.buckets] = self.weights
        out = np.full(len(texts), self.intercept)
        for begin, end in wordhash.blocks(texts):
            of, buckets = _features(wordhash.words(texts[begin:end]))
            used = np.flatnonzero(dense[buckets])
            keys = np.unique(of[used] << BITS | buckets[used])  # presence, not count
            out[begin:end] += np.bincount(keys >> BITS, dense[keys & ((1 << BITS) - 1)], end - begin)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_dense"}


def fit(
    labels: list[int], rows: list[np.ndarray], alpha: float = 0.5, beta: float = 1.0, l1: float = 10.0, l2: float = 0.1, epochs: int = 4,
    toxic_weight: float = 3.0,
) -> Model:
    """FTRL-proximal over rows of distinct buckets; the last coordinate is the intercept, without L1.

    Toxic rows are rare and count ``toxic_weight`` times. The L1 term shrinks where there are few of them, since the
    gradients that it holds against shrink too.
    """
    if not labels:
        return Model(np.empty(0, np.int32), np.empty(0, np.float32), -np.inf)
    l1 = min(l1, max(1.0, 0.03 * toxic_weight * sum(labels)))
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    penalty = np.full(size, l1)
    penalty[-1] = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        pulled = np.abs(zi) - penalty[at]
        return np.where(pulled > 0, -np.sign(zi) * pulled / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    rows = [np.append(r, size - 1) for r in rows]
    for _ in range(epochs):
        for label, at in zip(labels, rows, strict=True):
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = (p - label) * (toxic_weight if label else 1.0)
            before = n[at]
            z[at] += g - (np.sqrt(before + g * g) - np.sqrt(before)) / alpha * w
            n[at] = before + g * g
    at = np.flatnonzero(np.abs(z[:-1]) > l1)
    return Model(at.astype(np.int32), weights(at).astype(np.float32), float(weights(np.array([size - 1]))[0]))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    n = ids.join(known, "doc_id").count()
    share = min(1.0, max_train / n) if n else 1.0
    # A hash of id and text chooses the rows before anything is shuffled; equal ones are one.
    place = F.xxhash64(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    chosen = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), place.alias("place"), F.col("text").cast("binary").alias("text"))
        .where(F.col("doc_id").isNotNull() & within_share(F.col("place"), share))
        .dropDuplicates(["doc_id", "place"])
    )
    rows = (
        chosen.join(known, "doc_id")
        .select("label", "place", "text")
        .mapInArrow(_train_rows, "label int, place bigint, buckets array<int>")
        .toArrow()  # about ``max_train`` rows
        .sort_by("place")
    )
    buckets = rows.column("buckets").combine_chunks()
    values, offsets = buckets.values.to_numpy(), buckets.offsets.to_numpy()
    return fit(rows.column("label").to_pylist(), [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = shared.value.scores(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], ["doc_id", "held_out", "score"])

    return (
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary")
        )
        .mapInArrow(run, "doc_id bigint, held_out boolean, score double")
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
