"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Tokens are runs of letters and digits (and any byte beyond ASCII) and runs of other visible
characters; a feature is the hash of one token or of two in a row, modulo `FEATURES`; a token that follows itself is one
feature whatever the token, and so is one that comes back after one other. A text's value
of a feature is its share among the text's features, scaled. The model is learned in one task from
at most `sample` labelled documents, chosen by a hash of the id; scoring is a sparse dot product of
each whole text with the weights, in Arrow batches.

Rules. Null and empty texts have the bias alone. Without labelled documents every score is 0.5. A
document with several labels counts with each, once; null labels are ignored. Rows that share an id are one
document to learn from: the one whose text has the least hash. Null ids are never held out
and never learned from. Rows are scored each; columns of the input come along, and `held_out`,
`score` and `predicted` replace columns of that name.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import held_out, table
from pageloom.llm.words import grams, hashes, slices, spans, whole

FEATURES = 1 << 18
SAMPLE = 6000
EPOCHS = 4
SCALE = 8.0
THRESHOLD = 0.3
REPEATED, RETURNED = np.uint64(1), np.uint64(2)


def token_kinds() -> np.ndarray:
    kinds = np.full(256, 2, np.uint8)
    kinds[: 0x21] = 0
    kinds[0x80:] = 1
    for low, high in (("0", "9"), ("A", "Z"), ("a", "z")):
        kinds[ord(low) : ord(high) + 1] = 1
    return kinds


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, first of each text)."""
    starts, ends, first = spans(data, offsets, token_kinds())
    h = hashes(data, starts, ends)
    ok = whole(first, 2, max(0, len(h) - 1))
    pairs = grams(h, 2)
    pairs[h[1:] == h[:-1]] = REPEATED
    pairs = pairs[ok]
    own = np.searchsorted(first[1:-1], np.arange(len(h)), "right")
    at = np.searchsorted(first[1:-1], np.flatnonzero(ok), "right")
    again = np.flatnonzero(whole(first, 3, max(0, len(h) - 2)) & (h[2:] == h[:-2]))
    both = np.concatenate([h, pairs, np.full(len(again), RETURNED)]) % np.uint64(FEATURES)
    text = np.concatenate([own, at, own[again]])
    order = np.argsort(text, kind="stable")
    return both[order].astype(np.int64), np.searchsorted(text[order], np.arange(len(offsets)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in slices(batch.column(0)):
            found, first = features(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(found.astype(np.int32)))
            rest = [c.slice(row, len(first) - 1) for c in batch.columns[1:]]
            yield pa.record_batch([lists, *rest], names=["features", "label", "place"])


def train_ftrl(
    examples: Iterable[tuple[np.ndarray, int]],
    *,
    epochs: int = EPOCHS,
    alpha: float = 2.0,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.02,
) -> tuple[np.ndarray, float]:
    """Weights and bias; per-coordinate rates, weights follow from the running sums z and n."""
    z, n = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    order = np.random.default_rng(0)

    def weights(at) -> np.ndarray:
        zs = z[at]
        w = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zs) <= l1, 0.0, w)

    rows = []
    for numbers, label in examples:
        at, counts = np.unique(numbers, return_counts=True)
        value = counts * (SCALE / max(1, len(numbers)))
        rows.append((np.append(at, FEATURES).astype(np.int32), np.append(value, 1.0).astype(np.float32), label))
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, value, label = rows[i]
            w = weights(at)
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ value)))))
            g = (p - label) * value
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) * alpha ** -1 * w
            n[at] += g * g
    every = weights(slice(None))
    return every[:-1].astype(np.float32), float(every[-1])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    examples = (
        (lists.values.to_numpy(), label)
        for batch in batches
        for lists, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True)
    )
    weights, bias = train_ftrl(examples)
    yield pa.record_batch([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])


def learn(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The model of documents that are not held out; one task learns from at most `sample` of them."""
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("label")).where("label IN (0, 1)")
    mine = docs.select(F.col("doc_id"), "text").where(~held_out())
    # Ids are chosen before any text moves, each once: neither repeated ids nor repeated labels multiply.
    ids = mine.where("doc_id IS NOT NULL").select("doc_id").distinct()
    chosen = known.distinct().join(ids, F.col("doc_id") == F.col("label_id"), "left_semi")
    chosen = chosen.orderBy(F.xxhash64("label_id"), "label_id", "label").limit(sample)
    picked = mine.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "label", "text")
    picked = picked.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    picked = picked.select("text", "label", F.xxhash64("doc_id", "text").alias("place"))
    made = picked.mapInArrow(_features, "features array<int>, label int, place long")
    fit = made.repartition(1).sortWithinPartitions("place", "label").mapInArrow(_fit, "weights binary, bias double").head()
    if fit is None:
        return np.zeros(FEATURES, np.float32), 0.0
    return np.frombuffer(fit.weights, np.float32), fit.bias


def scored(docs: DataFrame, model: tuple[np.ndarray, float], *, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with `held_out`, `score` and `predicted`; only texts travel to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        weights, bias = shared.value
        out = [np.zeros(0)]
        for _, data, offsets in slices(texts):
            found, first = features(data, offsets)
            total = np.zeros(len(found) + 1)
            np.cumsum(weights[found], out=total[1:])
            size = np.maximum(1, np.diff(first))
            out.append(1 / (1 + np.exp(-(bias + SCALE * np.diff(total[first]) / size))))
        return pa.array(np.concatenate(out))

    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("held_out", "score", "predicted")]
    rows = docs.select(*keep, held_out().alias("held_out"), score(F.col("text")).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def op10_quality(spark, folder: str) -> DataFrame:
    """All documents, learned from the labelled ones that are not held out."""
    docs = table(spark, folder, "documents")
    model = learn(docs, table(spark, folder, "labels"))
    return scored(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "score", "predicted")
