"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each coordinate has its own rate, and the L1 term leaves most weights at zero, so the model is a short list of numbers
that every task gets. It is fitted in one task on a bounded sample (``hashed.MAX_TRAIN_ROWS``) of the labelled
documents that may be learnt from; every document is scored where it is read, with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashed import features, training_rows
from .shared import crc_mod, id_and_text, let_go, text_chunks

BITS = 20
THRESHOLD = 0.7


@dataclass
class Ftrl:
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.5
    epochs: int = 4

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Indices and values of the weights that aren't zero, and the bias (not regularised)."""
        z, n = np.zeros(size + 1), np.zeros(size + 1)
        l1, l2 = np.full(size + 1, self.l1), np.full(size + 1, self.l2)
        l1[size] = l2[size] = 0.0

        def weights(i):
            zi = z[i]
            shrunk = np.sign(zi) * np.maximum(np.abs(zi) - l1[i], 0)
            return -shrunk / ((self.beta + np.sqrt(n[i])) / self.alpha + l2[i])

        for _ in range(self.epochs):
            for x, y in zip(rows, labels, strict=True):
                i = np.append(x, size)
                w = weights(i)
                g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
                root = np.sqrt(n[i])
                n[i] += g * g
                z[i] += g - (np.sqrt(n[i]) - root) / self.alpha * w
        all_w = weights(np.arange(size + 1))
        at = np.flatnonzero(all_w[:size])
        return at, all_w[at].astype(np.float32), float(all_w[size])


def _train(bits: int, params: Ftrl):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for batch in batches:
            for a, b, texts in text_chunks(batch):
                rows += [np.unique(x).astype(np.int32) for x in features(texts, bits)]
            labels.append(batch.column("label").to_numpy())
        y = np.concatenate(labels).astype(float) if labels else np.zeros(0)
        at, w, bias = params.fit(rows, y, 1 << bits)
        yield pa.RecordBatch.from_arrays([pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([w.tolist()], pa.list_(pa.float32())), pa.array([bias])], ["at", "w", "bias"])

    return run


def fit(docs: DataFrame, labels: DataFrame, learn=None, bits: int = BITS, params: Ftrl | None = None) -> tuple[np.ndarray, float]:
    """Dense weights (2**bits floats, 4 MB) and bias. learn: which rows of labels may be learnt from (a Column over doc_id; default: all). Without any labelled row all scores are 0.5."""
    rows = training_rows(docs, labels, F.when(F.col("toxic").isNotNull(), (F.col("toxic") > 0).cast("int")), F.lit(True) if learn is None else learn)
    got = rows.mapInArrow(_train(bits, params or Ftrl()), "at array<int>, w array<float>, bias double").first()
    dense = np.zeros(1 << bits, np.float32)
    if got is None:
        return dense, 0.0
    dense[np.array(got.at, np.int64)] = got.w
    return dense, got.bias


def _score(model, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        w, bias = model.value
        for batch in batches:
            for a, b, texts in text_chunks(batch):
                sums = np.array([w[np.unique(x[w[x] != 0])].sum(dtype=float) for x in features(texts, bits)]) + bias
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))))], ["doc_id", "score"])

    return run


def scores(docs: DataFrame, labels: DataFrame, learn=None, bits: int = BITS) -> DataFrame:
    """(doc_id, score): the chance that label toxic is 1, from the text alone. Null and empty texts score by the bias; repeated rows get a row each; null doc_ids stay null."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, learn, bits))
    return id_and_text(docs).mapInArrow(_score(model, bits), "doc_id long, score double")


def learnt_from():
    """Rows that the model may learn from."""
    return crc_mod(F.col("doc_id"), 3) != 1


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    got = scores(docs, labels, learnt_from())
    return got.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _kept(model, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        w, bias = model.value
        limit = np.log(THRESHOLD / (1 - THRESHOLD))
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for a, b, texts in text_chunks(batch):
                keep[a:b] = [w[np.unique(x[w[x] != 0])].sum(dtype=float) + bias < limit for x in features(texts, bits)]
            yield batch.filter(pa.array(keep))

    return run


def without_toxic(docs: DataFrame, labels: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores less than THRESHOLD; judged where they are read. Null and empty texts score by the bias; repeated rows, and rows without a doc_id, each by their text. Other columns may have any names."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, learnt_from(), bits))
    plain = docs.toDF(*["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)])
    return plain.mapInArrow(_kept(model, bits), plain.schema).toDF(*docs.columns)
