"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(s - t_k): one score s from hashed-text weights that all grades share, and thresholds t_1 < t_2
< ... between the grades. The expected grade and the chance of a grade or better (the tail) serve for selection.
Grades here: 0 for low quality, 1 for good quality but toxic, 2 for good quality and not toxic.
Fitting and scoring run as in ``toxicity``: a bounded sample in one task, all documents where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashed import style_features, training_rows
from .shared import crc_mod, id_and_text, let_go, text_chunks

BITS = 18
GRADES = 3
KEEP_TAIL = 0.5


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, size: int, k: int, rate: float = 0.5, l2: float = 1e-4, epochs: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by AdaGrad on the likelihood of the grade."""
    w, acc = np.zeros(size), np.full(size, 1e-3)
    share = np.array([(grades > j).mean() if len(grades) else 0.5 for j in range(k - 1)]).clip(1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(k - 1))
    first, gap = start[0], np.log(np.maximum(np.diff(start), 1e-3))  # gaps are exponentials, so the order holds
    t_acc = np.full(k - 1, 1.0)
    for _ in range(epochs):
        for (at, v), y in zip(rows, grades, strict=True):
            t = first + np.concatenate([[0.0], np.cumsum(np.exp(gap))])
            s = float(w[at] @ v)
            up = _sigmoid(t[y] - s) if y < k - 1 else 1.0
            low = _sigmoid(t[y - 1] - s) if y else 0.0
            p = max(up - low, 1e-9)
            d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
            g = (d_up - d_low) * v + l2 * w[at]
            np.add.at(acc, at, g * g)  # the two groups may share a number
            np.subtract.at(w, at, rate * g / np.sqrt(acc[at]))
            dt = np.zeros(k - 1)  # of the loss by each threshold
            if y < k - 1:
                dt[y] -= d_up
            if y:
                dt[y - 1] += d_low
            grad = np.concatenate([[dt.sum()], np.exp(gap) * dt[::-1].cumsum()[::-1][1:]])
            t_acc += grad * grad
            move = 0.1 * grad / np.sqrt(t_acc)
            first, gap = first - move[0], gap - move[1:]
    return w, first + np.concatenate([[0.0], np.cumsum(np.exp(gap))])


def _train(bits: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, grades = [], []
        for batch in batches:
            for a, b, texts in text_chunks(batch):
                rows += style_features(texts, bits)
            grades.append(batch.column("label").to_numpy())
        w, t = fit_rows(rows, np.concatenate(grades).astype(int) if grades else np.zeros(0, int), 1 << bits, k)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary()), pa.array([t.tolist()], pa.list_(pa.float64()))], ["w", "t"])

    return run


def _score(model, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        w, t = model.value
        for batch in batches:
            for a, b, texts in text_chunks(batch):
                s = np.array([float(w[at] @ v) for at, v in style_features(texts, bits)])
                over = _sigmoid(s[:, None] - t[None, :])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(s), pa.array(over.sum(axis=1)), pa.array(over.tolist(), pa.list_(pa.float64()))], ["doc_id", "score", "expected_grade", "tails"])

    return run


def grade(quality, toxic):
    """Grade of a labelled document; null where quality is null."""
    return F.when(quality.isNull(), None).when(quality <= 0, 0).when(F.coalesce(toxic, F.lit(0)) > 0, 1).otherwise(GRADES - 1)


def graded(docs: DataFrame, labels: DataFrame, learn=None, bits: int = BITS) -> DataFrame:
    """(doc_id, score, expected_grade, tails): tails[k] is the chance of a grade over k. From the text alone; null and empty texts score 0; repeated rows get a row each. Without labelled rows all documents get the same grade."""
    rows = training_rows(docs, labels, grade(F.col("quality"), F.col("toxic")), F.lit(True) if learn is None else learn)
    got = rows.mapInArrow(_train(bits, GRADES), "w binary, t array<double>").first()
    w, t = (np.frombuffer(got.w, np.float32), np.array(got.t)) if got else (np.zeros(1 << bits, np.float32), np.linspace(-1, 1, GRADES - 1))
    model = docs.sparkSession.sparkContext.broadcast((w, t))
    return id_and_text(docs).mapInArrow(_score(model, bits), "doc_id long, score double, expected_grade double, tails array<double>")


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from rows with crc32(doc_id) mod 3 other than 1. keep: a grade over 0 is likelier than not."""
    got = graded(docs, labels, crc_mod(F.col("doc_id"), 3) != 1)
    tails = F.col("tails")
    return got.select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "expected_grade",
        tails[0].alias("tail_usable"), tails[1].alias("tail_best"), (tails[0] >= KEEP_TAIL).alias("keep"),
    )
