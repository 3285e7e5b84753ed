"""Hashed text features, and a bounded sample of labelled documents, for the classifiers."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Words, id_and_text, mix

#: Training rows at most; the model is fitted on these, taken by a hash of doc_id from all labelled rows that may be learnt from.
MAX_TRAIN_ROWS = 16_384
#: Words of letters and digits (all that isn't ASCII counts as such), and runs of other signs.
_LETTERS = re.compile(rb"[0-9A-Za-z\x80-\xFF]+").findall
_SIGNS = re.compile(rb"[\x00-\x08\x0E-\x1F\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall


def features(texts: list[bytes], bits: int) -> list[np.ndarray]:
    """For each text its feature numbers: hashed words (lower-cased letters and digits), pairs of neighbours, and pairs with one word between."""
    words = Words(texts, lower=True, split=_LETTERS)
    h, mask, out = words.hash, np.uint64((1 << bits) - 1), []
    pair = mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) else h
    skip = mix(h[:-2] * np.uint64(5) + h[2:] + np.uint64(1)) if len(h) > 1 else h[:0]
    for i in range(len(texts)):
        a, b = words.offsets[i], words.offsets[i + 1]
        own = [h[a:b], pair[a : max(a, b - 1)], skip[a : max(a, b - 2)]]
        out.append((np.concatenate(own) & mask).astype(np.int64))
    return out


def style_features(texts: list[bytes], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text distinct feature numbers and values, in two groups of length 1 at most each: hashed words, and hashed runs of other signs with a mark for each word that repeats the one before it."""
    words, runs = Words(texts, lower=True, split=_LETTERS), Words(texts, split=_SIGNS)
    mask, out = np.uint64((1 << bits) - 1), []
    for i in range(len(texts)):
        h, r = words.hash[words.offsets[i] : words.offsets[i + 1]], runs.hash[runs.offsets[i] : runs.offsets[i + 1]]
        again = np.full(int((h[1:] == h[:-1]).sum()), 11, np.uint64)
        group = []
        for x in (h, mix(np.concatenate([r, again]) + np.uint64(7))):
            at, n = np.unique((x & mask).astype(np.int64), return_counts=True)
            v = 1 + np.log(n)
            group.append((at.astype(np.int32), (v / max(1.0, np.sqrt((v * v).sum()))).astype(np.float32)))
        out.append((np.concatenate([group[0][0], group[1][0]]), np.concatenate([group[0][1], group[1][1]])))
    return out


def training_rows(docs: DataFrame, labels: DataFrame, label: Column, learn: Column, limit: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(rank, text, label) of at most limit labelled documents, in one partition. Labels that are null, and rows without a doc_id, are not learnt from; a document with several labels takes the largest."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label.alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & learn)
    chosen = named.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("rank", F.xxhash64("doc_id")).orderBy("rank", "doc_id").limit(limit)
    texts = id_and_text(docs).join(F.broadcast(chosen), "doc_id")  # bounded: limit rows of three numbers
    return texts.select("rank", "doc_id", "text", "label").repartition(1).sortWithinPartitions("rank", "doc_id", "text")
