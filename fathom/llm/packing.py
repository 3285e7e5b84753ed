"""Packing token pieces into windows by Karmarkar-Karp multiway differencing.

A partial partition is a tuple of as many sums as there are windows. The two with the largest spread are merged so
that the largest sums of one meet the smallest of the other; what remains is one partition with near-equal windows.
If a window exceeds the capacity, one more window is tried.

Documents are tokenised and packed where they are read: a task fills groups of about ``group`` windows one after
another and packs each, so nothing is shuffled and a task holds one group at a time, however large its input is.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .shared import id_and_text, text_chunks
from .tokens import END_ID, encoder

CAPACITY = 4096
GROUP = 64
PIECE = 512


def karmarkar_karp(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of sizes in at most k windows of near-equal sums; ties go by the order of the sizes."""
    # (spread negated, age, windows in use by falling sum); the other windows of a partial partition are empty
    heap = [(-size, i, [(size, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    age = len(sizes)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        shared = max(0, len(a) + len(b) - k)  # so many windows of a, its smallest, meet as many of b, its smallest last
        met = [(s + t, x + y) for (s, x), (t, y) in zip(a[len(a) - shared :], reversed(b[len(b) - shared :]), strict=True)]
        merged = sorted(a[: len(a) - shared] + met + b[: len(b) - shared], key=lambda w: -w[0])
        heapq.heappush(heap, ((merged[-1][0] if len(merged) == k else 0) - merged[0][0], age, merged))
        age += 1
    return [items for _, items in heap[0][2]] if heap else []


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most capacity: as few as the sum allows, or more where one would be exceeded."""
    full = [[i] for i, s in enumerate(sizes) if s == capacity]
    rest = [i for i, s in enumerate(sizes) if s < capacity]
    k = -(-sum(sizes[i] for i in rest) // capacity)
    while True:
        windows = karmarkar_karp([sizes[i] for i in rest], k) if rest else []
        if all(sum(sizes[rest[i]] for i in w) <= capacity for w in windows):
            return full + [[rest[i] for i in w] for w in windows if w]
        k += 1


def _packed(tokenizer: str, split: str | None, end_id: int, capacity: int, group: int, piece: int):
    target = (2 * group - 1) * capacity // 2  # half a window of slack lets the group fit into its windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, split)
        sequence = TaskContext.get().partitionId() << 33  # as monotonically_increasing_id does
        held: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        n = 0

        def flush():
            nonlocal held, n, sequence
            rows = []
            for window in pack([len(p[2]) for p in held], capacity):
                offset = 0
                for i in sorted(window):
                    doc_id, start, ids, total = held[i]
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4")), total, sequence, offset))
                    offset += len(ids)
                sequence += 1
            held, n = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], COLUMNS)

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for a, b, texts in text_chunks(batch):
                for doc_id, tokens in zip(names[a:b], enc.encode(texts), strict=True):
                    ids, at = np.append(tokens, enc.kind.type(end_id)), 0
                    while at < len(ids):
                        take = min(piece, len(ids) - at, target - n)
                        held.append((doc_id, at, ids[at : at + take], len(ids)))
                        at, n = at + take, n + take
                        if n == target:
                            yield flush()
        if held:
            yield flush()

    return run


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def packed(docs: DataFrame, tokenizer: str, split: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, group: int = GROUP, piece: int = PIECE) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts have only the end id. Rows without a doc_id are packed with a null id, repeated rows as often
    as they occur. An empty table gives no pieces. Which documents share a sequence follows the order of reading.
    """
    if not 1 <= piece <= capacity:
        raise ValueError("a piece must fit into a window")
    return id_and_text(docs).mapInArrow(_packed(tokenizer, split, end_id, capacity, group, piece), ", ".join(f"{c} long" for c in COLUMNS))


def op7(docs: DataFrame, tokenizer: str) -> DataFrame:
    return packed(docs, tokenizer, "drop")
