"""Byte-level BPE from a file of ranks: encoding with a rank queue on a hierarchical bitmap, and decoding.

A text is cut into pre-tokens by a pattern; each is merged by itself. The queue has a bucket of positions for each
rank, and a bitmap of the ranks whose bucket isn't empty, of which a bit of the next level stands for 256: finding the
next rank takes one find-first-set a level, whatever the number of pairs that wait. Tokens are runs between positions of
a linked list. Entries of pairs that a merge changed stay in their bucket and are skipped when they come up, so a
pre-token of n bytes takes time in proportion to n log n, also where it is one word of megabytes.

A worker remembers the ids of pre-tokens in a table of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import CHUNK_BYTES, id_and_text, kept, text_chunks

#: Memory that a Python worker has for the pre-tokens it remembers, and what Python takes for an entry beside its bytes.
KNOWN_BYTES = 192 << 20
_ENTRY = 180
#: Pre-tokens of a very long text that are held at once.
HELD = 1 << 16
#: Bytes of a pre-token up to which its lists are plain ones.
SHORT = 4096
_WORD, _LOW = 8, 255
_BITS = [1 << k for k in range(256)]


class Bpe:
    """ranks: the id of each token's bytes, which is also its place in the order of merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.longest = ranks, max(map(len, ranks), default=0)
        #: The bitmap of ranks in words of 256 bits; the level above, with a bit for each word that isn't 0, belongs to a call. Both are empty after each call.
        self.words = [0] * ((max(ranks.values(), default=0) >> _WORD) + 1)
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"{len(missing)} bytes have no token")

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of the smallest rank is merged, the first of several, until none is in the vocabulary."""
        get, longest, words, bits = self.ranks.get, self.longest, self.words, _BITS
        if (whole := get(piece)) is not None:
            return [whole]
        n = len(piece)
        if n <= SHORT:
            after, before, now = [*range(1, n + 1)], [*range(-1, n - 1)], [-1] * n
        else:  # the same in 8 bytes a place
            after, before, now = array("q", range(1, n + 1)), array("q", range(-1, n - 1)), array("q", [-1]) * n
        # now: the rank of the pair that begins at a position; -1: none, or the position is inside a token
        buckets: dict[int, list[int]] = {}
        top = 0
        for i in range(n - 1):
            if (r := get(piece[i : i + 2])) is not None:
                now[i] = r
                if r in buckets:
                    buckets[r].append(i)  # ascending, so a heap
                else:
                    buckets[r] = [i]
                    words[r >> _WORD] |= bits[r & _LOW]
                    top |= 1 << (r >> _WORD)
        while top:
            k = (top & -top).bit_length() - 1
            word = words[k]
            rank = k << _WORD | (word & -word).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                words[k] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            if now[i] != rank:
                continue  # stale: a merge has changed this pair
            gone = after[i]
            now[gone] = now[i] = -1
            after[i] = end = after[gone]
            if end < n:
                before[end] = i
            # the pairs that the new token makes with what follows it and with what is before it
            left = before[i]
            for j, stop in ((i, after[end] if end < n else 0), (left, end)):
                if j < 0 or not stop:
                    continue
                now[j] = -1
                if stop - j <= longest and (r := get(piece[j:stop])) is not None:
                    now[j] = r
                    if r in buckets:
                        heappush(buckets[r], j)
                    else:
                        buckets[r] = [j]
                        words[r >> _WORD] |= bits[r & _LOW]
                        top |= 1 << (r >> _WORD)
        out, i = [], 0
        while i < n:
            out.append(get(piece[i : after[i]]))
            i = after[i]
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    """A file with a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Coder:
    """Encodes and decodes whole texts; knows again the pre-tokens that it has seen lately, in two generations of KNOWN_BYTES / 2 each."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.bpe, self.find = Bpe(ranks), regex.compile(pattern)
        size = max(ranks.values()) + 1
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.tokens: list[bytes | None] = [None] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def pre_tokens(self, text: str) -> Iterator[list[str]]:
        """All matches of the pattern, those of a very long text some at a time."""
        if len(text) <= CHUNK_BYTES:
            yield self.find.findall(text)
            return
        matches = self.find.finditer(text)
        while held := [m.group() for m in islice(matches, HELD)]:
            yield held

    def _ids(self, word: str) -> bytes:
        if (ids := self.old.get(word)) is None:
            ids = array(self.code, self.bpe.merge(word.encode())).tobytes()
        self.young[word] = ids
        self.size += len(word) + len(ids) + _ENTRY
        if self.size > KNOWN_BYTES // 2:
            self.old, self.young, self.size = self.young, {}, 0
        return ids

    def encode(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a text, in parts."""
        for words in self.pre_tokens(text):
            out = list(map(self.young.get, words))
            if None in out:
                out = [ids or self.young.get(w) or self._ids(w) for w, ids in zip(words, out, strict=True)]
            yield np.frombuffer(b"".join(out), self.kind)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; the file's own order of bytes, so a part may end within a character."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


# ---------------------------------------------------------------- digests of ids


class Decimals:
    """Ids as decimal text, by a table of digits."""

    def __init__(self, size: int):
        self.width = len(str(max(size - 1, 1)))
        n, columns = np.arange(size), []
        for k in range(self.width - 1, -1, -1):
            digit = (n // 10**k % 10 + 48).astype(np.uint8)
            columns.append(np.where(n >= 10**k if k else True, digit, 0).astype(np.uint8))
        self.digits = np.stack(columns, axis=1) if size else np.zeros((0, self.width), np.uint8)

    def text(self, ids: np.ndarray, marks: np.ndarray | int) -> bytes:
        """Each id followed by its mark (a byte; 0: none)."""
        cells = np.empty((len(ids), self.width + 1), np.uint8)
        cells[:, :-1] = self.digits[ids]
        cells[:, -1] = marks
        return cells.tobytes().translate(None, b"\0")


# ---------------------------------------------------------------- with Spark


def coder(path: str, pattern: str) -> Coder:
    """One for each Python worker, until another operator runs in it."""
    return kept(("bpe", path, pattern), lambda: Coder(read_ranks(path), pattern))


def _encode(path: str, pattern: str, what: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, decimals = coder(path, pattern), None
        for batch in batches:
            for a, b, texts in text_chunks(batch):
                rows = []
                for text in texts:
                    parts = own.encode(text.decode("utf-8", "replace"))
                    if what == "ids":
                        rows.append((np.concatenate([np.zeros(0, own.kind), *parts]).tolist(),))
                        continue
                    decimals = decimals or Decimals(len(own.tokens))
                    n, ids_hash, bytes_hash = 0, hashlib.sha256(), hashlib.sha256()
                    for ids in parts:
                        if len(ids):
                            shown = decimals.text(ids, 32)[:-1]
                            ids_hash.update(b" " + shown if n else shown)
                            bytes_hash.update(own.decode(ids))
                            n += len(ids)
                    rows.append((n, ids_hash.hexdigest(), bytes_hash.hexdigest()))
                names = ["ids"] if what == "ids" else ["n_tokens", "ids_sha256", "decoded_sha256"]
                kinds = [pa.list_(pa.int32())] if what == "ids" else [pa.int64(), pa.string(), pa.string()]
                columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *columns], ["doc_id", *names])

    return run


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every row's whole text, where it is read: no shuffle. Null and empty texts have no ids; repeated rows and rows without a doc_id get a row each; other columns are not read."""
    return id_and_text(docs).mapInArrow(_encode(path, pattern, "ids"), "doc_id long, ids array<int>")


def _decode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            column = batch.column("ids")
            texts = [None if ids is None else own.decode(np.array(ids, np.int64)).decode("utf-8", "replace") for ids in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decoded(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids). Ids that end within a character give its sign of replacement; null ids a null text; an id outside the vocabulary fails."""
    return ids.select("doc_id", "ids").mapInArrow(_decode(path, pattern), "doc_id long, text string")


def op12(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of every row's ids and of the bytes that they decode to. Null and empty texts have no ids (the digests are those of no bytes)."""
    return id_and_text(docs).mapInArrow(_encode(path, pattern, "digests"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
