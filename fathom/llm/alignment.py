"""Alignment of the tokens of two tokenizers over the same bytes.

The ends of each tokenizer's tokens are bits of a packed bitset, one bit for each byte of the texts of a chunk. The AND
of both sets has the cuts that they share; popcounts lead from a cut to the numbers of the tokens before it (rank), and
from there to the range of tokens in each group (select). Each bit of the OR ends a stretch that lies in one token of
either side, so it is a link, and rank gives the two tokens.

Counts: a task sends each distinct id pair once with the number of its documents that hold it; Spark adds them up. The
ids of all pairs are bounded by the vocabularies, whatever the corpus: sorted arrays of pair, count and whether the
count is its A id's highest are written to the shared folder by A id, and read where documents' pairs are looked up.
A document's pairs are written beside its digest by the first pass, so texts are encoded once.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Decimals
from .kneser_ney import mapped, save
from .shared import discard, id_and_text, kept, let_go, shared_path, text_chunks, written
from .tokens import Encoder, bits_for

#: Memory that a Python worker has for the words it remembers, of either tokenizer.
KNOWN_BYTES = 128 << 20
#: Pairs that a task holds before it sends them.
HELD = 2_000_000
#: Files of counts: each has a share of the A ids and all pairs of them.
BUCKETS = 64
_MARK = "▁"
_NONE = np.zeros(0, np.uint16), np.zeros(0, np.uint16)
#: What Python takes for a word that is remembered, beside its bytes.
_ENTRY = 180


class Pieces:
    """The second tokenizer's ids of a text and the bytes of its pieces.

    Where no piece has a space mark after another character, merges never cross from a word to the spaces after it,
    so words with the spaces before them are encoded one by one and remembered.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.apart = _MARK in pieces and not any(_MARK in p.lstrip(_MARK) for p in pieces)
        self.kind = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.known: dict[str, bytes] = {}
        self.size = 0
        self.words = re.compile(" ( *(?:[^ ]+|$))")

    def _ids(self, texts: list[str]) -> list[bytes]:
        """Ids of space and text; the space itself is the model's to add, but not to nothing."""
        space = [self.model.piece_to_id(_MARK)]
        return [array(self.code, ids if t else space).tobytes() for t, ids in zip(texts, self.model.encode(texts, num_threads=1), strict=True)]

    def _parts(self, text: str) -> list[str]:
        """The text in parts that no merge crosses, each without the space before it."""
        if not text:
            return []
        if not self.apart or _MARK in text:
            return [text]
        runs = "  " in text or text[0] == " " or text[-1] == " "
        return self.words.findall(" " + text) if runs else text.split(" ")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = list(map(self._parts, texts))
        own = set().union(*parts)
        if self.size > KNOWN_BYTES:
            self.known = {w: ids for w in own if (ids := self.known.get(w)) is not None}
            self.size = sum(len(w) + len(ids) + _ENTRY for w, ids in self.known.items())
        if new := list(own - self.known.keys()):
            found = self._ids(new)
            self.known.update(zip(new, found, strict=True))
            self.size += sum(map(len, new)) + sum(map(len, found)) + _ENTRY * len(new)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, p)), self.kind) for p in parts]


class Pair:
    """Both tokenizers of a worker: A is byte-level (space and text), B adds the space itself."""

    def __init__(self, first: str, second: str):
        self.a, self.b = Encoder(first, "space", plain=True, room=KNOWN_BYTES), Pieces(second)
        spelt = {c: b for b, c in self.a.spelling.items()}
        tokens = [self.a.tokenizer.id_to_token(i) for i in range(self.a.vocabulary)]
        special = {i: t.content for i, t in self.a.tokenizer.get_added_tokens_decoder().items()}
        self.a_bytes = [special[i].encode() if i in special else bytes(spelt[ord(c)] for c in t) for i, t in enumerate(tokens)]
        #: A pair of ids is one number, the A id above the bits of B ids.
        self.shift = bits_for(len(self.b.bytes))
        self.bits = bits_for(len(self.a_bytes)) + self.shift
        self.key = np.dtype("<u4" if self.bits <= 32 else "<u8")
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b.bytes))

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(A ids, B ids) of each text; none where the text is empty or either side's bytes aren't those of space and text."""
        whole = [b" " + t for t in texts]
        out = list(zip(self.a.encode(whole), self.b.encode([t.decode() for t in texts]), strict=True))
        for k, (tokens, sizes) in enumerate(((self.a_bytes, self.a_sizes), (self.b.bytes, self.b_sizes))):
            ids = np.concatenate([x[k] for x in out])
            upto = np.cumsum(sizes[ids])
            lengths = np.diff(np.concatenate([[0], upto])[np.cumsum([0, *(len(x[k]) for x in out)])])
            if b"".join(map(tokens.__getitem__, ids.tolist())) != b"".join(whole) or (lengths != list(map(len, whole))).any():
                out = [x if b"".join(map(tokens.__getitem__, x[k].tolist())) == w else _NONE for x, w in zip(out, whole, strict=True)]
        return [x if t else _NONE for x, t in zip(out, texts, strict=True)]


# ---------------------------------------------------------------- bitsets


class Bits:
    """A packed set of numbers below n, in words of 64 bits, with the number of members before each word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, members: np.ndarray, n: int) -> Bits:
        """From ascending distinct members."""
        words = np.zeros(-(-n // 64), np.uint64)
        word, bit = members >> 6, np.uint64(1) << (members & 63).astype(np.uint64)
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        if len(starts):
            words[word[starts]] = np.bitwise_or.reduceat(bit, starts)
        return cls(words)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many members are below each number."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The k-th member each (from 0, ascending): the word by its count, within it by halves."""
        word = np.searchsorted(self.before, k, side="right") - 1
        rest, x, at = (k - self.before[word]).astype(np.int64), self.words[word], word * 64
        for half in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(x & np.uint64((1 << half) - 1)).astype(np.int64)
            up = rest >= low
            rest, at = rest - np.where(up, low, 0), at + np.where(up, half, 0)
            x = np.where(up, x >> np.uint64(half), x)
        return at

    def members(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def align(a_ends: np.ndarray, b_ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a_upto, b_upto, a_links, b_links) over n bytes from the last byte of each token: tokens of either side up to each shared cut, and the numbers of the linked tokens in order."""
    a, b = Bits.of(a_ends, n), Bits.of(b_ends, n)
    cuts, either = Bits(a.words & b.words).members(), Bits(a.words | b.words).members()
    return a.rank(cuts) + 1, b.rank(cuts) + 1, a.rank(either), b.rank(either)


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray, n: int, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the bytes of the k-th groups, from any place on."""
    both = Bits(Bits.of(a_ends, n).words & Bits.of(b_ends, n).words)
    return np.where(k > 0, both.select(np.maximum(k - 1, 0)) + 1, 0), both.select(k) + 1


# ---------------------------------------------------------------- with Spark


def _pass(first: str, second: str):
    """A row for each document with its distinct pairs (sorted) and how often each is linked, and rows (pair, n) of how many of a task's documents hold a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = kept(("pair", first, second), lambda: Pair(first, second))
        decimals = Decimals(max(len(pair.a_bytes), len(pair.b.bytes)))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "pair", "n"]

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

        def counts(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            none = [pa.nulls(len(keys), t) for t in (pa.int64(),) * 5 + (pa.string(), pa.binary(), pa.binary())]
            return pa.RecordBatch.from_arrays([*none, pa.array(keys.astype(np.int64)), pa.array(n)], names)

        size = 0
        for batch in batches:
            for x, y, texts in text_chunks(batch):
                ids = pair.encode(texts)
                rows, keys, doc = _documents(pair, ids, decimals)
                pairs, times, edges = _distinct(keys, doc, len(texts), pair)
                cells = [(pairs[i:j].tobytes(), _small(times[i:j])) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                none = pa.nulls(len(texts), pa.int64())
                columns = [pa.array(c) for c in rows[:4]] + [pa.array(rows[4], pa.string())] + [pa.array([c[k] for c in cells], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(x, y - x), *columns, none, none], names)
                own, n = np.unique(pairs, return_counts=True)
                held.append((own, n))
                size += len(own)
                if size > HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield counts(*held[0])
                        held, size = [], 0
        if held:
            yield counts(*merged())

    return run


def _documents(pair: Pair, ids: list[tuple[np.ndarray, np.ndarray]], decimals: Decimals) -> tuple[list, np.ndarray, np.ndarray]:
    """[n_a, n_b, n_groups, n_links, groups_sha256] of each document, and all links as pair keys with their documents' numbers. All documents are aligned as one text: each ends with a cut."""
    n_a, n_b = (np.array([len(x[k]) for x in ids], np.int64) for k in (0, 1))
    a, b = (np.concatenate([x[k] for x in ids]).astype(np.int64) for k in (0, 1))
    a_ends, b_ends = np.cumsum(pair.a_sizes[a]), np.cumsum(pair.b_sizes[b])
    a_upto, b_upto, a_at, b_at = align(a_ends - 1, b_ends - 1, int(a_ends[-1]) if len(a_ends) else 0)
    a_doc = np.repeat(np.arange(len(ids)), n_a)
    doc = a_doc[a_at]
    a_group, b_group = (np.repeat(np.arange(len(x)), np.diff(x, prepend=0)) for x in (a_upto, b_upto))
    # a1,a2|b1; : an A token stands after all B tokens of earlier groups, a B token after all A tokens of its own
    line, marks = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    a_place = np.arange(len(a)) + np.concatenate([[0], b_upto])[a_group]
    b_place = np.arange(len(b)) + a_upto[b_group]
    line[a_place], line[b_place] = a, b
    marks[a_place[a_upto - 1]] = ord("|")
    marks[b_place[b_upto - 1]] = ord(";")
    groups = np.bincount(a_doc[a_upto - 1], minlength=len(ids))
    shas, at = [], 0
    for n in (n_a + n_b).tolist():
        shas.append(hashlib.sha256(decimals.text(line[at : at + n], marks[at : at + n])[:-1]).hexdigest() if n else "")
        at += n
    keys = a[a_at] << pair.shift | b[b_at]
    return [n_a, n_b, groups.astype(np.int64), np.bincount(doc, minlength=len(ids)).astype(np.int64), shas], keys, doc


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int, pair: Pair) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys of each document one after another, how often each occurs, and where each document's begin (one more than documents)."""
    if pair.bits + max(n, 1).bit_length() <= 63:  # document and key are one number
        both = np.sort(doc << pair.bits | keys)
        new = np.flatnonzero(np.diff(both, prepend=-1))
        keys, doc = both[new] & (1 << pair.bits) - 1, both[new] >> pair.bits
    else:
        order = np.lexsort((keys, doc))
        keys, doc = keys[order], doc[order]
        new = np.flatnonzero((np.diff(keys, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
        keys, doc, both = keys[new], doc[new], order
    return keys.astype(pair.key), np.diff(np.append(new, len(both))), np.searchsorted(doc, np.arange(n + 1))


def _small(times: np.ndarray) -> bytes:
    """In one, two or four bytes each, the fewest that hold the largest."""
    most = int(times.max()) if len(times) else 0
    return times.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def _large(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _save(path: str, shift: int):
    """Writes a bucket's file: its pairs in order, their counts, and a mark for those with the highest count of their A id."""

    def run(table: pa.Table) -> pa.Table:
        let_go()
        keys, n = (table.column(c).to_numpy() for c in ("pair", "n"))
        order = np.argsort(keys)[np.count_nonzero(keys < 0) :]  # a negative key stands for an empty bucket
        keys, n = keys[order].astype("<u8"), n[order].astype("<i8")
        starts = np.flatnonzero(np.diff((keys >> np.uint64(shift)).astype(np.int64), prepend=-1))
        best = n == np.repeat(np.maximum.reduceat(n, starts), np.diff(np.append(starts, len(n)))) if len(n) else np.zeros(0, bool)
        save(f"{path}/counts-{table.column('bucket')[0].as_py()}", [np.array([len(n)], "<u8"), keys, n, best.astype(np.uint8)])
        return pa.table([pa.array([len(n)], pa.int64())], ["n"])

    return run


class Counts:
    """The files of counts in one worker, each opened when first needed."""

    def __init__(self, path: str, shift: int):
        self.path, self.shift, self.files = path, np.uint64(shift), {}

    def _file(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if k not in self.files:
            raw = mapped(f"{self.path}/counts-{k}")[0]
            n = int(raw[:8].view("<u8")[0])
            self.files[k] = raw[8 : 8 + 8 * n].view("<u8"), raw[8 + 8 * n : 8 + 16 * n].view("<i8"), raw[8 + 16 * n : 8 + 17 * n]
        return self.files[k]

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of distinct keys, all of which have one, and whether each is its A id's highest."""
        n, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        bucket = ((keys >> self.shift) % np.uint64(BUCKETS)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        for k in np.flatnonzero(np.diff(edges)):
            rows = order[edges[k] : edges[k + 1]]
            known, counts, high = self._file(int(k))
            at = np.searchsorted(known, keys[rows])
            n[rows], best[rows] = counts[at], high[at] > 0
        return n, best


def _look_up(path: str, shift: int, key: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = kept(("counts", path), lambda: Counts(path, shift))
        for batch in batches:
            pairs = [np.frombuffer(x, key) for x in batch.column("pairs").to_pylist()]
            own, at = np.unique(np.concatenate(pairs), return_inverse=True)
            n, best = counts.of(own.astype(np.uint64))
            much = np.concatenate([_large(x, len(p)) for x, p in zip(batch.column("times").to_pylist(), pairs, strict=True)])
            edges = np.concatenate([[0], np.cumsum([len(x) for x in pairs])])
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[edges]) for x in (much * best[at], much * n[at])]
            rest = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([*rest, *map(pa.array, sums), batch.column("groups_sha256")], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return run


def aligned(docs: DataFrame, first: str, second: str) -> DataFrame:
    """A row for each row of docs: numbers of tokens, groups and links, the digest of its groups, and what its links' counts say.

    first: a byte-level tokenizer's file; second: a SentencePiece model that adds a space before the text. Texts that are
    null, empty, or not the joined bytes of both have no tokens. Each row is a document, also rows that repeat or have no
    doc_id. An empty table gives an empty result. Other columns aren't read.
    """
    spark, pair = docs.sparkSession, Pair(first, second)
    names = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
    told = written(spark, id_and_text(docs).mapInArrow(_pass(first, second), names + ", pair long, n long"), "alignment")
    path = shared_path(spark, "alignment-counts")
    pairs = told.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n"))
    every = spark.range(BUCKETS).select(F.lit(-1).cast("long").alias("pair"), F.lit(0).cast("long").alias("n"), F.col("id").cast("int").alias("bucket"))
    dealt = pairs.withColumn("bucket", F.pmod(F.shiftright("pair", pair.shift), F.lit(BUCKETS)).cast("int")).unionByName(every)
    dealt.groupBy("bucket").applyInArrow(_save(path, pair.shift), "n long").agg(F.sum("n")).collect()
    own = told.where("pair is null").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
    return own.mapInArrow(_look_up(path, pair.shift, pair.key), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op11(docs: DataFrame, first: str, second: str) -> DataFrame:
    return aligned(docs, first, second)
