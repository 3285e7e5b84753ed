"""Token ids of whole texts, and a binary file format for them.

Encoding: a tokenizer that never merges over a boundary between words gives a text's ids word by word, so the ids of
frequent words are kept in a bounded table and only new words reach the tokenizer. ``Encoder`` does this where the
boundary is certain and hands a text over whole where it isn't; results are those of the tokenizer on the whole text.

File format (little-endian): header, doc ids, doc ends, block offsets, then blocks of ids packed in ``width`` bits,
the fewest that hold the vocabulary. A block's offset leads to any id without reading what is before it, and a block
unpacks with a few numpy calls. Files are values of a binary column, so that Spark writes, commits and retries them.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import id_and_text, kept, let_go, shared_path, text_chunks

END_ID = 2
#: Memory that a Python worker has for the words it remembers, and what Python takes for an entry beside its bytes.
KNOWN_BYTES = 64 << 20
_ENTRY = 180
#: Runs of signs after words that it remembers beside them.
TAILS = 50_000
_MAGIC = b"FIDS"
_HEAD = struct.Struct("<4sBBHIQ")
BLOCK = 1024
#: The doc_id of files for documents without one.
NO_ID = -(1 << 63)
FILE_IDS = 1 << 20
#: Memory for words where files are written: byte-level words are dear to encode, and many.
FILES_ROOM = 160 << 20
#: Documents for each task that writes files, about; there are as many tasks as that takes. Texts pass through a task a few at a time, so long ones cost time and no memory.
TASK_ROWS = 20_000


class Known(dict):
    """A dict that asks ``new`` for what it doesn't have, and keeps the answer; size is about what it takes, in bytes."""

    def __init__(self, new):
        super().__init__()
        self.new, self.size = new, 0

    def __missing__(self, key):
        self[key] = value = self.new(key)
        self.size += len(key) + len(value) + _ENTRY
        return value


class Encoder:
    """split: "space" for byte-level tokenizers whose words begin with the space before them; "drop" for ones that lower-case and drop white space; None to encode whole texts only. plain: strings of special tokens within texts are text like any other."""

    #: Latin letters, which no normaliser changes but for case, and ASCII signs after them: two pre-tokens at most.
    WORD = re.compile("(\n?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")

    def __init__(self, path: str, split: str | None, plain: bool = False, room: int = KNOWN_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.split, self.known, self.tails = Tokenizer.from_file(path), split, Known(self._new), {}
        self.tokenizer.encode_special_tokens, self.room = plain, room
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.runs = re.compile(r"\s\s")
        # byte-level models spell bytes as printable characters: those that print as themselves, the others from U+0100 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.spelling = dict(zip(shown, shown, strict=True)) | {x: 0x100 + i for i, x in enumerate(sorted({*range(0x100)} - {*shown}))}

    def _ids(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.kind.itemsize == 2 else "I"
        return [array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, text: str) -> list[str] | None:
        """The text cut before each space or line end that stands alone between other characters; None if some don't stand alone."""
        if self.split is None or self.runs.search(text):
            return None
        return text.replace("\n", " \n").split(" ")

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.split == "drop":
            parts = [t.split() for t in texts]
            self._room(parts)
            return [np.frombuffer(b"".join(map(self.known.__getitem__, p)), self.kind) for p in parts]
        decoded = [t.decode() for t in texts]
        parts = [self._parts(t) for t in decoded]
        # the first part has no space before it; a text that isn't cut is one first part
        first = self._ids([p[0] if p else t for p, t in zip(parts, decoded, strict=True)])
        rest = [p[1:] if p else [] for p in parts]
        self._room(rest)
        return [np.frombuffer(b"".join([f, *map(self.known.__getitem__, p)]), self.kind) for f, p in zip(first, rest, strict=True)]

    def _room(self, parts: list[list]) -> None:
        """Once the table is full: what these texts have too is likely to come again, the rest goes."""
        if self.known.size > self.room:
            again = {w: self.known[w] for w in set().union(*parts)}
            self.known.clear()
            self.known.update(again)
            self.known.size = sum(len(w) + len(ids) + _ENTRY for w, ids in again.items())

    def _new(self, w) -> bytes:
        """Ids of a word seen for the first time: those of its letters and of the signs after them, or from the tokenizer."""
        drop = self.split == "drop"
        text = w.decode() if drop else w
        m = self.WORD.fullmatch(text)
        if not m or (drop and text[0] == "\n"):
            return self._ids([text if drop or text.startswith("\n") else " " + text])[0]
        head, tail = m.groups()
        if not tail:
            return self._word(head, drop)
        if (end := self.tails.get(tail)) is None:
            end = self._ids([tail])[0]
            if len(self.tails) < TAILS:
                self.tails[tail] = end
        return self.known[head.encode() if drop else head] + end

    def _word(self, head: str, drop: bool) -> bytes:
        """Ids of one pre-token of letters, with the space or line end before it that a byte-level model has there."""
        before, head = ("\n", head[1:]) if head[0] == "\n" else ("", head.lower()) if drop else ("", " " + head)
        tokens = self.tokenizer.model.tokenize(head.encode().decode("latin-1").translate(self.spelling))
        if before:
            tokens = self.tokenizer.model.tokenize(before.translate(self.spelling)) + tokens
        return array("H" if self.kind.itemsize == 2 else "I", [t.id for t in tokens]).tobytes()


def encoder(path: str, split: str | None, room: int = KNOWN_BYTES) -> Encoder:
    """One for each Python worker, until another operator runs in it."""
    return kept(("encoder", path, split, room), lambda: Encoder(path, split, room=room))


# ---------------------------------------------------------------- the file format


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids[:, None].astype(np.uint32) >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes | memoryview, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def file_bytes(doc_ids: list[int], docs: list[np.ndarray], vocabulary: int, block: int = BLOCK) -> bytes:
    """One file with the ids of some documents, in order."""
    width = bits_for(vocabulary)
    ids = np.concatenate([np.zeros(0, np.uint32), *docs])
    if len(ids) and int(ids.max()) >> width:
        raise ValueError("an id lies outside the vocabulary")
    packed = [pack_bits(ids[a : a + block], width) for a in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, packed)]).astype("<u8")
    ends = np.cumsum([len(d) for d in docs]).astype("<u8")
    head = _HEAD.pack(_MAGIC, 1, width, block, len(docs), len(ids))
    return b"".join([head, np.array(doc_ids, "<i8").tobytes(), ends.tobytes(), offsets.tobytes(), *packed])


class IdFile:
    """Reads a file of ids, whole or from any place on."""

    def __init__(self, data: bytes | memoryview):
        magic, version, self.width, self.block, n_docs, self.n_ids = _HEAD.unpack_from(data)
        if magic != _MAGIC or version != 1:
            raise ValueError("not a file of ids")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        self.ends = np.frombuffer(data, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at + 16 * n_docs).astype(np.int64)
        self.body = memoryview(data)[at + 16 * n_docs + 8 * (n_blocks + 1) :]

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids from start to end: only the blocks that hold them are read."""
        start, end = max(0, start), min(end, self.n_ids)
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block + 1
        if self.block * self.width % 8 == 0:  # full blocks have no gaps between them
            n = min(last * self.block, self.n_ids) - first * self.block
            got = unpack_bits(self.body[self.offsets[first] : self.offsets[last]], n, self.width)
        else:
            got = np.concatenate([unpack_bits(self.body[self.offsets[b] : self.offsets[b + 1]], min(self.block, self.n_ids - b * self.block), self.width) for b in range(first, last)])
        return got[start - first * self.block : end - first * self.block]

    def doc(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


# ---------------------------------------------------------------- writing and reading with Spark


def _to_files(path: str, split: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(path, split, FILES_ROOM), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        names: list[int] = []
        n = 0

        def flush():
            nonlocal held, names, n, seq
            data = file_bytes(names, held, enc.vocabulary)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], ["part", "seq", "n_ids", "file"])
            held, names, n, seq = [], [], 0, seq + 1
            return out

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for a, b, texts in text_chunks(batch):
                for doc_id, tokens in zip(ids[a:b], enc.encode(texts), strict=True):
                    held.append(np.append(tokens, enc.kind.type(end_id)))
                    names.append(doc_id)
                    n += len(tokens) + 1
                    if n >= FILE_IDS:
                        yield flush()
        if held:
            yield flush()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, split: str | None = None, end_id: int = END_ID) -> None:
    """Writes the ids of all documents, each followed by end_id, in ascending doc_id order to a folder of files.

    Null texts are empty. Rows without a doc_id come first, under the number NO_ID. Repeated rows are written as often
    as they occur, next to each other. An empty table gives an empty folder.
    """
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // TASK_ROWS + 1)
    rows = id_and_text(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    rows = rows.repartitionByRange(n, "doc_id", "t").sortWithinPartitions("doc_id", "t")  # t: so that rows that share a doc_id needn't share a task
    rows.mapInArrow(_to_files(tokenizer, split, end_id), "part int, seq int, n_ids long, file binary").write.parquet(path)


def _from_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    for batch in batches:
        for part, seq, data in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("file"), strict=True):
            f = IdFile(data.as_buffer())
            starts = np.concatenate([[0], f.ends[:-1]]).astype(np.int64)
            ids = f.ids(0, f.n_ids).astype("<u4")
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), f.ends.tolist(), strict=True)]
            n = len(starts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(f.doc_ids), pa.array(starts), pa.array(f.ends - starts), pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files of write_ids(), doc_id null for NO_ID: start counts the ids of all documents before."""
    schema = "part int, seq int, n_ids long, file binary"
    files = spark.read.schema(schema).parquet(path)
    # Bases of parts: a row for each, so one task does; bases of files within a part: by part.
    of_part = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    part_base = of_part.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("p0"))
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    file_base = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)).alias("f0"))
    base = file_base.join(part_base, "part").select("part", "seq", (F.col("p0") + F.col("f0")).alias("base"))
    digests = files.select("part", "seq", "file").mapInArrow(_from_files, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return digests.join(base, ["part", "seq"]).select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op3(docs: DataFrame, tokenizer: str) -> DataFrame:
    spark = docs.sparkSession
    path = shared_path(spark, "ids")
    write_ids(docs, path, tokenizer, "space")
    return read_digests(spark, path)
