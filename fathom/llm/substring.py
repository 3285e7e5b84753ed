"""Exact substring dedup by fixed-block anchors.

A window of ``window`` words is removed if it also starts in a document with a smaller doc_id. Every document is cut
into reference blocks of half a window that do not overlap; any window holds one of its own document's blocks whole.
Every rolling block of every document probes them, and a hit grows as far as the repeat goes: all windows over a hit
are compared, word for word (by 128-bit BLAKE2b digests of their bytes), with the windows over hits in other documents.
Runs of windows that are found elsewhere are the maximal repeats; those with an earlier document are cut.

Documents are dealt into chunks of a few megabytes, once. A chunk names each different block, and later each different
window, once to the bucket of its hash, in lists of fixed-width entries; the bucket answers each chunk. So a passage
that a third of all documents share gives an entry for each chunk and not for each document, entries need no row of
their own, and chunks and buckets grow in number with the corpus and not in size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import Words, id_and_text, let_go, pieces, quoted, rolling, text_chunks

WINDOW = 50
#: Bytes of text in a chunk, and bytes of text whose entries share a bucket, about.
CHUNK_TEXT, BUCKET_TEXT = 4 << 20, 16 << 20
#: Tasks that share a text of many copies.
PARTS = 8
COPY, HIT, GONE = 0, 1, 2
_BITS = np.uint64((1 << 46) - 1)
_ENTRY = 6
_TOLD = "to int, kind int, who long, data binary"
_LISTS = "bucket int, chunk int, data binary"


# ---------------------------------------------------------------- lists of entries


def _bytes_of(x: np.ndarray, width: int) -> np.ndarray:
    """The low bytes of each number, a row for each."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def _numbers(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where equal rows of sorted columns begin."""
    n = len(sorted_columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return np.flatnonzero(new)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with the hash; another range of its bits than the entries keep decides where buckets are few."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _listed(chunk: int, bucket: np.ndarray, entries: np.ndarray) -> pa.Table:
    """A row for each bucket; entries (a row of bytes each) are in the order of the buckets."""
    at = _starts(bucket)
    data = [x.tobytes() for x in np.split(entries, at[1:])] if len(at) else []
    return pa.table([pa.array(bucket[at], pa.int32()), pa.array(np.full(len(at), chunk), pa.int32()), pa.array(data, pa.binary())], ["bucket", "chunk", "data"])


def _answers(lists: pa.Table, kind: int, row: np.ndarray, yes: np.ndarray, entries: np.ndarray) -> pa.Table:
    """To the chunk of each list those of its entries that are marked."""
    chosen = np.flatnonzero(yes)
    at = _starts(row[chosen])
    data = [x.tobytes() for x in np.split(entries[chosen], at[1:])] if len(at) else []
    chunk = lists.column("chunk").to_numpy()[row[chosen][at]]
    return pa.table([pa.array(chunk, pa.int32()), pa.array(np.full(len(at), kind), pa.int32()), pa.nulls(len(at), pa.int64()), pa.array(data, pa.binary())], ["to", "kind", "who", "data"])


# ---------------------------------------------------------------- one chunk


def _plain(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one space, and where each begins and ends."""
    whole = b" ".join(filter(None, (b" ".join(p.split()) for p in pieces(text))))
    if not whole:
        return whole, np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32)
    return whole, np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(whole)]])


class Chunk:
    """A chunk's documents, and what it has been told of them."""

    def __init__(self, docs: pa.Table, told: pa.Table, window: int):
        let_go()
        self.docs, self.window, self.block = docs, window, window // 2
        self.number = docs.column("chunk")[0].as_py() if docs.num_rows and "chunk" in docs.column_names else -1
        self.ids = docs.column("doc_id").fill_null(0).to_numpy()  # rows without a doc_id are in no chunk, and compared with none
        lists = {k: [] for k in (COPY, HIT, GONE)}
        for kind, doc_id, data in zip(*(told.column(c).to_pylist() for c in ("kind", "who", "data")), strict=True):
            lists[kind].append((doc_id, data) if kind == COPY else data)
        self.copies = set(lists[COPY])
        self.copy_ids = {i for i, _ in lists[COPY]}
        self.hits = np.unique(_numbers(b"".join(lists[HIT]), _ENTRY))
        self.gone = np.frombuffer(b"".join(lists[GONE]), "<u8").reshape(-1, 2)

    def is_copy(self, i: int, text: bytes) -> bool:
        """A copy of a whole text with a smaller doc_id loses every word that lies in a window, and shows no other document a window that the smaller doc_id doesn't show: it isn't compared."""
        return self.ids[i] in self.copy_ids and (int(self.ids[i]), hashlib.sha256(text).digest()) in self.copies

    def parts(self) -> Iterator[tuple[list[int], list[bytes], Words]]:
        """(numbers, texts, words) of the documents that are compared, some at a time."""
        first = 0
        for batch in self.docs.to_batches():
            for a, _, texts in text_chunks(batch):
                own = [(first + a + i, t) for i, t in enumerate(texts) if not self.is_copy(first + a + i, t)]
                if own:
                    numbers, texts = map(list, zip(*own, strict=True))
                    yield numbers, texts, Words(texts)
            first += batch.num_rows

    def blocks(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of the block that begins at each word, which document of the part that is, and the word's place in it; of the words at which a whole block begins."""
        h = rolling(words.hash, self.block)
        doc = np.repeat(np.arange(len(words.counts)), words.counts)[: len(h)]
        at = np.arange(len(h))
        whole = np.flatnonzero(at + self.block <= words.offsets[doc + 1])
        return h[whole], doc[whole], (at - words.offsets[doc])[whole]

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Digests (two numbers each), document and place of the windows over a block that was hit."""
        digests, docs, places = [], [], []
        for numbers, texts, words in self.parts() if len(self.hits) else ():
            h, doc, at = self.blocks(words)
            h &= _BITS
            hit = self.hits[np.minimum(np.searchsorted(self.hits, h), len(self.hits) - 1)] == h
            sums = np.zeros(words.offsets[-1] + self.window + 1, np.int64)
            sums[words.offsets[doc[hit]] + at[hit] + 1] = 1
            sums = np.cumsum(sums)
            for i in np.unique(doc[hit]).tolist():
                o, n = words.offsets[i], words.counts[i] - self.window + 1
                steps = self.window - self.block + 1  # blocks in a window
                over = np.flatnonzero(sums[o + steps : o + steps + n] > sums[o : o + n]) if n > 0 else ()
                if len(over):
                    whole, start, end = _plain(texts[i])
                    view, digest = memoryview(whole), hashlib.blake2b
                    digests.append(b"".join([digest(view[a:b], digest_size=16).digest() for a, b in zip(start[over].tolist(), end[over + self.window - 1].tolist(), strict=True)]))
                    docs.append(np.full(len(over), numbers[i]))
                    places.append(over)
        none = np.zeros(0, np.int64)
        return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2), np.concatenate([none, *docs]), np.concatenate([none, *places])


def _name_blocks(window: int, buckets: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        chunk = Chunk(docs, told, window)
        hashes, owners, refs = [], [], []
        for numbers, _, words in chunk.parts():
            h, doc, at = chunk.blocks(words)
            hashes.append(h)
            owners.append(chunk.ids[np.array(numbers)][doc])
            refs.append(at % chunk.block == 0)
        if not hashes:
            return _listed(chunk.number, np.zeros(0, np.int64), np.zeros((0, _ENTRY), np.uint8))
        h, owner, ref = map(np.concatenate, (hashes, owners, refs))
        order = np.argsort(h)
        h, owner, ref = h[order], owner[order], ref[order]
        at = _starts(h)
        if not len(at):
            return _listed(chunk.number, np.zeros(0, np.int64), np.zeros((0, _ENTRY), np.uint8))
        several = np.minimum.reduceat(owner, at) < np.maximum.reduceat(owner, at)
        flags = several.astype(np.uint64) | np.logical_or.reduceat(ref, at).astype(np.uint64) << np.uint64(1)
        return _listed(chunk.number, _bucket(h[at], buckets), _bytes_of((h[at] & _BITS) << np.uint64(2) | flags, _ENTRY))

    return run


def _match_blocks(lists: pa.Table) -> pa.Table:
    """Blocks that two chunks name, or one for several documents, and of which one at least is a reference block."""
    data = lists.column("data").to_pylist()
    e = _numbers(b"".join(data), _ENTRY)
    row = np.repeat(np.arange(len(data)), [len(x) // _ENTRY for x in data])
    h = e >> np.uint64(2)
    order = np.argsort(h)
    at = _starts(h[order])
    n = np.diff(np.append(at, len(h)))
    flags = np.bitwise_or.reduceat(e[order] & np.uint64(3), at) if len(at) else e
    hit = ((n > 1) | (flags & np.uint64(1) > 0)) & (flags & np.uint64(2) > 0)
    yes = np.zeros(len(h), bool)
    yes[order] = np.repeat(hit, n)
    return _answers(lists, HIT, row, yes, _bytes_of(h, _ENTRY))


def _name_windows(window: int, buckets: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        chunk = Chunk(docs, told, window)
        digest, doc, _ = chunk.windows()
        order = np.lexsort((digest[:, 1], digest[:, 0]))
        digest, at = digest[order], _starts(digest[order, 0], digest[order, 1])
        least = np.minimum.reduceat(chunk.ids[doc[order]], at) if len(at) else np.zeros(0, np.int64)
        entries = np.column_stack([digest[at], least.view(np.uint64)]).astype("<u8").view(np.uint8).reshape(len(at), 24)
        return _listed(chunk.number, _bucket(digest[at, 0], buckets), entries)

    return run


def _match_windows(lists: pa.Table) -> pa.Table:
    """Windows that a document of another chunk has, with a smaller doc_id than any of the chunk."""
    data = lists.column("data").to_pylist()
    e = np.frombuffer(b"".join(data), "<u8").reshape(-1, 3)
    row = np.repeat(np.arange(len(data)), [len(x) // 24 for x in data])
    order = np.lexsort((e[:, 1], e[:, 0]))
    at = _starts(e[order, 0], e[order, 1])
    own = e[:, 2].view(np.int64) if len(e) else np.zeros(0, np.int64)
    yes = np.zeros(len(e), bool)
    if len(at):
        yes[order] = np.repeat(np.minimum.reduceat(own[order], at), np.diff(np.append(at, len(e)))) < own[order]
    return _answers(lists, GONE, row, yes, np.ascontiguousarray(e[:, :2]).view(np.uint8).reshape(len(e), 16))


def _cut(window: int, texts_out: bool, extra: tuple[str, ...]):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        chunk = Chunk(docs, told, window)
        digest, doc, place = chunk.windows()
        owner = np.concatenate([chunk.ids[doc], np.full(len(chunk.gone), np.iinfo(np.int64).min)])  # what was told comes before any doc_id
        every = np.concatenate([digest, chunk.gone])
        order = np.lexsort((every[:, 1], every[:, 0]))
        at = _starts(every[order, 0], every[order, 1])
        least = np.zeros(len(every), np.int64)
        if len(at):
            least[order] = np.repeat(np.minimum.reduceat(owner[order], at), np.diff(np.append(at, len(every))))
        cut = (least < owner)[: len(doc)]
        by_doc: dict[int, np.ndarray] = {}
        if cut.any():
            doc, place = doc[cut], place[cut]  # in the order of the documents
            at = _starts(doc)
            by_doc = dict(zip(doc[at].tolist(), np.split(place, at[1:]), strict=True))
        n_words, removed, kept, i = [], [], [], 0
        for batch in docs.to_batches():
            valid = batch.column("text").is_valid().to_pylist()
            for a, _, texts in text_chunks(batch):
                for j, text in enumerate(texts):
                    whole, start, end = _plain(text)
                    rest, gone = whole, 0
                    if len(start) >= window and chunk.is_copy(i, text):
                        rest, gone = b"", len(start)
                    elif i in by_doc:
                        edge = np.zeros(len(start) + 1, np.int64)
                        np.add.at(edge, by_doc[i], 1)
                        np.add.at(edge, by_doc[i] + window, -1)
                        out = np.cumsum(edge)[:-1] > 0
                        gone = int(out.sum())
                        runs = np.flatnonzero(np.diff(np.concatenate([[True], out, [True]]).astype(np.int8)))
                        rest = b" ".join([whole[start[x] : end[y - 1]] for x, y in zip(runs[0::2].tolist(), runs[1::2].tolist(), strict=True)])
                    n_words.append(len(start))
                    removed.append(gone)
                    kept.append((None if not valid[a + j] else rest.decode() if gone else text.decode()) if texts_out else hashlib.sha256(rest).hexdigest())
                    i += 1
        return pa.table([docs.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), *map(docs.column, extra)], ["doc_id", "n_words", "n_removed", "kept", *extra])

    return run


def _uncut(cut: Callable[[pa.Table, pa.Table], pa.Table]):
    """The same for rows that are compared with none."""
    nothing = pa.table([pa.array([], k) for k in (pa.int32(), pa.int32(), pa.int64(), pa.binary())], ["to", "kind", "who", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from cut(pa.Table.from_batches([batch]), nothing).to_batches()

    return run


# ---------------------------------------------------------------- with Spark


def dedup_substrings(docs: DataFrame, window: int = WINDOW, texts: bool = True, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, *extra): kept is the text without the removed words (the text itself where none goes), or with texts=False the sha256 of the kept words joined by one space.

    Null and empty texts have no words; a null text stays null. Rows without a doc_id neither remove nor lose words.
    Rows that share a doc_id are one document: none removes a window from another; each is cut by its own text. Of
    columns other than doc_id and text only those named in extra are read; they are carried along, whatever their names.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    spark = docs.sparkSession
    plain = id_and_text(docs, {c: f"__{i}" for i, c in enumerate(extra)})
    named = plain.where("doc_id is not null")
    size = named.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    chunks = size // CHUNK_TEXT + 1
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_TEXT + 1)
    dealt = named.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    by_chunk = dealt.groupBy("chunk")  # the three passes over the texts use one exchange

    same = dealt.select("doc_id", "chunk", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("m"))
    first = same.groupBy("m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("m", "lo", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    met = same.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")).join(first, ["m", "part"]).where("doc_id > lo")
    copies = met.select(F.col("chunk").alias("to"), F.lit(COPY).alias("kind"), F.col("doc_id").alias("who"), F.col("m").alias("data"))

    blocks = by_chunk.cogroup(copies.groupBy("to")).applyInArrow(_name_blocks(window, buckets), _LISTS)
    told = copies.unionByName(blocks.groupBy("bucket").applyInArrow(_match_blocks, _TOLD))
    windows = by_chunk.cogroup(told.groupBy("to")).applyInArrow(_name_windows(window, buckets), _LISTS)
    told = told.unionByName(windows.groupBy("bucket").applyInArrow(_match_windows, _TOLD))
    columns = tuple(f.name for f in plain.schema.fields if f.name.startswith("__"))
    schema = StructType([*StructType.fromDDL("doc_id long, n_words long, n_removed long, kept string").fields, *[plain.schema[c] for c in columns]])
    cut = _cut(window, texts, columns)
    done = by_chunk.cogroup(told.groupBy("to")).applyInArrow(cut, schema)
    nameless = plain.where("doc_id is null").mapInArrow(_uncut(cut), schema)
    return done.unionByName(nameless).withColumnsRenamed({f"__{i}": c for i, c in enumerate(extra)})


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated passages cut from their texts; n_chars, where there is one, follows the text where words went. Nulls and repeated rows as in dedup_substrings()."""
    extra = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    got = dedup_substrings(docs.withColumnsRenamed({c: f"_{c}" for c in extra}), extra=tuple(f"_{c}" for c in extra))
    out = [F.col("doc_id") if c == "doc_id" else F.col("kept").alias("text") if c == "text" else F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("_n_chars")).cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(quoted(f"_{c}")).alias(c) for c in docs.columns]
    return got.select(*out)


def op4(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs, texts=False).withColumnRenamed("kept", "kept_sha256")
