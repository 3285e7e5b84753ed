"""An interpolated modified Kneser-Ney bigram model, counted in Spark, for the perplexity of texts.

Counting: tasks count the words and pairs of what they read and send each distinct one once, pairs in lists by their
first word; the lists are merged by buckets of the first word. There is a bucket for each BUCKET_TOKENS tokens, which
are counted first and are as many as the pairs that are sent at most, so buckets grow in number and not in size. Words
that make up a two-thousandth of all tokens or an eighth of a bucket are dealt by both words of the pair, so that no
bucket grows with one word; they are marked in a bitmap of fixed size, and so is, now and then, a word that is rare,
which costs a few bytes and changes nothing else.
Storage: each bucket, also an empty one, becomes one file in the shared folder with sorted hash arrays; workers map the
files into memory and read the pages they need. Of a store that can't be mapped they hold the files used last. A file
that is missing fails the job.
Scoring: documents are scored where they are read; each distinct pair of a batch is looked up once, in order.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` in lower case (A to Z) and one end for each text. They are identified by XXH3
hashes of 128 bits under a seed that is drawn anew for each training, so nobody can prepare words that look alike, and
counts of tokens, the vocabulary and what is known of a text are of words told apart. Pairs are named by the first 64
bits of both words: of a billion words two share those with a chance of 3 in 100, which moves their pairs' counts only.
"""

from __future__ import annotations

import mmap
import os
import secrets
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Words, crc_mod, discard, id_and_text, kept, let_go, mix, shared_path, text_chunks, written

END, BEGIN = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
#: Bits of the map of hot words, a power of two.
HOT_BITS = 1 << 16
#: Words that have this share of all tokens or more are hot.
HOT_SHARE = 1 / 2000
#: Tokens for each bucket: a task merges about as many pairs at once, however large the corpus is.
BUCKET_TOKENS = 500_000
#: Pairs that a task holds before it sends them.
HELD = 2_000_000
#: Pairs in a batch of lists.
SENT = 250_000
SCORE_BYTES = 4 << 20
#: Of a store that can't be mapped a worker holds copies of so many bytes at most.
COPIED_BYTES = 256 << 20
_HEAD = struct.Struct("<QQ")


def tokens_of(texts: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens, each text's followed by END: the first 64 bits of their hashes, the others (0 for END), and where each text's begin (one more than texts)."""
    words = Words(texts, lower=True, hashes=lambda held: np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, held, repeat(seed))), "<u8").reshape(-1, 2))
    at = words.offsets[1:] + np.arange(len(texts))
    return np.insert(words.hash[:, 0], words.offsets[1:], END), np.insert(words.hash[:, 1], words.offsets[1:], np.uint64(0)), np.concatenate([[0], at + 1])


def runs(w: np.ndarray, w2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): an order by w, and where in it a word begins; a word may begin again if another shares its w."""
    order = np.argsort(w, kind="stable")
    return order, np.flatnonzero((np.diff(w[order], prepend=~w[order[:1]]) != 0) | (np.diff(w2[order], prepend=w2[order[:1]]) != 0)) if len(w) else order


def contexts_of(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    before = np.concatenate([[BEGIN], tokens[:-1]]) if len(tokens) else tokens
    before[offsets[:-1]] = BEGIN
    return before


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * np.uint64(0x9E3779B97F4A7C15) + w)


def _top(x: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each hash; rising with the hash."""
    return ((x >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def hot_map(places: list[int]) -> bytes:
    """A bit for each of HOT_BITS places."""
    bits = np.zeros(HOT_BITS, np.uint8)
    bits[places] = 1
    return np.packbits(bits).tobytes()


def buckets_of(v: np.ndarray, pair: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """hot: for each place of the map whether its words are dealt by the pair."""
    return np.where(hot[(v & np.uint64(HOT_BITS - 1)).astype(np.int64)], _top(pair, buckets), _top(v, buckets))


def _hot(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)


# ---------------------------------------------------------------- files in the shared folder


def _local(uri: str) -> str | None:
    """The path of a file: URI; None for other schemes. shared_path() gives URIs of Spark's own file system, with their scheme."""
    if "://" not in uri and not uri.startswith("file:"):
        raise ValueError(f"{uri} names no file system")
    return "/" + uri[5:].lstrip("/") if uri.startswith("file:") else None


def save(uri: str, arrays: list[np.ndarray]) -> None:
    """Arrays one after another, each from a multiple of 8 bytes on. The file gets its name once it is whole, so a task that runs again, or twice at once, does no harm."""
    body = b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays)
    part = f"{uri.rpartition('/')[0]}/.part-{uuid.uuid4().hex}"
    if (path := _local(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(_local(part), "wb") as f:
            f.write(body)
        os.replace(_local(part), path)
        return
    system, path = fs.FileSystem.from_uri(uri)
    own = fs.FileSystem.from_uri(part)[1]
    with system.open_output_stream(own) as f:
        f.write(body)
    system.move(own, path)


def mapped(uri: str) -> tuple[np.ndarray, int]:
    """The file's bytes, mapped into memory, and 0; of a store that can't be mapped a copy in memory, and its size. A missing file raises: each bucket has one."""
    if (path := _local(uri)) is not None:
        with open(path, "rb") as f:  # holds no open file: a process may have fewer than there are buckets
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False), np.uint8), 0
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path) as f:
        raw = np.frombuffer(f.read(), np.uint8)
    return raw, len(raw)


def _views(raw: np.ndarray, kinds: list[tuple[str, int]]) -> list[np.ndarray]:
    out, at = [], 0
    for kind, n in kinds:
        size = np.dtype(kind).itemsize * n
        out.append(raw[at : at + size].view(kind) if n else np.zeros(0, kind))
        at += size + -size % 8
    return out


# ---------------------------------------------------------------- counting


def _count_words(seed: int):
    def merged(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w, w2, c = (np.concatenate(x) for x in zip(*held, strict=True))
        order, starts = runs(w, w2)
        return w[order[starts]], w2[order[starts]], np.add.reduceat(c[order], starts)

    def batch_of(w, w2, c) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(c)], ["w", "w2", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held: list[tuple] = []
        n = 0
        for batch in batches:
            for _, _, texts in text_chunks(batch):
                w, w2, _ = tokens_of(texts, seed)
                held.append(merged([(w, w2, np.ones(len(w), np.int64))]))
                n += len(held[-1][0])
                if n > HELD:
                    held = [merged(held)]
                    n = len(held[0][0])
                    if n > HELD // 2:
                        yield batch_of(*held[0])
                        held, n = [], 0
        if held:
            yield batch_of(*merged(held))

    return run


def _count_pairs(packed: bytes, buckets: int, seed: int):
    hot = _hot(packed)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        k, *cells = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), *(pa.array(x, pa.binary()) for x in cells)], ["bucket", "v", "n", "w", "c"])

    def lists(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        v, w = (np.concatenate(x) for x in zip(*held, strict=True))
        h = pair_hash(v, w)
        h, first, c = np.unique(h, return_index=True, return_counts=True)
        v, w = v[first], w[first]
        bucket = buckets_of(v, h, hot, buckets)
        order = np.lexsort((v, bucket))
        v, w, c, bucket = v[order], w[order], c[order], bucket[order]
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        rows, size = [], 0
        for k in np.flatnonzero(np.diff(edges)):
            a, b = edges[k], edges[k + 1]
            own, n = np.unique(v[a:b], return_counts=True)
            rows.append((k, *(x.tobytes() for x in (own, n.astype("<u4"), w[a:b], c[a:b].astype("<u4")))))
            size += b - a
            if size >= SENT:
                yield batch_of(rows)
                rows, size = [], 0
        if rows:
            yield batch_of(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for a, b, texts in text_chunks(batch):
                t, _, offsets = tokens_of(texts, seed)
                held.append((contexts_of(t, offsets), t))
                n += len(t)
                if n >= HELD:
                    yield from lists(held)
                    held, n = [], 0
        if held:
            yield from lists(held)

    return run


_STATS = ["total", "n1", "n2", "n3", "three", "four", "cont"]


def _merge_pairs(path: str):
    """Writes a bucket's file; returns for its words what they add as contexts (total, pairs seen once, twice, more often, exactly three and four times) and as continuations."""

    def run(table: pa.Table) -> pa.Table:
        let_go()
        get = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])
        v, w, c = np.repeat(get("v", "<u8"), get("n", "<u4")), get("w", "<u8"), get("c", "<u4")
        h, first, back = np.unique(pair_hash(v, w), return_index=True, return_inverse=True)
        v, w, c = v[first], w[first], np.bincount(back, c, len(h)).astype(np.uint64)
        big = np.flatnonzero(c >= 255)
        save(f"{path}/pairs-{table.column('bucket')[0].as_py()}", [np.array([len(h), len(big)], "<u8"), h, np.minimum(c, 255).astype(np.uint8), big.astype("<u8"), c[big]])
        own, at = np.unique(v, return_inverse=True)
        sums = [np.bincount(at, x, len(own)).astype(np.int64) for x in (c, c == 1, c == 2, c >= 3, c == 3, c == 4)]
        after, cont = np.unique(w, return_counts=True)
        words = np.concatenate([own, after]).view(np.int64)
        cols = [np.concatenate([s, np.zeros(len(after), np.int64)]) for s in sums] + [np.concatenate([np.zeros(len(own), np.int64), cont])]
        return pa.table([words, *cols], ["w", *_STATS])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """For counts of one, two, and three or more; of a corpus too small for the usual estimate, a plain half, one, and one and a half."""
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


@dataclass(frozen=True)
class Model:
    """Where the files are, and what holds for all of them."""

    path: str
    buckets: int
    hot: bytes
    seed: int
    tokens: int
    vocabulary: int
    pair_discounts: tuple[float, float, float]
    unknown: float


def _write_words(path: str):
    def run(table: pa.Table) -> pa.Table:
        let_go()
        k = table.column("bucket")[0].as_py()
        table = table.filter(pc.is_valid(table.column("w")))
        w, w2 = (table.column(c).to_numpy().view(np.uint64) for c in ("w", "w2"))
        order = np.lexsort((w2, w))
        cols = [table.column(c).to_numpy()[order] for c in ("c", "total", "gamma", "p")]
        save(f"{path}/words-{k}", [np.array([len(w), 0], "<u8"), w[order], w2[order], cols[0].astype("<i8"), cols[1].astype("<i8"), cols[2].astype("<f4"), cols[3].astype("<f8")])
        return pa.table([pa.array([len(w)], pa.int64())], ["n"])

    return run


def train(docs: DataFrame) -> Model:
    """Counts all docs (text) and writes the model's files to a new place in the shared folder. Without any document every token is unknown."""
    spark, seed = docs.sparkSession, secrets.randbits(64)
    path = shared_path(spark, "kn")
    text = docs.select("text")
    words = written(spark, text.mapInArrow(_count_words(seed), "w long, w2 long, c long").groupBy("w", "w2").agg(F.sum("c").alias("c")), "kn-words")
    tokens, vocabulary = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(32, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // BUCKET_TOKENS))
    often = max(1.0, min(tokens * HOT_SHARE, BUCKET_TOKENS / 8))
    place = F.col("w").bitwiseAND(F.lit(HOT_BITS - 1)).cast("int").alias("place")
    hot = hot_map([r.place for r in words.where(F.col("c") >= F.lit(often)).select(place).distinct().collect()] + [int(BEGIN) % HOT_BITS])  # HOT_BITS rows at most
    lists = text.mapInArrow(_count_pairs(hot, buckets, seed), "bucket int, v binary, n binary, w binary, c binary")
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))  # so that empty buckets have files too
    lists = lists.unionByName(every.select("bucket", *[F.lit(b"").alias(c) for c in "vnwc"]))
    stats = lists.groupBy("bucket").applyInArrow(_merge_pairs(path), "w long, " + ", ".join(f"{c} long" for c in _STATS))
    stats = written(spark, stats.groupBy("w").agg(*[F.sum(c).alias(c) for c in _STATS]), "kn-stats")
    of = lambda k: F.count_if(F.col("cont") == k)
    all_ = stats.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _STATS], of(1).alias("m1"), of(2).alias("m2"), of(3).alias("m3"), of(4).alias("m4"), F.count_if(F.col("cont") >= 3).alias("m3p")).first()
    d, e = discounts(all_.n1, all_.n2, all_.three, all_.four), discounts(all_.m1, all_.m2, all_.m3, all_.m4)
    pairs = max(all_.cont, 1)
    unknown = (e[0] * all_.m1 + e[1] * all_.m2 + e[2] * all_.m3p) / pairs / (vocabulary + 1) if all_.cont else 1.0
    cont = F.coalesce("cont", F.lit(0))
    less = F.when(cont >= 3, e[2]).when(cont == 2, e[1]).when(cont == 1, e[0]).otherwise(0.0)
    gamma = F.when(F.col("total") > 0, (d[0] * F.col("n1") + d[1] * F.col("n2") + d[2] * F.col("n3")) / F.col("total")).otherwise(1.0)
    full = stats.join(words, "w", "left").select("w", F.coalesce("w2", F.lit(0)).cast("long").alias("w2"), F.coalesce("c", F.lit(0)).cast("long").alias("c"), "total", gamma.cast("double").alias("gamma"), ((cont - less) / pairs + unknown).alias("p"))
    unsigned = F.shiftrightunsigned("w", 32)
    full = full.withColumn("bucket", F.shiftright(unsigned * buckets, 32).cast("int")).unionByName(every, allowMissingColumns=True)
    full.groupBy("bucket").applyInArrow(_write_words(path), "n long").agg(F.sum("n")).collect()
    discard(spark, words)
    discard(spark, stats)
    return Model(path, buckets, hot, seed, tokens, vocabulary, d, unknown)


# ---------------------------------------------------------------- scoring


class Store:
    """The files of a model in one worker, mapped when first needed."""

    def __init__(self, model: Model):
        self.m, self.hot = model, _hot(model.hot)
        self.maps: dict[tuple[str, int], list[np.ndarray]] = {}
        self.copied = 0

    def _arrays(self, kind: str, k: int) -> list[np.ndarray]:
        if (kind, k) not in self.maps:
            raw, copied = mapped(f"{self.m.path}/{kind}-{k}")
            self.copied += copied
            if self.copied > COPIED_BYTES:
                self.maps.clear()
                self.copied = copied
            n, big = _HEAD.unpack(raw[:16].tobytes())
            cols = [("<u8", n), ("u1", n), ("<u8", big), ("<u8", big)] if kind == "pairs" else [("<u8", n), ("<u8", n), ("<i8", n), ("<i8", n), ("<f4", n), ("<f8", n)]
            self.maps[kind, k] = _views(raw[16:], cols)
        return self.maps[kind, k]

    def words(self, w: np.ndarray, w2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Count, total as a context, weight of the lower order, and lower-order probability; w must be sorted."""
        out = (np.zeros(len(w), np.int64), np.zeros(len(w), np.int64), np.ones(len(w)), np.full(len(w), self.m.unknown))
        edges = np.searchsorted(_top(w, self.m.buckets), np.arange(self.m.buckets + 1))
        for k in np.flatnonzero(np.diff(edges)):
            a, b = edges[k], edges[k + 1]
            known, known2, *cols = self._arrays("words", int(k))
            at = np.searchsorted(known, w[a:b])
            hit = np.flatnonzero(at < len(known))
            hit = hit[known[at[hit]] == w[a:b][hit]]
            while len(other := hit[known2[at[hit]] != w2[a:b][hit]]):  # another word shares the first 64 bits: it may be the next
                at[other] += 1
                gone = other[(at[other] == len(known)) | (known[np.minimum(at[other], len(known) - 1)] != w[a:b][other])]
                hit = hit[~np.isin(hit, gone)]
            for to, col in zip(out, cols, strict=True):
                to[a + hit] = col[at[hit]]
        return out

    def pairs(self, v: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Counts of pairs with first word v and hash h; h must be sorted."""
        out = np.zeros(len(h), np.int64)
        bucket = buckets_of(v, h, self.hot, self.m.buckets)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.m.buckets + 1))
        for k in np.flatnonzero(np.diff(edges)):
            rows = order[edges[k] : edges[k + 1]]
            known, small, big, counts = self._arrays("pairs", int(k))
            at = np.searchsorted(known, h[rows])
            hit = np.flatnonzero(at < len(known))
            hit = hit[known[at[hit]] == h[rows][hit]]
            c = small[at[hit]].astype(np.int64)
            much = np.flatnonzero(c == 255)
            c[much] = counts[np.searchsorted(big, at[hit][much].astype(np.uint64))]
            out[rows[hit]] = c
        return out


def _store(model: Model) -> Store:
    return kept(("store", model), lambda: Store(model))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, d = _store(model), np.array([0.0, *model.pair_discounts])
        for batch in batches:
            for a, b, texts in text_chunks(batch, SCORE_BYTES):
                w, w2, offsets = tokens_of(texts, model.seed)
                v = contexts_of(w, offsets)
                all1, all2 = np.concatenate([[BEGIN], w]), np.concatenate([np.zeros(1, np.uint64), w2])
                order, first = runs(all1, all2)
                at = np.empty(len(order), np.int64)
                at[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
                count, total, gamma, p = store.words(all1[order[first]], all2[order[first]])
                begin, at = at[0], at[1:]
                before = np.concatenate([[begin], at[:-1]]) if len(at) else at
                before[offsets[:-1]] = begin
                h, first, back = np.unique(pair_hash(v, w), return_index=True, return_inverse=True)
                c = store.pairs(v[first], h)[back]
                seen = total[before] > 0
                direct = np.where(seen & (c > 0), (c - d[np.minimum(c, 3)]) / np.maximum(total[before], 1), 0.0)
                log = np.log10(direct + np.where(seen, gamma[before], 1.0) * p[at])
                base = np.log10((count[at] + 1) / (model.tokens + (model.vocabulary + 1)))
                starts = offsets[:-1]
                sums = lambda x: np.add.reduceat(x, starts) if len(x) else np.zeros(0)
                cols = [np.diff(offsets), sums((count[at] > 0).astype(np.int64)), sums(base), sums(log)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *map(pa.array, cols)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score): log10 probabilities of each text by the add-one unigram base and by the model. Null and empty texts are one end token; each row gives a row."""
    return id_and_text(docs).mapInArrow(_score(model), "doc_id long, n_tokens long, n_known long, base_score double, score double")


def perplexity(score: Column, n_tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -score / n_tokens)


def op9(docs: DataFrame) -> DataFrame:
    held = F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False))
    model = train(docs.where(~held))
    return scored(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
