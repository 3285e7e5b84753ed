"""Helpers that the operators of this subpackage share: shared storage, Arrow batches, word hashes.

Texts are read from Arrow a chunk at a time, and very long ones are cut into words a piece at a time, so a task holds
Python objects for about CHUNK_BYTES of text, however large its batches are.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CHECKPOINT_DIR = "/tmp/fathom-checkpoints"
CHUNK_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = re.compile(rb"[\x09-\x0D\x20]")
_KEPT: dict = {}


# ---------------------------------------------------------------- shared storage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, with the scheme of its file system: spark.checkpoint.dir.

    Where that is unset a local session (tests) gets a folder of its own, and a cluster an error: no folder of one
    machine would do.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        told = DEFAULT_CHECKPOINT_DIR
    path = spark._jvm.org.apache.hadoop.fs.Path(told)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(whole)
    return whole.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder as Parquet and read back: lineage is cut and lost executors cost nothing."""
    path = shared_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Deletes a table of written() that nothing will read again."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """doc_id as long and text as string, and the extra columns under new names; columns that have the type already stay as they are, so equal scans stay equal in the plan."""
    kinds = dict(docs.dtypes)
    own = [F.col(c) if kinds[c] == t else F.col(c).cast(t).alias(c) for c, t in (("doc_id", "bigint"), ("text", "string"))]
    return docs.select(*own, *[F.col(quoted(c)).alias(to) for c, to in (extra or {}).items()])


def quoted(name: str) -> str:
    """A column's name as an expression, whatever signs it has."""
    return "`" + name.replace("`", "``") + "`"


def as_row(df: DataFrame) -> DataFrame:
    """df as one column, row: joined with others no name of its columns can clash; row.* gives them back."""
    return df.select(F.struct(*map(quoted, df.columns)).alias("row"))


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id written as text, modulo m."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(m)


# ---------------------------------------------------------------- batches


def text_chunks(batch: pa.RecordBatch, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(from, to, texts) of consecutive rows with about size bytes of text, one row at least; texts are UTF-8, null becomes empty."""
    column = batch.column("text")
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield at, to, [b"" if x is None else x for x in column.slice(at, to - at).to_pylist()]
        at, before = to, int(ends[to - 1])


def kept(key: tuple, make: Callable[[], object]):
    """What a Python worker keeps from one task to the next: one value, that of the operator that ran last."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """Drops what kept() keeps: operators that keep nothing call it, as workers are reused and would hold it on."""
    if _KEPT:
        _KEPT.clear()
        pa.default_memory_pool().release_unused()


# ---------------------------------------------------------------- hashes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each a followed by b."""
    return mix(a * _ODD + b)


def pieces(text: bytes, size: int = CHUNK_BYTES) -> Iterator[bytes]:
    """text in parts of about size bytes, cut at white space, so no word is cut; the white space at a cut goes."""
    at = 0
    while len(text) - at > size and (gap := _SPACE.search(text, at + size)):
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:] if at else text


class Words:
    """Words of some texts: hashes of their bytes (by default XXH3 of 64 bits), and where each text's begin (``offsets``, one more than texts).

    split gives the words of a text; by default they are ``[^\\x20\\x09-\\x0D]+``. White space must lie between words.
    hashes: an array with a row for each of a list of words.
    """

    def __init__(self, texts: list[bytes], lower: bool = False, split: Callable[[bytes], list[bytes]] = bytes.split, hashes: Callable[[list[bytes]], np.ndarray] | None = None):
        parts, counts, held = [], [], []

        def hashed():
            parts.append(hashes(held) if hashes else np.fromiter(map(xxhash.xxh3_64_intdigest, held), np.uint64, len(held)))

        for text in texts:
            n = 0
            for piece in pieces(text):
                words = split(piece.lower() if lower else piece)  # lower() of bytes: only A to Z
                held += words
                n += len(words)
                if len(held) > CHUNK_BYTES // 4:
                    hashed()
                    held = []
            counts.append(n)
        hashed()
        self.hash = np.concatenate(parts)
        self.offsets = np.cumsum([0, *counts])

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each width consecutive entries of h (none if there are fewer): of runs of 1, 2, 4, ... entries, put together and mixed."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, run, length = None, 0, h, 1
    while length <= width:
        if width & length:
            out = run[done : done + n] if out is None else join_hash(out, run[done : done + n])
            done += length
        if 2 * length <= width:
            run = join_hash(run[:-length], run[length:])
        length *= 2
    return out
