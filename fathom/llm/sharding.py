"""Sharding by sampled splitters, with DataFrame functions only.

Rows are ordered by a key (here the hash of the text, then doc_id, so copies lie together). A sample in which a row's
chance grows with its size gives quantile boundaries, and rows are dealt into the ranges between them. A range that
holds more bytes or rows than its share is cut again by a sample of its own, until none is overfull. Running sums within
the ranges, on top of the totals of the ranges before, place each row exactly: a shard takes an equal share of the
bytes, to within a document.

Texts are read once, for keys and sizes, which are written to the shared folder; all else works on those. Samples and
boundaries stay in Spark: no key reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

RANGES_A_SHARD = 3
SAMPLE_A_PART = 24
MAX_ROWS_A_RANGE = 1_000_000
#: Parts that a range is cut into at once, and how often cuts are made one upon another: 64**9 ranges are more than any table has rows.
PARTS, LEVELS = 64, 9
#: Boundaries that are sent to all tasks; more are joined by a shuffle. One takes some 40 bytes.
MAX_SENT = 500_000
_LEAST = -(1 << 63)


def _key() -> Column:
    return F.struct("k", "id", "u")


def _overfull(rows: DataFrame, share: float, max_rows: int) -> DataFrame:
    """(r, bytes, parts) of the ranges with over one and a half shares of bytes beside their largest row, which can't be cut, or too many rows."""
    found = rows.groupBy("r").agg(F.sum("size").alias("bytes"), F.max("size").alias("most"), F.count(F.lit(1)).alias("n"))
    wanted = F.greatest(F.ceil((F.col("bytes") - F.col("most")) / (1.5 * share)), F.ceil(F.col("n") / max_rows))
    return found.select("r", "bytes", "n", F.least(wanted, F.lit(PARTS), F.col("n")).alias("parts")).where("parts > 1")


def _boundaries(rows: DataFrame, full: DataFrame, level: int) -> DataFrame:
    """(r, cuts): evenly spaced in a sorted sample of each overfull range, in which a row's chance grows with its size. SAMPLE_A_PART rows are expected of each part."""
    u = F.xxhash64("k", "id", "u", F.lit(level)).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / F.lit(float(1 << 53))
    drawn = rows.join(full, "r").where(u < F.col("size") * F.col("parts") * SAMPLE_A_PART / F.col("bytes"))
    keys = drawn.groupBy("r", "parts").agg(F.sort_array(F.collect_list(_key())).alias("keys"))
    at = F.transform(F.sequence(F.lit(1).cast("long"), F.col("parts") - 1), lambda i: F.get("keys", F.floor(F.size("keys") * i / F.col("parts")).cast("int")))
    return keys.select("r", F.array_distinct(at).alias("cuts"))


def shard(docs: DataFrame, shards: int = 40, key: Column | None = None, max_rows: int = MAX_ROWS_A_RANGE) -> DataFrame:
    """(doc_id, size, k, shard, slot, crc): crc is the CRC-32 of the text (null: empty), size is the UTF-8 bytes of the text (null: none) plus 16; shard takes an equal share of bytes in key order; slot counts from 0 in the shard.

    Rows with equal keys and doc_ids (repeated rows, or null doc_ids, which count as the smallest) are placed in the
    order in which they were read. With fewer rows than shards some shards are empty, as with an empty table all are.
    Columns other than these are not read.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    k = key if key is not None else F.xxhash64(text)
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), k.cast("long").alias("k"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("id"),
        F.monotonically_increasing_id().alias("u"), F.crc32(text.cast("binary")).alias("crc"),
    )
    rows = written(spark, rows, "shard")
    total = rows.agg(F.sum("size")).first()[0] or 0
    share = max(1.0, total / (shards * RANGES_A_SHARD))
    placed = rows.withColumn("r", F.lit(0).cast("long"))
    for level in range(LEVELS):
        full = written(spark, _overfull(placed, share, max_rows), "shard-full")
        n = full.count()
        if not n:
            break
        sent = F.broadcast if n * PARTS <= MAX_SENT else lambda x: x
        cuts = written(spark, _boundaries(placed, sent(full.select("r", "bytes", "parts")), level), "shard-cuts")
        part = F.size(F.filter(F.coalesce("cuts", F.array()), lambda s: s <= _key()))  # as many boundaries as are at or below the key
        placed = placed.join(sent(cuts), "r", "left").withColumn("r", F.col("r") * PARTS + part).drop("cuts")
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range, of a million rows or so: one task does
    sums = placed.groupBy("r").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    base = sums.select("r", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    w = Window.partitionBy("r").orderBy("k", "id", "u")
    sofar = placed.withColumn("b", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("n", F.row_number().over(w) - 1)
    middle = F.col("b0") + F.coalesce("b", F.lit(0)) + F.expr("size div 2")
    at = F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / F.lit(max(1, total))).cast("int"))
    numbered = sofar.join(base, "r").withColumn("shard", at).withColumn("g", F.col("n0") + F.col("n"))
    first = numbered.groupBy("shard").agg(F.min("g").alias("g0"))
    return numbered.join(F.broadcast(first), "shard").select("doc_id", "size", "k", "shard", (F.col("g") - F.col("g0")).alias("slot"), "crc")  # bounded: a row for each shard


def op1(docs: DataFrame, shards: int = 40) -> DataFrame:
    """The law is bytes: sizes of shards near equal."""
    return shard(docs, shards).select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
