"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within two bits of each other have a common neighbour within one bit. So every distinct
fingerprint emits the 65 values within one bit (half the radius), the shuffle is on those values, and those that
meet at a value are linked. A meeting is kept as one number: bit k is set if the fingerprint that differs in bit k
is there, and a flag if the value itself is. It needs constant space for a group of any size, copies are folded
into one fingerprint before, and at most 65 distinct fingerprints can meet; no pairs within groups are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import as_row, discard, id_and_text, let_go, shared_dir, text_chunks, written

_SHINGLE = 3
#: Neighbours that a task emits, about.
EMITTED = 4_000_000
_BITS = 1 << np.arange(64, dtype=np.uint64)


def fingerprint_of(text: bytes, width: int = _SHINGLE) -> int:
    """Fingerprint of one text: bit b is 1 if it is set in over half of the shingles' XXH64 (seed 42)."""
    words = text.lower().split()
    if not words:
        return 0
    h, space = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= width:
        shingles = [space(words)]
    elif width == 3:
        shingles = map(b"%b %b %b".__mod__, zip(words, words[1:], words[2:], strict=False))
    else:
        shingles = (space(words[i : i + width]) for i in range(len(words) - width + 1))
    hashes = np.array([h(s, 42) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(_BITS[2 * ones > len(hashes)].sum(dtype=np.uint64))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    for batch in batches:
        for a, b, texts in text_chunks(batch):
            fp = np.array([fingerprint_of(t) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("doc_id", "t")), pa.array(fp.view(np.int64))], ["doc_id", "t", "fp"])


def text_key(text: Column) -> Column:
    """A hash of the text, by which the rows of a repeated doc_id are told apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, t, fp): t is the text's key; a text without words, or a null one, has fingerprint 0. fp is the unsigned value's bits as a long."""
    return id_and_text(docs).withColumn("t", text_key(F.col("text"))).mapInArrow(_fingerprints, "doc_id long, t long, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) within two bits: for each value at which several meet, from the smallest to each other one."""
    mask = F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(64)])
    emitted = distinct.select("fp", F.posexplode(F.concat(mask, F.array(F.lit(0).cast("long")))).alias("k", "bit"))
    met = (
        emitted.select(F.col("fp").bitwiseXOR(F.col("bit")).alias("value"), "bit", (F.col("k") == 64).cast("int").alias("own"))
        .groupBy("value")
        .agg(F.bit_or("bit").alias("bits"), F.max("own").alias("own"))
        .where(F.bit_count("bits") + F.col("own") > 1)
    )
    # in the order of the bits, the value itself first: any fixed member can be the centre
    members = F.concat(
        F.when(F.col("own") == 1, F.array("value")).otherwise(F.array().cast("array<long>")),
        F.transform(F.filter(mask, lambda m: F.col("bits").bitwiseAND(m) != 0), lambda m: F.col("value").bitwiseXOR(m)),
    )
    pairs = met.select(members.alias("m")).select(F.element_at("m", 1).alias("a"), F.explode(F.slice("m", 2, 64)).alias("b"))
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that node reaches over edges (a, b); nodes without an edge are not returned.

    Large-star and small-star rounds; each is written to the shared folder, so lineage stays short and an executor
    can be lost. A star is an aggregate (the smallest neighbour) and a join, both of which Spark combines or splits
    for a node of many neighbours. Few rounds are needed: the number grows with the logarithm of the longest chain.
    """
    shared_dir(spark)
    state = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    now = written(spark, edges.where("a <> b").distinct(), "cc")
    was = state(now)
    while True:
        # large star: every larger neighbour links to the smallest of the node and its neighbours
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # small star: each node and its smaller neighbours link to the smallest of those
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        last, now = now, written(spark, small, "cc")
        discard(spark, last)
        if was == (was := state(now)):
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select("a", "a").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, t, fp, component_id): t is the text's key, and component_id is the smallest doc_id reachable over links of two bits or fewer.

    Null and empty texts have fingerprint 0 and link like any other. Copies have one fingerprint. A null doc_id gets
    a row and takes the component of its fingerprint, but never names one. Repeated rows are returned as often as
    given. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    fps = written(spark, fingerprints(docs), "simhash")
    first = written(spark, fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-first.count() * 65 // EMITTED))
    roots = components(spark, links(first.select("fp").repartition(tasks, "fp")))
    named = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", "t", "fp", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: of each group the row with the smallest doc_id stays.

    Links are those of near_duplicates(): two bits of 64, so a copy with more changes than that stays. Rows without a
    doc_id stay. Of rows that share a doc_id each is judged by its own text; rows that repeat both go or stay together. Other columns are carried along, whatever their names.
    """
    drop = near_duplicates(docs).where("doc_id <> component_id").select("doc_id", "t").distinct().select(F.struct("doc_id", "t").alias("drop"))
    same = (F.col("row.doc_id").cast("long") == F.col("drop.doc_id")) & (text_key(F.col("row.text")) == F.col("drop.t"))
    return as_row(docs).join(drop, same, "left_anti").select("row.*")


def op8(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
