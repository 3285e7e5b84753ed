"""The corpus pipeline: five stages over the documents, each written as Parquet and read back as the next one's input.

All but the last return the columns that they got, whatever their names; an empty table goes through all of them.

Toxic documents go; of each group of near-duplicates one document stays; repeated passages are cut; documents with
passages of the benchmark go; what is left is packed into sequences of tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fathom.llm import decontam, packing, simhash, substring, toxicity
from fathom.llm.shared import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores as toxic go. Null and empty texts score by the bias, each repeated row alike; rows without a doc_id are scored too. Without labels none goes."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays, and what repeats it; rows without a doc_id stay. Null and empty texts are copies of each other. Rows that share a doc_id are judged each by its text."""
    return simhash.deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a smaller doc_id has go from texts; every row stays, null texts stay null. Rows without a doc_id neither lose words nor take them."""
    return substring.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of whose words a twentieth or more are the benchmark's go, each by its own text; null and empty texts stay. Without benchmark items none goes."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a sequence; null and empty texts have only the end id, repeated rows are packed as often."""
    return packing.op7(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The classifier, the fingerprints and the tokens of the stages can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(spark, docs, name)
    return docs
