"""The queries of this subpackage, each over its whole tables, and SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from . import alignment, bpe, decontam, kneser_ney, matroska, ordinal, packing, sharding, simhash, substring, tokens, toxicity, vector_codes
from .shared import table


def op1_sharding(spark, sf_dir):
    return sharding.op1(table(spark, sf_dir, "documents"))


def op2_decontamination(spark, sf_dir):
    return decontam.op2(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_ids(spark, sf_dir):
    return tokens.op3(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_substring_dedup(spark, sf_dir):
    return substring.op4(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    return toxicity.op5(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_matroska(spark, sf_dir):
    return matroska.op6(table(spark, sf_dir, "documents"))


def op7_packing(spark, sf_dir):
    return packing.op7(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_simhash(spark, sf_dir):
    return simhash.op8(table(spark, sf_dir, "documents"))


def op9_kneser_ney(spark, sf_dir):
    return kneser_ney.op9(table(spark, sf_dir, "documents"))


def op10_ordinal_quality(spark, sf_dir):
    return ordinal.op10(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_alignment(spark, sf_dir):
    return alignment.op11(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_byte_bpe(spark, sf_dir):
    return bpe.op12(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_vector_codes(spark, sf_dir):
    return vector_codes.op13(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_decontamination, op3_token_ids, op4_substring_dedup, op5_toxicity, op6_matroska, op7_packing, op8_simhash, op9_kneser_ney, op10_ordinal_quality, op11_alignment, op12_byte_bpe, op13_vector_codes)}
ORACLE_SQL = {"op2_decontamination": decontam.OP2_SQL, "op13_vector_codes": vector_codes.OP13_SQL}
