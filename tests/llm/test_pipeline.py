"""The pipeline, stage by stage, against the definitions of its five operators, over a table with nulls, empty and repeated rows, rows that share a doc_id, and clashing columns."""

from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from fathom.llm import toxicity

from .test_operators import BENCH, ROWS, WORD, alike

KINDS = "doc_id long, text string, lang string, source string, n_chars long, h long, spans string, __id long, `a.b` string, text_ string, `c``0` int, row string"


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def without_copies(rows: list[tuple]) -> list[tuple]:
    def print_of(text):
        w = WORD.findall(lower(text))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(len(w) - 2, 1))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [print_of(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((r[0] for r, x in zip(rows, group, strict=True) if x == g and r[0] is not None), default=None) for g in group}
    return [r for r, g in zip(rows, group, strict=True) if r[0] is None or r[0] == least[g]]


def without_repeats(rows: list[tuple]) -> list[tuple]:
    first: dict[tuple, int] = {}
    for r in rows:
        w = WORD.findall(r[1] or "")
        for k in range(len(w) - 49 if r[0] is not None else 0):
            first[tuple(w[k : k + 50])] = min(first.get(tuple(w[k : k + 50]), r[0]), r[0])
    out = []
    for r in rows:
        w = WORD.findall(r[1] or "")
        gone = {j for k in range(len(w) - 49 if r[0] is not None else 0) if first[tuple(w[k : k + 50])] < r[0] for j in range(k, k + 50)}
        text = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((r[0], text, *r[2:4], len(text), *r[5:]) if gone else r)
    return out


def without_benchmark(rows: list[tuple], items: list[tuple]) -> list[tuple]:
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {tuple(w[k : k + 13]) for i, t in items if i is not None and (w := words(t)) for k in range(max(len(w) - 12, 1))}
    out = []
    for r in rows:
        w = words(r[1])
        hit = {j for win in windows for k in range(len(w) - len(win) + 1) if tuple(w[k : k + len(win)]) == win for j in range(k, k + len(win))}
        if not hit or 20 * len(hit) < len(w):
            out.append(r)
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("sf"))
    a, b = alike()
    texts = [*ROWS, (9001, ROWS[1][1]), (9001, "a clean text under a doc_id that another text has too"), (9002, " ".join([a] * 60)), (9003, " ".join([b] * 60))]
    texts += [(9100 + i, f"vile{i % 3} filth scum {t}") for i, (_, t) in enumerate(ROWS[:30])]
    rows = [(i, t, None, f"r{k}", len(t or ""), k, "s", k, "t", None, k, "u") for k, (i, t) in enumerate(texts)]
    labels = [(i, 1, 0) for i, t in ROWS[:40]] + [(9100 + i, 0, 1) for i in range(30)]
    spark.createDataFrame(rows, KINDS).repartition(3).write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    spark.createDataFrame([(1, BENCH), (2, None), (None, "one")], "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
    return to


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    bad = {r.doc_id for r in toxicity.op5(docs, labels).where("predicted = 1").collect()}
    assert len(bad & {9100 + i for i in range(30)}) > 20 and len(bad) <= 30
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    steps = [lambda rows: [r for r in rows if r[0] not in bad], without_copies, without_repeats, lambda rows: without_benchmark(rows, items)]
    rows = [tuple(r) for r in docs.collect()]
    for k, ((name, stage), step) in enumerate(zip(corpus_pipeline.STAGES[:-1], steps, strict=True)):
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs, want = spark.read.parquet(str(tmp_path / name)), step(rows)
        rows = [tuple(r) for r in docs.collect()]
        assert docs.schema.simpleString() == spark.read.parquet(f"{folder}/documents.parquet").schema.simpleString()
        assert sorted(rows, key=repr) == sorted(want, key=repr), name
        assert 0 < len(rows) and (k == 2 or len(rows) < len(step(rows)) + 1)
    pieces = corpus_pipeline.run(spark, folder).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(r[0], [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    whole = sorted((str(d), x) for d, own in ids for x in own)
    assert sum(p.length for p in pieces) == len(whole) and {p.doc_id for p in pieces} == {d for d, _ in ids}
    assert all(any(d == p.doc_id and len(own) == p.doc_tokens and crc(own[p.start : p.start + p.length]) == p.ids_crc32 for d, own in ids) for p in pieces)


def test_stages_on_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:  # no label, no item: the stages still run
        assert stage(spark, docs, str(tmp_path)).count() > 0
