"""The operators against brute force, over a small table with nulls, empty and repeated texts, repeated rows, and a clashing column."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fathom.llm import decontam, kneser_ney, matroska, ordinal, packing, sharding, simhash, substring, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KEPT = "doc_id long, text string, lang string, source string, n_chars long, h long, kept string"


def table() -> list[tuple]:
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["Été", "naïve,", "x-y", "日本", "OK!"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, bench = say(60), say(20)
    texts = [say(rng.randint(1, 150)) for _ in range(30)]
    texts += [f"{say(20)} {passage} {say(9)}" for _ in range(12)] + [passage] * 5 + [f"{say(30)} {bench} {say(30)}", bench.upper(), say(4000)]
    texts += [None, "", "  \n ", "one", texts[0], texts[0] + " more", texts[3].upper(), texts[5].replace(" ", "\n\t", 3)]
    texts += [texts[7].rsplit(" ", 1)[0] for _ in range(4)]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    return [*rows, rows[2], (None, f"{say(20)} {passage} {bench}")], bench


def ordered(rows) -> list[tuple]:
    return sorted(map(tuple, rows), key=repr)


ROWS, BENCH = table()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), 7, "x") for i, t in ROWS], KEPT).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KEPT)


def ids_of(name: str) -> dict[str, list[int]]:
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return {x: t.encode(x or "", add_special_tokens=False).ids + [2] for _, x in ROWS}


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_sharding(docs, none):
    got = sharding.op1(docs, 7).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ROWS)
    text = dict(ROWS)
    for r in got:
        data = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(data) + 16, zlib.crc32(data))
    of = {}
    for r in got:
        of.setdefault(r.shard, []).append(r)
    assert all(sorted(x.slot for x in v) == list(range(len(v))) for v in of.values())
    share = sum(r["size"] for r in got) / 7
    longest = max(r["size"] for r in got)
    assert all(abs(sum(x["size"] for x in of.get(s, [])) - share) <= longest for s in range(7))
    assert sharding.op1(none).count() == 0


def test_decontamination(spark, docs, none):
    items = [(1, BENCH), (2, "one"), (10, BENCH + " tail"), (3, None), (None, BENCH)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - 12, 1) if w and i is not None else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    want, all_hits = [], []
    for d, t in ROWS:
        w, hit, found = words(t), set(), set()
        for win, names in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= names
        all_hits.append(hit)
        want.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    assert ordered(decontam.op2(docs, bench).collect()) == ordered(want)
    small = decontam.contamination(docs, bench, max_grams=0).select("doc_id", "n_words", "items")  # joined by a shuffle
    assert ordered((r.doc_id, len(r["items"])) for r in small.collect()) == ordered((x[0], x[3]) for x in want)
    assert decontam.op2(none, bench).count() == 0 and decontam.op2(docs, bench.limit(0)).where("contaminated").count() == 0
    kept = decontam.decontaminated(docs, bench)
    assert kept.columns == docs.columns
    bad = Counter(x[0] for x in want if x[5])
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in ROWS) - bad and None in bad
    clashing = docs.withColumnsRenamed({"h": "spans", "kept": "__spans", "lang": "bad"})
    cut = {r.doc_id: r.text for r in decontam.decontaminated(clashing, bench, "spans").select("doc_id", "text").collect()}
    hits = {d: h for (d, *_), h in zip(want, all_hits, strict=True)}
    for d, t in ROWS:
        w = words(t)
        assert words(cut[d]) == ([x for k, x in enumerate(w) if k not in hits[d]] if d in bad else w)
    two = spark.createDataFrame([(1, BENCH), (1, "clean words")], "doc_id long, text string")  # one doc_id, two texts
    assert [r.text for r in decontam.decontaminated(two, bench).collect()] == ["clean words"]


def test_token_ids(docs, none):
    path, ids = public_tokenizers.path("byte_bpe_50k.json"), ids_of("byte_bpe_50k.json")
    got = ordered(tokens.op3(docs, path).collect())
    at, want = 0, []
    for d, t in sorted(ROWS, key=lambda r: -1 if r[0] is None else r[0]):
        want.append((d, at, len(ids[t]), crc(ids[t])))
        at += len(ids[t])
    assert got == ordered(want)
    assert tokens.op3(none, path).count() == 0
    f = tokens.IdFile(tokens.file_bytes([1, 2], [np.arange(1500, dtype=np.uint32), np.array([49_999], np.uint32)], 50_000))
    assert f.width == 16 and f.ids(1020, 1030).tolist() == list(range(1020, 1030)) and f.doc(1).tolist() == [49_999]
    f = tokens.IdFile(tokens.file_bytes([1], [np.arange(3000, dtype=np.uint32)], 3000))
    assert f.width == 12 and f.ids(0, 3000).tolist() == list(range(3000)) and f.ids(2047, 2050).tolist() == [2047, 2048, 2049]


def test_substring(docs, none):
    first = {}
    for d, t in ROWS:
        w = WORD.findall(t or "")
        for k in range(len(w) - 49 if d is not None else 0):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, d), d)
    want = []
    for d, t in ROWS:
        w = WORD.findall(t or "")
        gone = {j for k in range(len(w) - 49) if d is not None and first[tuple(w[k : k + 50])] < d for j in range(k, k + 50)}
        want.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    assert ordered(substring.op4(docs).collect()) == ordered(want)
    assert sum(x[2] for x in want) > 500
    assert substring.op4(none).count() == 0 and substring.without_repeats(docs).columns == docs.columns


def alike(n: int = 1024) -> tuple[str, str]:
    """Two words of n letters that a sum of powers modulo 2**64 takes for one."""
    marks = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[m] for m in marks), "".join("ba"[m] for m in marks)


def test_words_that_look_alike(spark):
    a, b = alike()
    docs = spark.createDataFrame([(1, " ".join([a] * 60)), (2, " ".join([b] * 60)), (4, " ".join([a] * 60))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.op4(docs).collect()} == {1: 0, 2: 0, 4: 60}
    order = [a, b] * 20 + [b, a] * 20  # the same words in another order
    docs = spark.createDataFrame([(1, " ".join(order)), (2, " ".join(order[::-1]))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.op4(docs).collect()} == {1: 0, 2: len(order)}  # it is its own reverse
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    seen = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2)
    docs = spark.createDataFrame([(held, " ".join([a] * 60)), (seen, " ".join([b] * 60))], "doc_id long, text string")
    assert {r.doc_id: r.n_known for r in kneser_ney.op9(docs).collect()} == {held: 1, seen: 61}


def test_words_prepared_to_collide(spark):
    """Words of 32 bytes whose halves change places under a hash without a seed: equal there, told apart by a training's own seed."""
    words = [bytes.fromhex(h) + b"abcdefghijklmnop" for h in ("e9bf8e2e272e7701e9bf8e2e272e7708", "2d40633bf3ab91aa2d40633bf3ab91a3")]
    assert xxhash.xxh3_64_intdigest(words[0]) == xxhash.xxh3_64_intdigest(words[1])
    a, b = (w.decode() for w in words)
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    seen = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2)
    docs = spark.createDataFrame([(held, " ".join([a] * 60)), (seen, " ".join([b] * 60))], "doc_id long, text string")
    assert {r.doc_id: r.n_known for r in kneser_ney.op9(docs).collect()} == {held: 1, seen: 61}
    seeds = {kneser_ney.train(docs).seed for _ in range(2)}
    assert len(seeds) == 2


def test_words_that_share_the_first_half_of_their_hash(tmp_path):
    """The vocabulary's files tell them apart by the second half."""
    import pyarrow as pa

    n = 6
    w, w2 = np.array([5, 7, 7, 7, 9, 9], np.int64), np.array([1, 3, 2, 4, 8, 6], np.int64)
    table = pa.table({"w": w, "w2": w2, "c": np.arange(10, 10 + n), "total": np.arange(n), "gamma": np.ones(n), "p": np.ones(n), "bucket": np.zeros(n, np.int32)})
    kneser_ney._write_words(f"file://{tmp_path}")(table)
    store = kneser_ney.Store(kneser_ney.Model(f"file://{tmp_path}", 1, kneser_ney.hot_map([]), 0, 1, 1, (0.5, 1.0, 1.5), 0.1))
    ask = [(5, 1), (5, 2), (7, 2), (7, 3), (7, 4), (7, 9), (8, 1), (9, 6), (9, 8), (9, 9), (11, 1)]
    count = store.words(*(np.array(x, np.uint64) for x in zip(*ask, strict=True)))[0]
    assert count.tolist() == [10, 0, 12, 11, 13, 0, 0, 15, 14, 0, 0]
    assert [len(x) for x in kneser_ney.runs(np.zeros(0, np.uint64), np.zeros(0, np.uint64))] == [0, 0]


def test_substring_of_rows_that_share_a_doc_id(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(n))
    p, q = say(55), say(70)
    rows = [(5, f"{p} {say(10)}"), (5, f"{say(7)} {p}"), (5, q), (3, q), (9, f"{q} {p}"), (9, f"{q} {p}")]
    docs = spark.createDataFrame([(i, t, 1, f"x{k}", 2) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n_chars int, chunk string, kind int")
    got = {r.chunk: (len(r.text.split()), r.n_chars) for r in substring.without_repeats(docs).collect()}
    assert {k: n for k, (n, _) in got.items()} == {"x0": 65, "x1": 62, "x2": 0, "x3": 70, "x4": 0, "x5": 0}
    assert got["x3"] == (70, 1) and got["x2"] == (0, 0)


def test_very_long_texts(spark):
    """Texts of several megabytes, one of them a single word, go through every operator whole."""
    rng = random.Random(3)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(300_000)]
    long = " ".join(words)
    rows = [(1, long), (2, "head " + " ".join(words[100_000:]) + " tail"), (3, "x" * 3_000_000), (4, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(long) > 1.5e6
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.op4(docs).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (300_000, 0, sha(long)), 2: (200_002, 200_000, sha("head tail")), 3: (1, 0, sha("x" * 3_000_000)), 4: (300_000, 300_000, sha(""))}
    bench = spark.createDataFrame([(1, " ".join(words[299_980:]))], "item_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_hit) for r in decontam.op2(docs, bench).collect()} == {1: (300_000, 20), 2: (200_002, 20), 3: (1, 0), 4: (300_000, 20)}
    got = {r.doc_id: r.component_id for r in simhash.op8(docs).collect()}
    assert got[1] == got[4] == 1 and got[3] == 3
    path = public_tokenizers.path("word_bpe_49k.json")
    n = {i: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) + 1 for i, t in rows[:2]}
    sums = Counter()
    for r in packing.op7(docs.where("doc_id < 3"), path).collect():
        sums[r.doc_id] += r.length
    assert dict(sums) == n
    assert {r.doc_id: r.payload_bytes - r.payload_bytes % 192 for r in matroska.op6(docs).collect()} == {i: -(-len(t) // 192) * 192 for i, t in rows}
    assert {r.doc_id: r.n_tokens for r in kneser_ney.op9(docs).collect()} == {1: 300_001, 2: 200_003, 3: 2, 4: 300_001}
    assert {r["size"] for r in sharding.op1(docs).collect()} == {len(t) + 16 for _, t in rows}


def test_sharding_cuts_again(docs):
    """Ranges of four rows: cuts upon cuts, and the same places as with one."""
    of = lambda n: ordered((r.doc_id or -1, r["size"], r.shard) for r in sharding.shard(docs, 3, max_rows=n).collect())
    assert of(4) == of(1_000_000)
    spark = docs.sparkSession
    same = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.lit("copy").alias("text"))  # one key
    got = Counter(r.shard for r in sharding.shard(same, 5, max_rows=9).collect())
    assert got == {k: 100 for k in range(5)}


def test_simhash(docs, none):
    prints = {}
    for d, t in ROWS:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if repr(a) < repr(b) and (prints[a] ^ prints[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    names = {}
    for d in prints:
        if d is not None:
            names[find(d)] = min(names.get(find(d), d), d)
    want = [(d, f"{prints[d]:016x}", names.get(find(d))) for d, _ in ROWS]
    assert ordered(simhash.op8(docs).collect()) == ordered(want)
    gone = Counter(d for d, _ in ROWS if d is not None and names[find(d)] != d)
    assert Counter(r.doc_id for r in simhash.deduplicated(docs).collect()) == Counter(d for d, _ in ROWS) - gone and gone
    rows = [(1, "a b c d e"), (5, "a b c d e"), (5, "quite another text of its own")]  # one doc_id, two texts
    kept = simhash.deduplicated(docs.sparkSession.createDataFrame(rows, "doc_id long, text string"))
    assert ordered(kept.collect()) == [rows[0], rows[2]]
    assert simhash.op8(none).count() == 0


def test_chains_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(spark, edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


@pytest.mark.parametrize("op", [toxicity.op5, ordinal.op10])
def test_classifiers(spark, docs, none, op):
    labels = spark.createDataFrame([(i, int(i % 2), int("w7 " in (t or ""))) for i, t in ROWS[:40]] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = op(docs, labels)
    assert Counter(r.doc_id for r in got.collect()) == Counter(i for i, _ in ROWS)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.collect())
    assert op(none, labels).count() == 0 and op(docs, labels.limit(0)).count() == len(ROWS)
    other = labels.withColumn("toxic", 1 - labels.toxic).withColumn("quality", 1 - labels.quality)
    held = labels.where("crc32(cast(doc_id as string)) % 3 <> 1").unionByName(other.where("crc32(cast(doc_id as string)) % 3 = 1"))
    assert ordered(op(docs, held).collect()) == ordered(got.collect())  # held-out labels are not learnt from


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r.score, labels[r.doc_id]) for r in toxicity.op5(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).where("held_out").collect() if r.doc_id in labels]
    bad, good = [s for s, y in got if y], [s for s, y in got if not y]
    assert np.mean([(b > g) + (b == g) / 2 for b in bad for g in good]) > 0.9


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    grades = {r.doc_id: r.g for r in labels.select("doc_id", ordinal.grade(F.col("quality"), F.col("toxic")).alias("g")).collect()}
    got = [(r.expected_grade, grades[r.doc_id]) for r in ordinal.op10(docs, labels).where("held_out").collect() if grades.get(r.doc_id) is not None]
    pairs = [(x > y) + (x == y) / 2 for x, a in got for y, b in got if a > b]
    assert len(got) > 50 and np.mean(pairs) > 0.75


def test_ftrl_by_plain_loops():
    rng = random.Random(1)
    rows = [np.unique([rng.randint(0, 14) for _ in range(rng.randint(1, 6))]) for _ in range(120)]
    labels = np.array([float(3 in r or rng.random() < 0.2) for r in rows])
    p = toxicity.Ftrl(l1=0.4, epochs=2)
    z, n = [0.0] * 16, [0.0] * 16

    def weight(i):
        l1, l2 = (0.0, 0.0) if i == 15 else (p.l1, p.l2)
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((p.beta + n[i] ** 0.5) / p.alpha + l2)

    for _ in range(2):
        for r, y in zip(rows, labels, strict=True):
            at = [*map(int, r), 15]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in at:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / p.alpha * w[i]
                n[i] += g * g
    at, w, bias = p.fit(rows, labels, 15)
    got = np.zeros(15)
    got[at] = w
    np.testing.assert_allclose(got, [weight(i) for i in range(15)], atol=1e-6)
    assert bias == pytest.approx(weight(15)) and 0 < len(at) < 15 and got[3] == got.max()


def test_ordinal_step_by_plain_loops():
    """One row, one pass: the gradient of the grade's likelihood by differences, also where two of its features share a number."""
    at, v = np.array([2, 4, 4]), np.array([0.5, 0.25, 0.75], np.float32)
    for y in range(3):
        w, t = ordinal.fit_rows([(at, v)], np.array([y]), 6, 3, rate=0.5, l2=0.0, epochs=1)
        share = np.array([(np.array([y]) > j).mean() for j in range(2)]).clip(1e-3, 1 - 1e-3)
        t0 = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(2))
        t0 = t0[0] + np.array([0.0, max(t0[1] - t0[0], 1e-3)])
        cut = lambda s: [1.0, *(1 / (1 + np.exp(t0 - s))), 0.0]  # noqa: E731, B023
        loss = lambda s: -np.log(cut(s)[y] - cut(s)[y + 1])  # noqa: E731, B023
        slope = (loss(1e-6) - loss(-1e-6)) / 2e-6
        want = np.zeros(6)
        for i in (2, 4):
            g = slope * v[at == i]
            want[i] = -0.5 * (g / np.sqrt(1e-3 + (g * g).sum())).sum()
        np.testing.assert_allclose(w, want, rtol=1e-4, atol=1e-9)
        assert (np.diff(t) > 0).all()


def test_matroska_of_another_kind(spark):
    """A file put together by hand: unknown sizes, a block group, EBML and Xiph lacing, frames of a length of their own, two tracks."""
    el = lambda i, body, size=None: bytes.fromhex(i) + (bytes([0x40 | len(body) >> 8, len(body) & 255]) if size is None else size) + body
    track = lambda n, extra: el("ae", el("d7", bytes([n])) + el("86", b"A_PCM/INT/LIT") + extra)
    head = el("1a45dfa3", el("4282", b"matroska"))
    tracks = el("1654ae6b", track(1, el("23e383", (5_000_000).to_bytes(3, "big"))) + track(2, el("e1", el("b5", b"\x46\x1c\x40\x00") + el("9f", b"\x02") + el("6264", b"\x10"))))
    info = el("1549a966", el("2ad7b1", (100_000).to_bytes(3, "big")))
    frames = [b"p" * 260, b"q" * 3, b"r" * 40]
    xiph = el("a3", b"\x81\x00\x02\x02" + bytes([2, 255, 5, 3]) + b"".join(frames))
    ebml = el("a0", el("a1", b"\x82\x00\x05\x06" + bytes([2]) + (0x4000 | 260).to_bytes(2, "big") + (0x4000 | (-257 + 8191)).to_bytes(2, "big") + b"".join(frames)))
    group = el("a0", el("a1", b"\x81\x00\x07\x04" + bytes([1]) + b"s" * 8) + el("9b", b"\x64"))  # two equal frames, 100 ticks
    one = el("1f43b675", el("e7", b"\x0a") + xiph + ebml, b"\xff")
    two = el("1f43b675", el("e7", b"\x01\x2c") + group, b"\xff")
    cue = lambda t, at: el("bb", el("b3", t.to_bytes(2, "big")) + el("b7", el("f7", b"\x01") + el("f1", at.to_bytes(2, "big"))))
    at = len(info) + len(tracks)
    body = info + tracks + one + two + el("1c53bb6b", cue(10, at) + cue(300, at + len(one)))
    data = head + bytes.fromhex("18538067") + b"\x01\xff\xff\xff\xff\xff\xff\xff" + body
    got = matroska.packets(spark.createDataFrame([(7, data), (8, None), (9, b"")], "doc_id long, media binary")).orderBy("packet").collect()
    tick = 100_000
    want = [(1, (10 + 2) * tick, False), (1, 12 * tick + 5_000_000, False), (1, 12 * tick + 10_000_000, False)]
    of_byte = 1e9 / (10_000 * 2 * 2)  # 10 kHz, two channels of 16 bits
    want += [(2, int(15 * tick + n * of_byte), True) for n in (0, 260, 263)] + [(1, 307 * tick, True), (1, 357 * tick, True)]
    assert [(r.track, r.timestamp_ns, r.keyframe) for r in got] == want and {r.doc_id for r in got} == {7}
    assert [data[r.start : r.start + r["size"]] for r in got] == [*frames, *frames, b"ssss", b"ssss"]
    media = matroska.parse(data)
    assert matroska.seek(data, media, 9 * tick) is None and all(matroska.leads(data, c, media.scale) for c in media.cues)
    assert [data[matroska.seek(data, media, t * tick) :][:4].hex() for t in (10, 299, 300)] == ["1f43b675"] * 3
    assert matroska.seek(data, media, 299 * tick) < matroska.seek(data, media, 300 * tick)
    assert not matroska.leads(data, (0, 1, 3), media.scale)
    with pytest.raises(ValueError):
        matroska.parse(b"no such file")


def test_matroska(docs, none):
    got = {r.doc_id: r for r in matroska.op6(docs).collect()}
    for d, t in ROWS:
        data = (t or "").encode()
        full = data.ljust(max(1, -(-len(data) // 192)) * 192)
        r, media = got[d], matroska.mux(full)
        x = np.frombuffer(full, np.uint8).astype(float)
        n = len(full) // 192
        numbers = [n, -(-n // 512), -(-n // 512), n * 24, *(round(1000 * float(v)) for v in (x.mean(), x.std(), np.abs(np.diff(x)).mean()))]
        assert r.feature == ":".join(map(str, numbers))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert matroska.op6(none).count() == 0
    m = matroska.parse(matroska.mux(bytes(192 * 1000)))
    assert len(m.packets) == 1000 and m.clusters == len(m.cues) == 2 and m.packets[999][1] == 999 * 24_000_000
    frames = [b"a" * 300, b"b" * 5, b"c" * 7]
    head = bytes([0x81, 0, 0])
    laces = {0x82: bytes([2, 255, 45, 5]), 0x86: bytes([2]) + (0x4000 | 300).to_bytes(2, "big") + (0x4000 | (-295 + 8191)).to_bytes(2, "big")}
    for flags, sizes in laces.items():
        raw = head + bytes([flags]) + sizes + b"".join(frames)
        assert [raw[a : a + n] for a, n in matroska.block(raw, 0, len(raw))[3]] == frames


def test_packing(docs, none):
    path, ids = public_tokenizers.path("word_bpe_49k.json"), ids_of("word_bpe_49k.json")
    got = packing.op7(docs, path).collect()
    text = dict(ROWS)
    pieces, windows = {}, {}
    for r in got:
        own = ids[text[r.doc_id]]
        assert r.doc_tokens == len(own) and r.ids_crc32 == crc(own[r.start : r.start + r.length])
        pieces.setdefault(r.doc_id, Counter()).update(range(r.start, r.start + r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    times = Counter(i for i, _ in ROWS)
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    paid = sum(1 << (n - 1).bit_length() if n & (n - 1) == 0 else 4096 for n in used.values())
    assert sum(used.values()) > 0.9 * (paid - 4096 * docs.rdd.getNumPartitions())  # but for the last group of each task, which is small here
    assert all(c == Counter({k: times[d] for k in range(len(ids[text[d]]))}) for d, c in pieces.items()) and set(pieces) == set(times)
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.op7(none, path).count() == 0
    assert sorted(map(len, packing.karmarkar_karp([8, 7, 6, 5, 4], 2))) == [2, 3]
    assert len(packing.pack([3, 3, 3], 5)) == 3  # two windows of capacity 5 can't hold them


def test_kneser_ney(docs, none):
    token = lambda t: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "</s>"]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    train = [token(t) for d, t in ROWS if not held(d)]
    c, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["<s>", *t], t, strict=False))
    n, v = sum(c.values()), len(c)
    total, kinds, cont = Counter(), {}, Counter(w for _, w in pairs)
    for (a, _), k in pairs.items():
        total[a] += k
        kinds.setdefault(a, Counter())[min(k, 3)] += 1
    of = lambda counts: [sum(x == k for x in counts) for k in (1, 2, 3, 4)]
    d, e = kneser_ney.discounts(*of(pairs.values())), kneser_ney.discounts(*of(cont.values()))
    low = sum(e[min(k, 3) - 1] for k in cont.values()) / len(pairs) / (v + 1)

    def p(a, w):
        lower = (max(cont[w] - e[min(cont[w], 3) - 1], 0) / len(pairs) if cont[w] else 0) + low
        if not total[a]:
            return lower
        k = pairs[a, w]
        return (k - d[min(k, 3) - 1] if k else 0) / total[a] + sum(d[j - 1] * m for j, m in kinds[a].items()) / total[a] * lower

    first = lambda x: -1 if x[0] is None else x[0]
    got = sorted(kneser_ney.op9(docs).collect(), key=first)
    for r, (i, t) in zip(got, sorted(ROWS, key=first), strict=True):
        w = token(t)
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, held(i), len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(log10((c[x] + 1) / (n + v + 1)) for x in w), abs=1e-6)
        assert r.score == pytest.approx(sum(log10(p(a, x)) for a, x in zip(["<s>", *w], w, strict=False)), rel=1e-5)
    assert kneser_ney.op9(none).count() == 0
    words = [*c, "never"]
    assert sum(p("w1", w) for w in words) == pytest.approx(1.0)


def test_kneser_ney_store(spark, docs):
    """A store lies in Spark's file system by its full name, has a file for each bucket, and fails the job when one is gone."""
    model = kneser_ney.train(docs)
    assert model.path.startswith("file:/")
    with pytest.raises(ValueError):
        kneser_ney.mapped("/checkpoints/pairs-0")
    for kind in ("pairs", "words"):
        assert all(len(kneser_ney.mapped(f"{model.path}/{kind}-{k}")[0]) >= 16 for k in range(model.buckets))
    one = kneser_ney.scored(docs, model).select(F.avg(kneser_ney.perplexity(F.col("score"), F.col("n_tokens")))).first()[0]
    assert 1 < one < len(ROWS) * 1000
    os.remove(f"{kneser_ney._local(model.path)}/words-{model.buckets - 1}")
    with pytest.raises(FileNotFoundError):
        kneser_ney.mapped(f"{model.path}/words-{model.buckets - 1}")
    with pytest.raises(Exception, match="FileNotFoundError"):
        kneser_ney.scored(docs, kneser_ney.Model(f"{model.path}-none", *[getattr(model, f) for f in model.__dataclass_fields__][1:])).collect()


def test_kneser_ney_buckets_stay_small(docs, monkeypatch):
    want = {r.doc_id: r.score for r in kneser_ney.op9(docs).collect()}
    monkeypatch.setattr(kneser_ney, "BUCKET_TOKENS", 200)
    model = kneser_ney.train(docs)
    sizes = [int(kneser_ney.mapped(f"{model.path}/{kind}-{k}")[0][:8].view("<u8").sum()) for kind in ("pairs", "words") for k in range(model.buckets)]
    assert model.buckets >= model.tokens / 200 > 32
    assert 0 < max(sizes) < 2 * 200
    got = {r.doc_id: r.score for r in kneser_ney.op9(docs).collect()}
    assert got == {i: pytest.approx(s, rel=1e-9) for i, s in want.items()}
