"""Alignment, rank-queue BPE and vector codes against brute force: other libraries' encoders, plain loops and SQL."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fathom.llm import alignment, bpe, vector_codes

KINDS = "doc_id long, text string, pairs string, n long, `a.b` string, ids string"
ODD = ["", " ", "a ", "  a", "a  b \n\n c\t", "<|endoftext|> <s></s><unk>", "a▁b", "　漢字 \U0001f642‍", "a\x00b", "é é", "it's WE'LL they're 12345 !!??", "x" * 3000, " " * 700]


def texts() -> list[tuple]:
    rng = random.Random(3)
    words = ["the", "Straße", "naïve", "x1", "12,5", "don't", "漢字", "🙂", "ooo", "\n", ""]
    rows = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)] + ODD
    rows += ["".join(rng.choice("ab'sé\n\t 漢1.") for _ in range(rng.randint(1, 40))) for _ in range(60)]
    return [*[(i, t) for i, t in enumerate(rows)], (3, rows[3]), (3, "another text of that doc_id"), (None, rows[0]), (900, None), (901, rows[5] + " " + " ".join(rows[:40]) * 40)]


ROWS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "p", 1, "q", "r") for i, t in ROWS], KINDS).repartition(3).persist()


# ---------------------------------------------------------------- alignment


def by_hand(rows: list[tuple], first: str, second: str) -> list[tuple]:
    a_model, b_model = Tokenizer.from_file(first), sentencepiece.SentencePieceProcessor(model_file=second)
    a_model.encode_special_tokens = True
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spelt = {chr(x): x for x in shown} | {chr(0x100 + i): x for i, x in enumerate(sorted({*range(256)} - {*shown}))}
    docs = []
    for doc_id, text in rows:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        pieces = [b_model.id_to_piece(i) for i in b]
        a_bytes = [bytes(spelt[c] for c in a_model.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]
        if text and (b"".join(a_bytes) != b" " + text.encode() or b"".join(b_bytes) != b" " + text.encode()):
            a, b, a_bytes, b_bytes = [], [], [], []
        spans = [[(e - len(x), e) for x, e in zip(own, np.cumsum([0, *map(len, own)])[1:].tolist(), strict=True)] for own in (a_bytes, b_bytes)]
        links, j = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while j and spans[1][j - 1][1] > s:
                j -= 1
            while j < len(b) and spans[1][j][0] < e:
                if spans[1][j][1] > s:
                    links.append((a[i], b[j]))
                j += 1
        cuts = [0, *sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})]
        of = lambda ids, own, x, y: ",".join(str(i) for i, (s, e) in zip(ids, own, strict=True) if x <= s and e <= y)
        groups = [f"{of(a, spans[0], x, y)}|{of(b, spans[1], x, y)}" for x, y in zip(cuts, cuts[1:], strict=False)] if len(a) < 2000 else None
        docs.append((doc_id, len(a), len(b), len(cuts) - 1, links, groups))
    count = Counter(p for d in docs for p in set(d[4]))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    return [(*d[:4], len(d[4]), sum(count[p] == best[p[0]] for p in d[4]), sum(count[p] for p in d[4]), d[5]) for d in docs]


def test_alignment(docs):
    files = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    got = sorted((tuple(r) for r in alignment.op11(docs, *files).collect()), key=repr)
    want = []
    for r in by_hand(ROWS, *files):
        sha = "" if not r[1] else hashlib.sha256(";".join(r[7]).encode()).hexdigest() if r[7] is not None else None
        want.append((*r[:7], sha))
    want.sort(key=repr)
    assert len(got) == len(want) == len(ROWS)
    for g, w in zip(got, want, strict=True):
        assert g[:7] == w[:7] and w[7] in (None, g[7])


def test_alignment_of_nothing(docs):
    files = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    assert alignment.op11(docs.limit(0), *files).collect() == []
    only = alignment.op11(docs.where("text is null or text = ''"), *files).collect()
    assert len(only) == 2 and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in only)


@given(st.lists(st.integers(1, 9), min_size=1, max_size=60), st.randoms(use_true_random=False))
@settings(max_examples=60, deadline=None)
def test_bitsets(sizes, rng):
    a = np.cumsum(sizes)
    n = int(a[-1])
    b = np.array(sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n}))
    bits = alignment.Bits.of(a - 1, n)
    assert bits.members().tolist() == bits.select(np.arange(len(a))).tolist() == (a - 1).tolist()
    assert bits.rank(np.arange(n)).tolist() == [int((a - 1 < i).sum()) for i in range(n)]
    a_upto, b_upto, a_at, b_at = alignment.align(a - 1, b - 1, n)
    cuts = sorted({*a.tolist()} & {*b.tolist()})
    assert a_upto.tolist() == [int((a <= c).sum()) for c in cuts] and b_upto.tolist() == [int((b <= c).sum()) for c in cuts]
    start = lambda ends, k: int(ends[k - 1]) if k else 0
    pairs = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(start(a, i), start(b, j)) < min(a[i], b[j])]
    assert list(zip(a_at.tolist(), b_at.tolist(), strict=True)) == pairs
    k = np.arange(len(cuts))
    assert [x.tolist() for x in alignment.groups_of(a - 1, b - 1, n, k)] == [[0, *cuts[:-1]], cuts]


# ---------------------------------------------------------------- byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, library):
    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = [(i, len(ids := library.encode_ordinary(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in ROWS]
    assert sorted((tuple(r) for r in bpe.op12(docs, *args).collect()), key=repr) == sorted(want, key=repr)
    ids = bpe.encoded(docs, *args)
    assert sorted((r.doc_id, r.ids) for r in ids.collect() if r.doc_id is not None) == sorted((i, library.encode_ordinary(t or "")) for i, t in ROWS if i is not None)
    assert sorted(map(repr, bpe.decoded(ids, *args).collect())) == sorted(map(repr, docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()))
    assert bpe.op12(docs.limit(0), *args).collect() == []


@pytest.mark.parametrize("letters", ["ab", "aab", "thesincgr", "é漢a"])
def test_very_long_pre_tokens(ranks, library, letters):
    rng = random.Random(7)
    word = "".join(rng.choice(letters) for _ in range(50_000))
    merge = bpe.Bpe(ranks).merge
    assert merge(word.encode()) == library.encode_ordinary(word)
    assert merge(b"a" * 40_001) == library.encode_ordinary("a" * 40_001)


@given(st.lists(st.sampled_from("abc"), min_size=0, max_size=14).map("".join))
@settings(max_examples=200, deadline=None)
def test_ranks_in_any_order(word):
    """Also where a longer token has a smaller rank than the tokens that it is made of."""
    ranks = {bytes([b]): 1000 + b for b in range(256)} | {b"abc": 2, b"ab": 5, b"bc": 3, b"cab": 1, b"aa": 4, b"aaa": 0, b"abab": 6}
    own, word = bpe.Bpe(ranks), word.encode()
    parts = [bytes([b]) for b in word]
    if word in ranks:
        parts = [word]
    while len(parts) > 1:
        rank, k = min((ranks.get(parts[k] + parts[k + 1], 1 << 30), k) for k in range(len(parts) - 1))
        if rank == 1 << 30:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    assert own.merge(word) == [ranks[p] for p in parts] or not word
    assert not any(own.words)


def test_memory_of_pre_tokens(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_BYTES", 4000)
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 100)
    monkeypatch.setattr(bpe, "HELD", 7)
    own = bpe.Coder(ranks, public_tokenizers.PATTERN)
    for _, t in ROWS:
        assert [int(x) for part in own.encode(t or "") for x in part] == library.encode_ordinary(t or "")
    assert len(own.young) + len(own.old) < 60


# ---------------------------------------------------------------- vector codes


def codes_by_hand(rows: list[tuple]) -> list[tuple]:
    kept = [(i, [int(x.as_integer_ratio()[0] * 4096 // x.as_integer_ratio()[1]) for x in map(float, v)], n) for i, v, n in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 8) * 8
    kept = [(i, v + [0] * (width - len(v)), n) for i, v, n in kept]
    starts = {}
    for i, v, _ in kept:
        if i is not None:
            starts[i] = min(starts.get(i, v), v)
    first, w = [starts[i] for i in sorted(starts)[:16]], width // 8
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for v in first] for p in range(8)]
    away = lambda x, c: sum((s - t) ** 2 for s, t in zip(x, c, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda j: (away(x, book[j]), j))
    for _ in range(6):
        for p in range(8):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(cut(v, p), books[p]), []).append(cut(v, p))
            books[p] = [[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if j in groups else e for j, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, n in kept:
        at = [near(cut(v, p), books[p]) for p in range(8)]
        out.append((i, "".join(f"{j:02x}" for j in at), sum(away(cut(v, p), books[p][j]) for p, j in enumerate(at)), n))
    sums = Counter()
    for *_, e, n in out:
        sums[n] += e
    fits = lambda e: e if e < 1 << 63 else None
    whole = [r[2] for r in out if r[2] < 1 << 63]
    return [(i, c, fits(e), sums[n] if len(whole) == len(out) else None, sha) for i, c, e, n in out]


VECTORS = "vec_id long, embedding array<float>, label int, error string, `a.b` string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, n, "x", "y") for i, v, n in rows], VECTORS).repartition(3)


def some(n: int, width: int, seed: int = 1) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width)) * 0.3
    return [(i * 2, [float(np.float32(x)) for x in centres[i % 5] + rng.normal(size=width) * 0.05], None if i % 11 == 0 else i % 4) for i in range(n)]


def test_vector_codes(spark):
    rows = some(300, 24)
    rows += [(5000 + i, rows[i % 3][1], 9) for i in range(150)]  # copies, and a hot label
    rows += [(1, None, 1), (3, [None] + [0.5] * 23, 1), (5, [float("nan")] * 24, 1), (7, [float("inf")] + [0.0] * 23, None), (None, rows[4][1], 2), rows[6], (rows[6][0], rows[8][1], 2)]
    got = sorted((tuple(r) for r in vector_codes.op13(vectors(spark, rows)).collect()), key=repr)
    assert got == sorted(codes_by_hand(rows), key=repr)


@pytest.mark.parametrize("rows", [some(9, 8), some(40, 13), [(1, [], 1), (2, [], None)], [(1, [1.0], 1), (2, [1.0, 2.0, -3.0], None), (3, [], 1)]])
def test_vector_codes_of_odd_shapes(spark, rows):
    assert sorted(map(tuple, vector_codes.op13(vectors(spark, rows)).collect()), key=repr) == sorted(codes_by_hand(rows), key=repr)


def test_vector_codes_beyond_long(spark):
    big = float(np.float32(3e38))
    rows = some(60, 16) + [(200, [big] + [0.0] * 15, 1), (201, [-big] * 16, 2), (202, [0.0] * 15 + [70000.0], 2)]
    got = [tuple(r) for r in vector_codes.op13(vectors(spark, rows)).collect()]
    want = codes_by_hand(rows)
    key = lambda r: r[0]
    assert [r[:3] + r[4:] for r in sorted(got, key=key)] == [r[:3] + r[4:] for r in sorted(want, key=key)]


def test_vector_codes_of_nothing(spark):
    assert vector_codes.op13(vectors(spark, [])).collect() == []
    assert vector_codes.op13(vectors(spark, [(1, None, 1)])).collect() == []
    assert [r.code for r in vector_codes.op13(vectors(spark, [(None, [0.0] * 8, 1)])).collect()] == ["00" * 8]


def test_screening_holds():
    """Ties and near ties, far from the origin, where float32 can't tell entries apart."""
    rng = np.random.default_rng(5)
    for scale in (3, 1000, 1 << 22, 1 << 27):
        entries = rng.integers(-scale, scale + 1, (16, 8)) + (scale << 1 if scale < 1 << 26 else 0)
        entries[7], entries[9] = entries[2], entries[3] + np.eye(8, dtype=np.int64)[0]
        x = np.concatenate([entries[rng.integers(0, 16, 400)] + rng.integers(-1, 2, (400, 8)), rng.integers(-scale, scale + 1, (400, 8))])
        exact = np.array([[sum((int(s) - int(t)) ** 2 for s, t in zip(r, c, strict=True)) for c in entries] for r in x], object)
        low, high = vector_codes.intervals(x, entries)
        own = np.array([[int(e) - sum(int(s) ** 2 for s in r) for e in row] for r, row in zip(x, exact, strict=True)], object)
        assert all(a <= v <= b for a, v, b in zip(low.ravel().tolist(), own.ravel().tolist(), high.ravel().tolist(), strict=True))
        index, away = vector_codes.nearest(x, entries)
        assert index.tolist() == [min(range(16), key=lambda j: (r[j], j)) for r in exact.tolist()]
        assert away.tolist() == [min(r) for r in exact.tolist()]


def test_vector_codes_sql(spark, duck):
    got = vector_codes.op13(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")).toPandas()
    want = duck.execute(vector_codes.OP13_SQL).df()
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want[list(got.columns)].itertuples(index=False, name=None))
    assert isinstance(duck, duckdb.DuckDBPyConnection)
