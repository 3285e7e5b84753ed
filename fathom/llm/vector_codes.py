"""Product-quantisation codes of vectors, exact in integers, with nearest entries screened in float32.

Components become integers, floor(4096 x), and vectors are cut into equal parts, each with a codebook of its own.
A batch's distances to all entries of a codebook come from one float32 matrix product, each with an interval that
rigorously holds the true value: half units of rounding for the conversion of both factors, for each product and sum,
and what numbers too small for float32 may lose. Entries whose interval overlaps the best one's are evaluated again in
int64; of equal distances the lowest index wins. Numbers too large for int64 squares are evaluated in Python's integers.

A round is one pass over the table: tasks send a sum for each part, entry and place, which Spark adds up, and the
codebooks (parts x entries x places, whatever the number of rows) are renewed on the driver and sent to the next pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import let_go, written

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Half a unit in the last place of float32, and the least positive number that has all its digits.
_HALF, _TINY = 2.0**-24, 2.0**-126
#: Sums travel as numbers below this, so that Spark's long sums hold those of millions of tasks.
_LIMB = 1 << 40
#: Rows that are held as integers at once.
ROWS = 1 << 14


# ---------------------------------------------------------------- integers


def limit_of(width: int) -> int:
    """Components within this have squared distances over width places within a long."""
    return int((2.0**61 / max(width, 1)) ** 0.5 / 2)


def integers(values: np.ndarray, limit: int) -> np.ndarray:
    """floor(4096 x) of finite numbers: int64, or Python's integers if some are beyond limit."""
    wide = values.astype(np.float64)
    if not len(wide) or np.abs(wide).max() < limit / SCALE - 1:
        return np.floor(wide * SCALE).astype(np.int64)
    out = np.empty(len(wide), object)
    for i, x in enumerate(wide.tolist()):
        top, bottom = x.as_integer_ratio()
        out[i] = top * SCALE // bottom
    return out


def rows_of(batch: pa.RecordBatch, width: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(kept, rows) some rows at a time, none if none is kept: the numbers of the rows that are kept, and their integers, short vectors filled up with zeros."""
    column = batch.column("embedding")
    for at in range(0, len(column), ROWS):
        part = column.slice(at, ROWS)
        flat, sizes = part.flatten(), pc.fill_null(pc.list_value_length(part), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        values = flat.to_numpy(zero_copy_only=False)  # nulls are NaN
        if values.dtype.kind != "f":
            values = values.astype(np.float64)
        own = np.maximum(sizes, 0)
        row = np.repeat(np.arange(len(sizes)), own)
        good = sizes >= 0
        good[row[~np.isfinite(values)]] = False
        use = good[row]
        place = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own)
        whole = integers(values[use], limit)
        out = np.zeros((len(sizes), width), whole.dtype)
        out[row[use], place[use]] = whole
        if len(kept := np.flatnonzero(good)):
            yield at + kept, out[kept]


# ---------------------------------------------------------------- nearest entries


def intervals(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distance less the row's own square, (rows, entries), from a float32 product.

    For n places and u = 2**-24: both factors are off by a share u, each of n products and n - 1 sums by another, so the
    product is off by less than (n + 3) u |x|.|c| when (n + 3) u is far below 1; products below float32's normal range
    lose 2**-126 at most each. The squares of entries are exact integers, taken to float64.
    """
    n = x.shape[1]
    a, b = x.astype(np.float32), entries.astype(np.float32)
    product = (a @ b.T).astype(np.float64)
    reach = (np.abs(a) @ np.abs(b).T).astype(np.float64)
    off = 2 * (1.01 * (n + 3) * _HALF * reach * (1 + (n + 3) * _HALF) + 2 * n * _TINY)
    square = (entries * entries).sum(axis=1).astype(np.float64)
    middle = square - 2 * product
    off += (np.abs(middle) + square + off) * 2.0**-50  # of the float64 arithmetic here
    return middle - off, middle + off


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, the lowest of several, and the exact squared distance."""
    if x.dtype == object or entries.dtype == object:
        every = np.stack([((x.astype(object) - c) ** 2).sum(axis=1) if x.shape[1] else np.zeros(len(x), object) for c in entries], axis=1)
        best = np.array([min(range(len(r)), key=r.__getitem__) for r in every.tolist()], np.int64)
        return best, every[np.arange(len(x)), best] if len(x) else np.zeros(0, object)
    low, high = intervals(x, entries)
    row, entry = np.nonzero(low <= high.min(axis=1, keepdims=True))  # by row, then by index
    away = x[row] - entries[entry]
    exact = (away * away).sum(axis=1)
    order = np.lexsort((entry, exact, row))
    first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
    return entry[first], exact[first]


def assigned(rows: np.ndarray, books: list[np.ndarray], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each part: entries' indices and distances. Only rows beyond limit leave int64, and rows that meet an entry beyond it."""
    width = rows.shape[1] // PARTS
    for k, book in enumerate(books):
        x = rows[:, k * width : (k + 1) * width]
        if rows.dtype != object and book.dtype != object:
            yield nearest(x, book)
            continue
        wide = np.array([any(abs(v) > limit for v in r) for r in x.tolist()], bool)
        far = np.array([any(abs(v) > limit for v in c) for c in book.tolist()], bool)
        index, away = np.zeros(len(x), np.int64), np.zeros(len(x), object)
        near = np.flatnonzero(~far)
        small = np.flatnonzero(~wide)
        exact = np.flatnonzero(wide)
        if len(near) and len(small):
            own = x[small].astype(np.int64)
            at, d = nearest(own, book[near].astype(np.int64))
            index[small], away[small] = near[at], d.astype(object)
            # an entry beyond limit can only win if its farthest component is nearer than that
            reach = np.abs(own).max(axis=1) if width else np.zeros(len(own), np.int64)
            farthest = [max(abs(v) for v in c) for c in book[far].tolist()]
            if farthest:
                doubt = [(min(farthest) - r) ** 2 <= e for r, e in zip(reach.tolist(), d.tolist(), strict=True)]
                exact = np.union1d(exact, small[np.array(doubt, bool)])
        else:
            exact = np.arange(len(x))
        if len(exact):
            index[exact], away[exact] = nearest(x[exact].astype(object), book.astype(object))
        yield index, away


# ---------------------------------------------------------------- with Spark


def _sums(books: list[np.ndarray], width: int, limit: int):
    """(part, entry, place, limb, v) of a task: what its rows add to each entry, in numbers below _LIMB; place -1 has the counts."""
    step = width // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        sums = [np.zeros((len(b), step + 1), object) for b in books]
        for batch in batches:
            for _, rows in rows_of(batch, width, limit):
                for k, (index, _) in enumerate(assigned(rows, books, limit)):
                    x = rows[:, k * step : (k + 1) * step]
                    own = np.zeros((len(books[k]), step + 1), x.dtype)
                    np.add.at(own, index, np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1))
                    sums[k] += own.astype(object)
        out = []
        for k, own in enumerate(sums):
            for entry, place in zip(*np.nonzero(own), strict=True):
                v, limb = int(own[entry, place]), 0
                sign, v = (-1, -v) if v < 0 else (1, v)
                while v:
                    out.append((k, int(entry), int(place) if place < step else -1, limb, sign * (v % _LIMB)))
                    v, limb = v // _LIMB, limb + 1
        if out:
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["part", "entry", "place", "limb", "v"])

    return run


def _narrow(entries: list[list[int]], limit: int, step: int) -> np.ndarray:
    fits = all(abs(v) <= limit for e in entries for v in e)
    return np.array(entries, np.int64 if fits else object).reshape(len(entries), step)


def usable(vectors: DataFrame) -> DataFrame:
    """The rows whose vector isn't null and holds finite numbers only; passes over all rows leave the others out where they read them (rows_of)."""
    return vectors.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def width_of(vectors: DataFrame) -> int:
    """The longest usable vector's length, rounded up to a multiple of PARTS."""
    return -(-(usable(vectors).agg(F.max(F.size("embedding"))).first()[0] or 0) // PARTS) * PARTS


def fit(vectors: DataFrame, width: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks of the usable rows of (vec_id, embedding)."""
    limit, step = limit_of(width // PARTS), width // PARTS
    # rows that share an id: the least vector; ids that are null start nothing
    starts = usable(vectors).where("vec_id is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy("vec_id").limit(ENTRIES).select("embedding").collect()
    first = [integers(np.array(r.embedding, np.float64), limit).tolist() + [0] * (width - len(r.embedding)) for r in starts]
    if not first and usable(vectors).take(1):  # ids are all null
        first = [[0] * width]
    books = [_narrow([v[k * step : (k + 1) * step] for v in first], limit, step) for k in range(PARTS)]
    for _ in range(rounds if first else 0):
        # a row for each part, entry, place and limb: as many as the codebooks have numbers, about
        got = vectors.select("embedding").mapInArrow(_sums(books, width, limit), "part int, entry int, place int, limb int, v long").groupBy("part", "entry", "place", "limb").agg(F.sum("v").alias("v")).collect()
        totals: dict[tuple[int, int], dict[int, int]] = {}
        for r in got:
            own = totals.setdefault((r.part, r.entry), {})
            own[r.place] = own.get(r.place, 0) + r.v * _LIMB**r.limb
        books = [_narrow([[own.get(p, 0) // own[-1] for p in range(step)] if (own := totals.get((k, j))) else [int(v) for v in book[j]] for j in range(len(book))], limit, step) for k, book in enumerate(books)]
    return books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for book in books for entry in book for v in entry).encode()).hexdigest()


def _codes(books: list[np.ndarray], width: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for kept, rows in rows_of(batch, width, limit):
                parts = list(assigned(rows, books, limit))
                index = np.stack([i for i, _ in parts], axis=1).astype(np.uint8)
                codes = [row.tobytes().hex() for row in index]
                error = sum((e.astype(object) for _, e in parts), np.zeros(len(rows), object))
                error = [e if e < 1 << 63 else None for e in map(int, error)]
                at = pa.array(kept)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("label").take(at), pa.array(codes, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def coded(embeddings: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every usable row, written to the shared folder, and the codebooks.

    Rows whose vector is null or holds a null or non-finite component go; all others are coded, also those without a
    vec_id (which start no entry) or a label, and repeated rows each. Of rows that share a vec_id the least vector
    starts an entry. With fewer than 16 ids there are as many entries; if all ids are null there is one of zeros. Vectors
    whose length is no multiple of 8, or less than the longest one's, count as filled up with zeros. An error beyond a
    long is null. An empty table gives an empty result. Columns other than vec_id, embedding and label aren't read.
    """
    spark, vectors = embeddings.sparkSession, embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    width = width_of(vectors)
    books = fit(vectors, width, rounds)
    kind = dict(vectors.dtypes)["label"]
    codes = vectors.mapInArrow(_codes(books, width, limit_of(width // PARTS)), f"vec_id long, label {kind}, code string, error long")
    return written(spark, codes, "codes"), books


def op13(embeddings: DataFrame) -> DataFrame:
    """coded() with the sum of errors over each label (rows without a label are one group; a sum beyond a long is null) and the digest of all codebooks. A label's sum is made by partial sums, and meets its rows by a join that Spark may split."""
    codes, books = coded(embeddings)
    # labels by their hash and themselves: null is a label too
    of_label = codes.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    same = codes["label"].eqNullSafe(of_label["label"])
    return codes.join(of_label, same).select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The same for DuckDB: parts of all vectors as rows, a round of assignment and means at a time."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""n{r} as materialized (select vec_id, part, arg_min(entry, (d, entry)) entry, min(d) d from
 (select vec_id, x.part, entry, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint d from x join b{r} b using (part)) group by vec_id, part)""")
        if r < ROUNDS:
            steps.append(f"""s{r} as (select part, entry, place, sum(v)::hugeint s, count(*)::hugeint c from (select n.part, n.entry, unnest(x.v) v, unnest(range(len(x.v))) place from n{r} n join x using (vec_id, part)) group by all),
m{r} as (select part, entry, list(((s - ((s % c) + c) % c) // c)::bigint order by place) v from s{r} group by part, entry),
b{r + 1} as materialized (select part, entry, coalesce(m.v, b.v) v from b{r} b left join m{r} m using (part, entry))""")
    return f"""
with k as (select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
x as materialized (select vec_id, p part, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] v from (select *, unnest(range({PARTS})) p from k)),
b0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 entry, v from x where vec_id in (select vec_id from k order by vec_id limit {ENTRIES})),
{",\n".join(steps)},
e as (select vec_id, string_agg(printf('%02x', entry), '' order by part) code, sum(d)::bigint error from n{ROUNDS} group by vec_id),
h as (select sha256(string_agg(v::varchar, ',' order by part, entry, place)) codebooks_sha256 from (select part, entry, unnest(v) v, unnest(range(len(v))) place from b{ROUNDS}))
select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, codebooks_sha256 from e join k using (vec_id), h
"""


OP13_SQL = _sql()
