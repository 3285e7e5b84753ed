"""Benchmark decontamination with DataFrame functions only.

Every 13-word window of the benchmark is cut into blocks of 7 words at each offset; the set of their hashes is small
(its size is checked) and goes to all tasks. A document is read in blocks of 7 words that do not overlap: any window
of 13 words holds one of them whole, so only every seventh position is hashed and looked up. A hit carries the words
around it (25 at most) to the windows with that block, where the words themselves are compared.

If the benchmark is larger than ``max_grams`` the set is not sent: all blocks are joined by a shuffle instead, in which
Spark splits a block that many documents have (the join's left side may be cut, its right side is the benchmark).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import as_row, quoted

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
MAX_GRAMS = 50_000


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body).getItem(0)


def lowered(text: Column) -> Column:
    """A to Z in lower case, all else as it is; the fast lower() where no other letter has a case to lose."""
    return F.when(text.rlike(r"[[\p{javaUpperCase}\p{javaTitleCase}]&&[^\x00-\x7F]]"), F.translate(text, _UPPER, _UPPER.lower())).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text.cast("string"), F.lit(""))), _GAP), "")


def _windows(bench: DataFrame, window: int) -> DataFrame:
    """(b, h, o, win, items): a row for each distinct window and offset of a block in it; b is the block's length."""
    words = bench.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).where("size(w) > 0 and item_id is not null")
    each = words.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1))), lambda i: F.slice("w", i, window))).alias("win"))
    win = each.groupBy("win").agg(F.collect_set("item_id").alias("items")).withColumn("b", ((F.size("win") + 1) / 2).cast("int"))
    return win.select("win", "items", "b", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("o")).withColumn("h", F.xxhash64(F.slice("win", F.col("o") + 1, F.col("b"))))


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, max_grams: int = MAX_GRAMS) -> DataFrame:
    """(doc_id, n_words, spans, items): a row for each row of docs; spans are [start, end) word ranges of windows found, items the sorted item_ids they come from.

    Null and empty texts have no words and no spans; repeated rows give as many rows; benchmark rows without an
    item_id or without words are no items. An empty benchmark finds nothing. Columns other than these are not read.
    """
    rows = _windows(bench, window)
    sizes = [(r.b, r.n) for r in rows.groupBy("b").agg(F.countDistinct("h").alias("n")).collect()]  # at most one row for each length up to 7
    small = sum(n for _, n in sizes) <= max_grams
    hashes = {b: [r.h for r in rows.where(F.col("b") == b).select("h").distinct().collect()] if small else None for b, _ in sizes}

    def of(words: Column, b: int) -> Column:
        """(b, p, h, at, around) of the document's blocks of b words whose hash is in the set."""
        at = F.when(F.size(words) >= b, F.sequence(F.lit(0), F.size(words) - b, F.lit(b))).otherwise(F.array().cast("array<int>"))
        hits = F.transform(at, lambda p: F.struct(p.alias("p"), F.xxhash64(F.slice(words, p + 1, b)).alias("h")))
        if small:
            hits = F.filter(hits, lambda x: x.h.isin(hashes[b]))
        return F.transform(hits, lambda x: around(words, b, x.p, x.h))

    def around(words: Column, b: int, p: Column, h: Column) -> Column:
        at = F.greatest(p - (b - 1), F.lit(0))
        return F.struct(F.lit(b).alias("b"), p.alias("p"), h.alias("h"), at.alias("at"), F.slice(words, at + 1, 3 * b).alias("around"))

    plain = docs.select(F.col("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text"))
    if not sizes:
        none = F.array().cast("array<struct<start:int,end:int>>")
        return plain.select("doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words"), none.alias("spans"), F.array().cast("array<string>").alias("items"))
    read = plain.select("doc_id", "row", let(words_of(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), F.concat(*[of(w, b) for b, _ in sizes]).alias("hits"))).alias("d"))
    hits = read.select("doc_id", "row", F.col("d.n").alias("n_words"), F.explode_outer("d.hits").alias("x")).select("doc_id", "row", "n_words", "x.*")
    start = F.col("p") - F.col("o")
    same = (start >= 0) & (F.slice("around", start - F.col("at") + 1, F.size("win")) == F.col("win"))
    met = hits.join(F.broadcast(rows) if small else rows, ["b", "h"], "left")
    span = F.when(same, F.struct(start.alias("start"), (start + F.size("win")).alias("end")))
    each = met.select("doc_id", "row", "n_words", F.struct(span.alias("span"), F.when(same, F.col("items")).alias("items")).alias("m"))
    per = each.groupBy("row", "doc_id", "n_words").agg(F.collect_set("m.span").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("m.items")))).alias("items"))
    return per.select("doc_id", F.col("n_words").cast("long"), F.array_sort("spans").alias("spans"), "items")


def n_hit(spans: Column) -> Column:
    """Words in the union of sorted ranges."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("e"))
    step = lambda a, x: F.struct((a.n + F.greatest(F.lit(0), x.end - F.greatest(x.start, a.e))).cast("long").alias("n"), F.greatest(x.end, a.e).cast("long").alias("e"))
    return F.aggregate(spans, zero, step, lambda a: a.n)


def judged(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """contamination() with n_hit, and contaminated: at least a twentieth of the words is hit, and one at least."""
    out = contamination(docs, bench).withColumn("n_hit", n_hit(F.col("spans")))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminated(docs: DataFrame, bench: DataFrame, what: str = "documents") -> DataFrame:
    """docs without contaminated documents, or (what="spans") with the words that are hit cut from their texts.

    Each row is judged by its own text, also where rows share a doc_id or have none. Null and empty texts stay. Other
    columns are carried along, whatever their names.
    """
    if what not in ("documents", "spans"):
        raise ValueError("what must be documents or spans")
    text_key = lambda c: F.xxhash64(F.coalesce(c.cast("string"), F.lit("")))
    named = docs.select(F.struct("doc_id", text_key(F.col("text")).alias("t")).alias("doc_id"), "text")
    bad = judged(named, bench).where("contaminated").groupBy("doc_id").agg(F.first("spans").alias("spans"))  # equal rows have equal spans
    whole = as_row(docs)
    bad = bad.select(F.struct("doc_id", "spans").alias("bad"))
    same = F.col("row.doc_id").eqNullSafe(F.col("bad.doc_id.doc_id")) & (text_key(F.col("row.text")) == F.col("bad.doc_id.t"))
    if what == "documents":
        return whole.join(bad, same, "left_anti").select("row.*")
    # pieces: each word with what stands before it; the last may have no word
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    pieces = F.split("row.text", f"(?<={word})(?!{word})")
    rest = F.filter(pieces, lambda p, i: ~F.exists("bad.spans", lambda s: (i >= s.start) & (i < s.end)))
    text = F.when(F.col("bad").isNull(), F.col("row.text")).otherwise(F.array_join(rest, ""))
    return whole.join(bad, same, "left").select(*[text.alias(c) if c == "text" else F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns])


def op2(docs: DataFrame, bench: DataFrame) -> DataFrame:
    return judged(docs, bench).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


OP2_SQL = r"""
with b as (select item_id::varchar item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select distinct item_id, w[i : i + 12] win from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) i from b where len(w) > 0)),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
sizes as (select distinct len(win) k from bw),
dw as (select doc_id, k, i, w[i : i + k - 1] win from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from d, sizes where len(w) >= k)),
hit as (select doc_id, i, k, item_id from dw join bw using (win)),
n as (select doc_id, count(distinct j) n_hit from (select doc_id, unnest(range(i, i + k)) j from hit) group by doc_id),
it as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id, ',' order by item_id) ids from hit group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join n using (doc_id) left join it using (doc_id)
"""
