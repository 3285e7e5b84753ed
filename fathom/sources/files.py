"""Price files into one clean table: delimited texts and spreadsheets, long or wide, headers in French or English.

Files are grouped by their header, and each group is read by one scan, so the number of plans follows the number of
layouts and not of files. Only names of files and their headers reach the driver.
"""

from __future__ import annotations

import csv
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.parsing import normalize_label, normalize_ticker, parse_date, parse_number
from .spreadsheets import sheets

# Headers that name each column, in order of preference, and the separators that are tried.
HEADERS = {
    "date": ["date", "seance", "session", "jour", "date_seance", "trade_date", "date de cotation"],
    "ticker": ["ticker", "valeur", "instrument", "societe", "libelle", "stock", "code", "symbole", "symbol", "isin", "nom"],
    "close": ["cours ajuste", "adjusted", "cours de cloture", "cours_cloture", "cloture", "close", "dernier cours", "dernier", "cours", "prix", "px_last"],
    "open": ["open", "ouverture", "cours_ouverture", "premier"],
    "high": ["high", "plus_haut", "haut", "max"],
    "low": ["low", "plus_bas", "bas", "min"],
    "volume": ["nombre de titres", "titres echanges", "quantite", "volume_titres", "qte", "titres", "volume", "volume echange"],
}
SEPARATORS = [";", ",", "\t"]
TEXTS, BOOKS, OLD_BOOKS = (".csv", ".txt"), (".xlsx", ".xlsm"), (".xls",)
OPTIONAL = ["open", "high", "low", "volume"]
PRICES = "date date, ticker string, open double, high double, low double, close double, volume double"
#: A wide file must have this share of rows with a date.
DATED = 0.70


def find_column(columns: list[str], wanted: list[str]) -> str | None:
    """The column whose header is one of wanted, else one whose header contains one of them; wanted goes by preference."""
    plain = {normalize_label(c): c for c in columns}
    names = [normalize_label(w) for w in wanted]
    exact = (plain[n] for n in names if n in plain)
    inside = (c for n in names for p, c in plain.items() if n in p)
    return next(exact, next(inside, None))


# ---------------------------------------------------------------- cleaning


def valid(rows: DataFrame) -> DataFrame:
    return rows.where("date is not null and close > 0")


def keep_last(rows: DataFrame) -> DataFrame:
    """One row for each ticker and date: that of the last source (_src), and of its last row (_row)."""
    w = Window.partitionBy("ticker", "date").orderBy(F.desc("_src"), F.desc("_row"))
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_src", "_row")


def melt(wide: DataFrame, date: str, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each date and column: (date, *keep, ticker, close)."""
    return wide.unpivot([date, *keep], columns, "ticker", "close")


def metadata(prices: DataFrame) -> DataFrame:
    return prices.agg(F.countDistinct("ticker").alias("tickers"), F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


# ---------------------------------------------------------------- reading


@dataclass
class Block:
    """Rows of sources that share a header: _src, _row, _file, and texts c0, c1, ..."""

    header: list[str]
    rows: DataFrame

    def col(self, name: str) -> Column:
        return F.col(f"c{self.header.index(name)}")


def listed(spark: SparkSession, raw_dir: str) -> list[str]:
    """Paths of the files that may hold prices, sorted; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(raw_dir).select("path")
    return sorted(r.path for r in files.where(F.lower("path").rlike(r"\.(csv|txt|xlsx|xlsm|xls)$")).collect())  # a row for each file


def _cells(header: str, sep: str) -> list[str]:
    """The names in a header line; a separator inside quotes is part of a name."""
    return [c.strip().lstrip("\ufeff").strip() for c in next(csv.reader([header.lstrip("\ufeff")], delimiter=sep), [])]


def separator_of(header: str) -> str | None:
    """The first separator that gives a header two columns."""
    return next((s for s in SEPARATORS if len(_cells(header, s)) > 1), None)


def delimited(spark: SparkSession, paths: list[str]) -> list[Block]:
    """Blocks of text files with a header; the first separator that gives two columns counts."""
    if not paths:
        return []
    meta = lambda c: F.col(f"_metadata.{c}")
    lines = spark.read.text(paths).select("value", meta("file_path").alias("path"), meta("file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    first = lines.where("at = 0").groupBy("path").agg(F.min_by("value", "id").alias("header")).collect()  # a row for each file
    alike: dict[str, list[str]] = {}
    for r in first:
        alike.setdefault(r.header, []).append(unquote(r.path))
    out = []
    for header, group in sorted(alike.items()):
        if (sep := separator_of(header)) is None:
            continue
        names = _cells(header, sep)
        schema = ", ".join(f"c{i} string" for i in range(len(names)))
        read = spark.read.schema(schema).csv(sorted(group), sep=sep, header=True).dropna("all")
        rows = read.select(meta("file_path").alias("_src"), F.struct(meta("file_block_start").alias("at"), F.monotonically_increasing_id().alias("id")).alias("_row"), meta("file_path").alias("_file"), "*")
        out.append(Block(names, rows))
    return out


def spreadsheet_blocks(spark: SparkSession, paths: list[str]) -> list[Block]:
    """Blocks of the sheets of workbooks; the first row of a sheet is its header."""
    if not paths:
        return []
    cells = sheets(spark, paths)
    first = cells.groupBy("_src").agg(F.min_by("cells", "row").alias("header")).collect()  # a row for each sheet
    alike: dict[tuple, list[str]] = {}
    for r in first:
        alike.setdefault(tuple(x or "" for x in r.header), []).append(r._src)
    out = []
    for header, group in sorted(alike.items()):
        body = cells.where(F.col("_src").isin(group) & (F.col("row") > 0))
        texts = [F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(f"c{i}") for i in range(len(header))]
        rows = body.select("_src", F.struct(F.lit(0).cast("long").alias("at"), F.col("row").cast("long").alias("id")).alias("_row"), "_file", *texts)
        out.append(Block(list(header), rows.dropna("all", subset=[f"c{i}" for i in range(len(header))])))
    return out


def long_prices(block: Block) -> DataFrame | None:
    """Rows of a table with a date and a close in each row; None if the header names no such columns. Without a ticker column the file's name is the ticker."""
    found = {k: find_column(block.header, HEADERS[k]) for k in ("date", "close")}
    if None in found.values():
        return None
    # a header such as "nombre de titres" names the volume, though a name for tickers is part of it
    volume = find_column(block.header, HEADERS["volume"])
    ticker = find_column([c for c in block.header if c not in (*found.values(), volume)], HEADERS["ticker"])
    taken = {*found.values(), ticker}
    plain = F.coalesce(F.try_url_decode(F.replace(F.col("_file"), F.lit("+"), F.lit("%2B"))), F.col("_file"))  # Spark names texts by URI, workbooks by path
    stem = F.regexp_extract(plain, r"([^/]+)\.[^./]*$", 1)
    optional = {k: c for k in OPTIONAL if (c := find_column(block.header, HEADERS[k])) and c not in taken}
    return valid(
        block.rows.select(
            "_src", "_row", parse_date(block.col(found["date"])).alias("date"), normalize_ticker(block.col(ticker) if ticker else stem).alias("ticker"),
            parse_number(block.col(found["close"])).alias("close"), *[parse_number(block.col(c)).alias(k) for k, c in optional.items()],
        )
    )


def wide_prices(block: Block) -> DataFrame | None:
    """Rows of a table with a column for each ticker; of sources where most rows have a date. None if no source is such a table."""
    date = find_column(block.header, HEADERS["date"]) or block.header[0]
    names = {f"c{i}": normalize_label(c).upper() for i, c in enumerate(block.header) if c != date}
    if len(names) < 2:
        return None
    rows = block.rows.withColumn("date", parse_date(block.col(date)))
    shares = rows.groupBy("_src").agg(F.avg(F.col("date").isNotNull().cast("double")).alias("share")).where(F.col("share") >= DATED)
    good = [r._src for r in shares.collect()]  # a row for each source
    if not good:
        return None
    long = melt(rows.where(F.col("_src").isin(good)), "date", list(names), ("_src", "_row"))
    label = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return valid(long.select("_src", "_row", "date", label[F.col("ticker")].alias("ticker"), parse_number(F.col("close")).alias("close")))


def build_dataset(spark: SparkSession, raw_dir: str) -> tuple[DataFrame, list[dict]]:
    """(prices, sources): clean prices of all files of a folder, and what became of each source.

    FileNotFoundError if there is no file, RuntimeError if none is recognised. Of equal (ticker, date) the last row of
    the last file counts. Workbooks in the old binary format can't be read and are told of.
    """
    paths = listed(spark, raw_dir)
    if not paths:
        raise FileNotFoundError(f"no price files in {raw_dir}")
    of = lambda kinds: [p for p in paths if p.lower().endswith(kinds)]
    parts, told = [], [{"source": p, "status": "SKIPPED: old binary format"} for p in of(OLD_BOOKS)]
    for block in [*delimited(spark, of(TEXTS)), *spreadsheet_blocks(spark, of(BOOKS))]:
        readers: list[tuple[str, Callable]] = [("long", long_prices), ("wide", wide_prices)]
        mode, rows = next(((m, got) for m, read in readers if (got := read(block)) is not None), (None, None))
        if rows is not None:
            parts.append(rows.withColumn("_mode", F.lit(mode)))
        else:
            told += [{"source": r._src, "status": "SKIPPED: columns not recognised"} for r in block.rows.select("_src").distinct().collect()]
    if not parts:
        raise RuntimeError("no price table was recognised")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    for c in OPTIONAL:
        if c not in every.columns:
            every = every.withColumn(c, F.lit(None).cast("double"))
    told += [{"source": r._src, "status": f"OK ({r._mode})", "rows": r["count"]} for r in every.groupBy("_src", "_mode").count().collect()]  # a row for each source
    prices = keep_last(every.drop("_mode"))
    return prices.select("date", "ticker", *OPTIONAL[:3], "close", "volume"), sorted(told, key=lambda x: x["source"])


# ---------------------------------------------------------------- stored tables


def load_prices(spark: SparkSession, path: str) -> DataFrame:
    """A stored price table: Parquet, or CSV with a header of its columns (of which date, ticker and close must be there)."""
    if not path.rstrip("/").endswith(".csv"):
        return spark.read.parquet(path)
    kinds = dict(x.split() for x in PRICES.split(", "))
    raw = spark.read.csv(path, header=True)
    return raw.select(*[F.col(c).cast(kinds[c]).alias(c) for c in raw.columns if c in kinds])


def save_csv(df: DataFrame, path: str) -> None:
    """A report as CSV in one file; for tables of reports, not of prices at scale (those go to Parquet)."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)
