"""Price files as a data source of Spark: ``spark.read.format("price_tables").option("paths", ...)``.

Planning reads the header of each source (a text file, or a sheet of a workbook) and decides which of its columns holds
what; the schema has the optional columns that some source names. A partition is a source, so tasks read files or sheets
in parallel, a line at a time. Values stay texts: the library's column functions parse them.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.parsing import normalize_label, normalize_ticker, parse_date, parse_number
from .files import BOOKS, DATED, HEADERS, OPTIONAL, TEXTS, find_column, keep_last, separator_of, valid
from .spreadsheets import read_book

NAME = "price_tables"


@dataclass
class Source(InputPartition):
    """A file or sheet, and which of its columns hold what. kind: long, wide, or "" if its header is not that of a price table."""

    path: str
    sheet: str | None
    separator: str | None
    kind: str
    columns: dict[str, int] = field(default_factory=dict)
    tickers: dict[int, str] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return self.path if self.sheet is None else f"{self.path}::{self.sheet}"


def _opened(path: str) -> io.BufferedIOBase:
    """A path as Spark lists it (not escaped), in any file system that pyarrow knows by its scheme."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_stream("/" + path[5:].lstrip("/"))
    system, at = fs.FileSystem.from_uri(quote(path, safe="/:@"))
    return system.open_input_stream(at)


def _lines(path: str, separator: str) -> Iterator[list[str]]:
    with io.TextIOWrapper(_opened(path), encoding="utf-8-sig", errors="replace", newline="") as f:
        yield from csv.reader(f, delimiter=separator)


def layout(header: list[str]) -> tuple[str, dict[str, int], dict[int, str]]:
    """(kind, columns, tickers) of a header: a date and a close in each row, or a date and a column for each ticker."""
    found = {k: find_column(header, HEADERS[k]) for k in ("date", "close")}
    if None not in found.values():
        volume = find_column(header, HEADERS["volume"])  # its name may contain one for tickers
        ticker = find_column([c for c in header if c not in (*found.values(), volume)], HEADERS["ticker"])
        taken = {*found.values(), ticker}
        found |= {"ticker": ticker} if ticker else {}
        found |= {k: c for k in OPTIONAL if (c := find_column(header, HEADERS[k])) and c not in taken}
        return "long", {k: header.index(c) for k, c in found.items()}, {}
    date = found["date"] or (header[0] if header else None)
    tickers = {i: normalize_label(c).upper() for i, c in enumerate(header) if c != date and c.strip()}
    return ("wide", {"date": header.index(date)}, tickers) if len(tickers) > 1 else ("", {}, {})


def planned(paths: list[str]) -> list[Source]:
    """All sources of some files, from their headers."""
    out = []
    for path in paths:
        kind = path.lower()
        if kind.endswith(TEXTS):
            with io.TextIOWrapper(_opened(path), encoding="utf-8-sig", errors="replace", newline="") as f:
                separator = separator_of(f.readline())
            header = next(_lines(path, separator), []) if separator else []
            out.append(Source(path, None, separator, *layout([c.strip() for c in header])))
        elif kind.endswith(BOOKS):
            with _opened(path) as f:
                out += [Source(path, name, None, *layout([c.strip() for c in rows[0]])) for name, rows in read_book(f.read())]
    return out


class PriceReader(DataSourceReader):
    def __init__(self, sources: list[Source], names: list[str]):
        self.sources, self.names = sources, names

    def partitions(self) -> list[Source]:
        return [s for s in self.sources if s.kind]

    def read(self, source: Source) -> Iterator[tuple]:
        """Rows of texts in the order of the schema: (_src, _kind, _row, date, ticker, close, ...)."""
        if source.sheet is None:
            rows = _lines(source.path, source.separator)
        else:
            with _opened(source.path) as f:
                rows = iter(next(rows for name, rows in read_book(f.read()) if name == source.sheet))
        next(rows, None)
        stem = source.path.rpartition("/")[2].rpartition(".")[0]
        for k, cells in enumerate(rows):
            of = lambda name: cells[i] if (i := source.columns.get(name)) is not None and i < len(cells) else None  # noqa: B023, E731
            if source.kind == "long":
                yield source.name, "long", k, of("date"), of("ticker") if "ticker" in source.columns else stem, of("close"), *map(of, self.names)
            else:
                for i, ticker in source.tickers.items():
                    yield source.name, "wide", k, of("date"), ticker, cells[i] if i < len(cells) else None, *[None] * len(self.names)


class PriceTables(DataSource):
    """option paths: a JSON list of the files' URIs."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _sources(self) -> list[Source]:
        return planned(json.loads(self.options["paths"]))

    def schema(self) -> str:
        named = {k for s in self._sources() for k in s.columns}
        return "_src string, _kind string, _row long, date string, ticker string, close string" + "".join(f", {k} string" for k in OPTIONAL if k in named)

    def reader(self, schema) -> PriceReader:
        return PriceReader(self._sources(), [n for n in schema.names if n in OPTIONAL])


def raw_tables(spark: SparkSession, raw_dir: str) -> DataFrame:
    """The texts of all price files below a folder. FileNotFoundError if there is none."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(raw_dir).select("path")
    paths = sorted(r.path for r in listed.where(F.lower("path").rlike(r"\.(csv|txt|xlsx|xlsm)$")).collect())  # a row for each file
    if not paths:
        raise FileNotFoundError(f"no price files in {raw_dir}")
    spark.dataSource.register(PriceTables)
    return spark.read.format(NAME).option("paths", json.dumps(paths)).load()


def read_prices(spark: SparkSession, raw_dir: str) -> DataFrame:
    """(date, ticker, open, high, low, close, volume) of all files below a folder; of equal (ticker, date) the last row of the last source counts. Wide sources of which too few rows have a date are left out."""
    raw = raw_tables(spark, raw_dir)
    values = [parse_number(F.col(c)).alias(c) if c in raw.columns else F.lit(None).cast("double").alias(c) for c in ("close", *OPTIONAL)]
    rows = raw.select("_src", "_row", "_kind", parse_date(F.col("date")).alias("date"), normalize_ticker(F.col("ticker")).alias("ticker"), *values)
    dated = rows.where("_kind = 'wide'").groupBy("_src").agg(F.avg(F.col("date").isNotNull().cast("double")).alias("share")).where(F.col("share") < DATED)
    good = rows.join(F.broadcast(dated.select("_src")), "_src", "left_anti")  # bounded: the sources
    return keep_last(valid(good)).select("date", "ticker", *OPTIONAL[:3], "close", "volume")
