"""Cleaning of texts from price files."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands for a missing number, and number texts that are accepted.
MISSING = ["", "-", "--", "nd", "n/d", "na"]
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DATE_FORMATS = ["dd/MM/yyyy", "d/M/yyyy", "yyyy-MM-dd", "dd-MM-yyyy", "dd.MM.yyyy", "yyyy-MM-dd HH:mm:ss"]


def parse_number(text: Column) -> Column:
    """A double from text with a comma or point and spaces (also no-break) between thousands; null for marks of missing values and for all else, infinities included."""
    bare = F.replace(F.replace(F.replace(F.trim(text), F.lit(" "), F.lit("")), F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    return F.when(~bare.isin(MISSING) & bare.rlike(NUMBER), bare.try_cast("double"))


def parse_date(text: Column) -> Column:
    """A date, day first; each text may have a format of its own."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in DATE_FORMATS]).cast("date")


def normalize_ticker(text: Column) -> Column:
    return F.upper(F.trim(text))


_MARKS, _GAPS = re.compile("[\u0300-\u036f]+"), re.compile(r"[\s_]+")


def normalize_label(label: object) -> str:
    """A header in lower case without accents, with single spaces for underscores and white space."""
    letters = _MARKS.sub("", unicodedata.normalize("NFKD", f"{label}"))
    return _GAPS.sub(" ", letters).strip().lower()
