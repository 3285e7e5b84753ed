"""Each registered query against its SQL, value by value."""

from __future__ import annotations

import pandas as pd
import pytest

import __spark_entry__ as entry
from fathom.plans import queries as plans

from .conftest import SF


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or x != x:
            return ""
        return f"{x:.6g}" if isinstance(x, float) else str(x)[:10] if hasattr(x, "year") else str(x)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), duck.execute(plans.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
