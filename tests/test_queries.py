"""Every registered query with SQL equals DuckDB's answer at sf0.001."""

from __future__ import annotations

import numbers
import os

import duckdb
import pandas as pd
import pytest

from plumbline.plans import registry

SF = "/root/testdata/sf0.001"


def canon(frame):
    rows = []
    for row in frame[sorted(frame.columns)].itertuples(index=False):
        rows.append(tuple("" if pd.isna(v) else f"{float(v):.5f}" if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v) for v in row))
    return sorted(rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    ours = registry.queries()[name](spark, SF).toPandas()
    theirs = con.sql(registry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canon(ours) == canon(theirs)
