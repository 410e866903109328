"""Every registered query against its SQL oracle in DuckDB (sf0.01)."""

import os

import duckdb
import pytest

import __spark_entry__ as se
from labelwise.plans import registry
from tools.check_oracle import TABLES, rows_of, type_diffs

from conftest import SF001, SF0001

ORACLE = se.oracle_sql()
QUERIES = se.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF001}/{t}.parquet"
        if os.path.exists(p):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    res = con.sql(ORACLE[name])
    assert type_diffs(df, res) == {}
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(res.columns)
    assert len(rows) == len(orows)
    assert rows_of(df.columns, rows, True) == rows_of(res.columns, orows, True)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert df.count() == 2
    assert df.columns == ["task", "n", "TP", "TN", "FP", "FN", "F1", "BA", "AUC"]


def test_every_query_of_the_library_has_an_oracle():
    # mini-batches with a gradient that is never reset have no SQL form; tests/test_meta.py checks them by hand
    assert set(registry.QUERIES) - set(registry.ORACLE) == {"fit_meta_batches"}
