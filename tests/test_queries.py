"""Every registered query against its SQL in DuckDB, over whole tables."""

import importlib
from pathlib import Path

import duckdb
import pytest

from inkwell import catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).iterdir():
        con.sql(f"CREATE VIEW {path.name.split('.')[0]} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, sf_dir, con, name):
    got = catalogue.QUERIES[name](spark, sf_dir).toArrow()
    columns = sorted(got.column_names)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.SQL[name]})").fetchall()
    assert sorted(zip(*[got[c].to_pylist() for c in columns]), key=key) == sorted(want, key=key)
    assert want or name in ("quotes_mixed", "acronyms_first_use")


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_rows(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).columns and set(entry.oracle_sql()) <= set(entry.queries())
