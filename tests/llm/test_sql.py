"""Queries of the operators against their SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from inkwell.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir).toArrow()
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "embeddings"):
        path = Path(sf_dir, f"{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    columns = sorted(got.column_names)
    rel = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})")
    assert sorted(rel.columns) == columns
    key = lambda row: tuple((x is None, str(x)) for x in row)
    assert sorted(zip(*[got[c].to_pylist() for c in columns]), key=key) == sorted(rel.fetchall(), key=key)
