"""Queries that SQL can express, against DuckDB on the same table."""

import duckdb
import pytest

from hearthlens.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_equals_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    found = con.execute(ORACLE[key])
    names = [d[0] for d in found.description]
    df = QUERIES[key](spark, SF_DIR)
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(found.fetchall())
