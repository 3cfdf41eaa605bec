"""Every registered query against its SQL in DuckDB, on the same Parquet files."""

import datetime
import math
import os
from collections import Counter

import duckdb
import pytest

from hearthlens.plans.catalogue import QUERIES
from hearthlens.plans.oracle import ORACLE

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.date()
    return value


def _bag(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def _kind(type_name):
    name = type_name.lower()
    if name in ("bigint", "hugeint"):
        return "bigint"
    return {"integer": "int", "varchar": "string"}.get(name, name)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def assert_equal(df, con, sql):
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    assert sorted(df.columns) == sorted(names)
    assert dict(df.dtypes) == {d[0]: _kind(str(d[1])) for d in expected.description}
    got, want = _bag(df.collect(), df.columns), _bag(expected.fetchall(), names)
    assert sum(got.values()) > 0
    missing, extra = want - got, got - want
    assert not missing and not extra, (list(missing.items())[:3], list(extra.items())[:3])


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_equals_sql(spark, duck, key):
    assert_equal(QUERIES[key](spark, SF_DIR), duck, ORACLE[key])
