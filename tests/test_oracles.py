"""Every registered query against its DuckDB oracle on the smallest test tables."""

from __future__ import annotations

import collections
import os

import pytest

import __spark_entry__ as entry
from tools.oracle_check import TABLES, norm

SF = os.environ.get("RAILYARD_TEST_SF", "/root/testdata/sf0.001")
QUERIES = entry.queries()
SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                 "date": "DATE", "timestamp_ntz": "TIMESTAMP"}
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    yield con
    con.close()


def test_every_query_has_an_oracle():
    """Those of the optional training-data subpackage have tests of their own."""
    from railyard.plans import registry

    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["feed_id", "table_name", "record_id", "violation_type", "detail"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    srows = df.collect()
    cur = duck.execute(ORACLES[name])
    drows = cur.fetchall()
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    order = sorted(dcols)
    s = collections.Counter(tuple(norm(r[c]) for c in order) for r in srows)
    idx = [dcols.index(c) for c in order]
    d = collections.Counter(tuple(norm(r[i]) for i in idx) for r in drows)
    assert len(srows) == len(drows)
    assert s == d
    # exact column types agree too (Spark name -> DuckDB name)
    duck_types = {r[0]: r[1] for r in duck.execute(f"DESCRIBE {ORACLES[name]}").fetchall()}
    for f in df.schema.fields:
        st = f.dataType.simpleString()
        assert SPARK_TO_DUCK.get(st, st) == duck_types[f.name], (f.name, st, duck_types[f.name])
