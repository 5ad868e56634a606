"""Every registered query against its SQL, on the smallest test tables."""

import os

import duckdb
import pytest
from places import SF

import __spark_entry__ as registered

OWN_TESTS = registered.training_text_queries()
QUERIES = {name: q for name, q in registered.queries().items() if name not in OWN_TESTS}
SQL = {name: text for name, text in registered.oracle_sql().items() if name not in OWN_TESTS}
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{SF}/{file}'")
    return con


def key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def test_only_the_stream_over_changed_tables_has_no_sql():
    assert set(QUERIES) - set(SQL) == {"stream_incremental_sync"}
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    relation = duck.sql(SQL[name])
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema.fields} == {
        c: str(t) for c, t in zip(relation.columns, relation.types)
    }
    order = [list(relation.columns).index(c) for c in df.columns]
    expected = sorted((tuple(r[i] for i in order) for r in relation.fetchall()), key=key)
    assert sorted(map(tuple, df.collect()), key=key) == expected


def test_entry(spark):
    assert registered.entry(spark).count() > 0


def test_stream_is_drained(spark):
    rows = QUERIES["stream_incremental_sync"](spark, SF).collect()
    assert rows and all(r.sync for r in rows) and any(r.present for r in rows)
