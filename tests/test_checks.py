"""Registered queries against their SQL. All of them with ``HIREGRAIN_ALL=1``, otherwise a few."""

import importlib
import math
import os

import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FEW = [
    "search_hybrid", "search_bm25_top_k", "ingest_import_summary", "skill_normalization", "skill_merge_links", "cv_match", "metric_judged", "grounded_report",
    "conversation_folding", "quota_sliding", "index_update", "scope_relations",
]
ENTRY = importlib.import_module("__spark_entry__")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(ENTRY.queries()) if os.environ.get("HIREGRAIN_ALL") else FEW)
def test_query_equals_sql(spark, db, name):
    df = ENTRY.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    sql = ENTRY.oracle_sql().get(name)
    if sql is None:
        assert columns
        return
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = [tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    assert sorted(rows, key=str) == sorted(expected, key=str)
