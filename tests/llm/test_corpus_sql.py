"""The corpus queries that have SQL against it, on the smallest tables."""

import os

import duckdb
import pytest

from trackspark.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_corpus_query_gives_what_its_sql_gives(spark, name):
    duck = duckdb.connect()
    for file in os.listdir(DATA):
        duck.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = [dict(zip(columns, r)) for r in cursor.fetchall()]
    found = [r.asDict() for r in QUERIES[name](spark, DATA).collect()]
    assert sorted(map(repr, (sorted(r.items()) for r in found))) == sorted(map(repr, (sorted(r.items()) for r in want)))
