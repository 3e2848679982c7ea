"""Queries that have a SQL twin against it, as multisets of rows."""

from collections import Counter

import duckdb
import pytest

from quillon.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_equals_its_twin(spark, name):
    run, sql = QUERIES[name]
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rows = run(spark, SF)
    result = duck.execute(sql)
    at = [[d[0] for d in result.description].index(c) for c in rows.columns]
    assert Counter(tuple(r) for r in rows.collect()) == Counter(tuple(r[i] for i in at) for r in result.fetchall())
