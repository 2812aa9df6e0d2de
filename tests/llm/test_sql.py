"""Each operator that SQL can express, against DuckDB on whole tables."""

from collections import Counter

import duckdb
import pytest
from tests.llm.conftest import SF

from tempora.llm import queries

TABLES = ("documents", "embeddings", "pages", "conversations")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    df, sql = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(sql.columns) == columns
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[sql.columns.index(c)] for c in columns) for r in sql.fetchall())
