"""Queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from tessera.llm import queries


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    got = queries.queries()[name](spark, data).toPandas()
    want = con.execute(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = ["doc_id", *[c for c in columns if c != "doc_id"]]
    assert got.sort_values(key)[columns].values.tolist() == want.sort_values(key)[columns].values.tolist()


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
