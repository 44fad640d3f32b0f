"""Every registered query of the engine against DuckDB on the same tables."""

import math

import duckdb
import pandas as pd
import pytest

from tessera.plans import queries
from tessera.plans.inventory import TABLES

SQL = queries.oracle_sql()
RUN = {k: f for k, f in queries.queries().items()}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def normal(frame: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "NULL"
        v = v.item() if hasattr(v, "item") else v
        return f"{v:.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(one(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", RUN)
def test_query(spark, data, duck, name):
    got = RUN[name](spark, data).toPandas()
    if name not in SQL:
        assert len(got) > 0
        return
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
