"""Every query with oracle SQL equals DuckDB on the smallest tables; schemas match by name."""

import os
from collections import Counter

import duckdb
import pytest

from gridlark.plans import registry

SF = "/root/testdata/sf0.001"
registry.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(raw):
    return Counter(tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in raw)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    assert rows(df.select(*cols).collect()) == rows(rel.select(*(f'"{c}"' for c in cols)).fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
