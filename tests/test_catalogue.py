"""Every registered query of the engine against DuckDB on the same tables."""

from collections import Counter

import duckdb
import pytest

from tessera.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, medium, name):
    got = catalogue.QUERIES[name](spark, medium)
    if name not in catalogue.SQL:
        assert got.count() > 0
        return
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{medium}/{t}.parquet'")
    want = db.sql(catalogue.SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = Counter(map(tuple, want.select(*(f'"{c}"' for c in columns)).fetchall())), Counter(tuple(r) for r in got.select(*(f"`{c}`" for c in columns)).collect())
    assert a == b
    assert [str(t) for t in want.select(*(f'"{c}"' for c in columns)).types] == [SPARK.get(t, t.upper()) for _, t in got.select(*(f"`{c}`" for c in columns)).dtypes]


SPARK = {"int": "INTEGER", "string": "VARCHAR"}
