"""Every query with SQL against DuckDB on the smallest tables; the others must give rows."""

import duckdb
import pytest

from lustrate.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    rows = sorted(repr([r[c] for c in names]) for r in df.collect())
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    rel = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(rel.columns) == names
    assert rows == sorted(repr([dict(zip(rel.columns, r))[c] for c in names]) for r in rel.fetchall())
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    assert {c: TYPES.get(t, kinds[c]) for c, t in df.dtypes} == {c: kinds[c] for c in names}
