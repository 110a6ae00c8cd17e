"""Every registered catalog query against its SQL, on the smallest tables."""

import duckdb
import pytest

from cairn.plans import queries as catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return repr(round(v, 6))
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*sorted(df.columns)).collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = duck.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    want = sorted(tuple(plain(v) for v in r) for r in rel.select(*[f'"{c}"' for c in sorted(rel.columns)]).fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["full_path", "copies"]
    assert set(e.oracle_sql()) <= set(e.queries())
