"""Every query of the catalogue against its SQL."""

import duckdb
import pytest

from larkspur.plans import catalogue, oracle

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float)):
        return None if x != x else round(float(x), 6)
    return x


def same(spark, sf, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = query(spark, sf)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted(names) == columns
    assert ours == theirs


@pytest.mark.parametrize("name", catalogue.NAMES.split())
def test_query(spark, sf, name):
    same(spark, sf, catalogue.queries()[name], oracle.oracle_sql()[name])


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(catalogue.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
