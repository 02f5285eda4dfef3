"""Every registered query against its SQL counterpart on the smallest tables."""

import decimal

import duckdb
import pytest

from duelwise.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else float(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got
    if name in ORACLES:
        r = duck.sql(ORACLES[name])
        names = r.columns
        assert sorted(names) == columns
        assert got == sorted((tuple(plain(x[names.index(c)]) for c in columns) for x in r.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_bootstrap_has_the_reference_rounds(spark):
    assert QUERIES["bootstrap_draw_counts"](spark, SF).select("round").distinct().count() == 100
