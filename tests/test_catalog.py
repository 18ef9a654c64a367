"""Every registered query with SQL against DuckDB at the smallest size."""

import datetime
import decimal
import math

import duckdb
import pytest

from lodestone.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 5)
    return str(v)[:19] if isinstance(v, datetime.date) else v


def rows(values):
    return sorted((tuple(map(plain, r)) for r in values), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = catalog.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    cur = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = rows([tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()])
    assert rows([tuple(r[c] for c in cols) for r in df.collect()]) == want


def test_queries_without_sql_give_rows(spark):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, DIR).count() > 0, name


def test_index_finds_nine_of_ten_neighbours(spark):
    got = [r.recall for r in catalog.queries()["ivf_probe"](spark, "/root/testdata/sf0.01").collect()]
    assert len(got) == 5 and sum(got) / len(got) >= 0.9


def test_entry(spark):
    import __spark_entry__ as e

    assert [f.name for f in e.entry(spark).schema] == ["id", "score"]
    assert e.entry(spark).count() == 10
