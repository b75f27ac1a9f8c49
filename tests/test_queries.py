"""Every registered query with SQL against DuckDB over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the stock tables aren't here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def norm(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6) + 0.0
    if hasattr(value, "as_tuple"):
        return round(float(value), 6)
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_agrees_with_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    ran = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in ran.description]
    assert got == rows(names, ran.fetchall())


def test_entry_and_the_queries_without_sql(spark):
    assert __spark_entry__.entry(spark).count() > 0
    for name in set(__spark_entry__.queries()) - set(__spark_entry__.oracle_sql()):
        if not name.startswith(("op", "pipeline")):
            assert __spark_entry__.queries()[name](spark, DATA).count() > 0
