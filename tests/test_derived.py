"""Views of the stock tables on values that the smallest tables lack."""

import duckdb

from stranda.plans import catalogue
from stranda.plans.derived import COLUMNS, view

ROWS = [(i % 3, 7, 3, 1 + i % 2, q, p, 0.04, 0.02, "N", "O") for i, (q, p) in enumerate([(10.0, 100.4), (10.0, 100.6), (12.5, 100.5), (13.5, 101.5), (14.2, 99.99), (14.7, -0.5), (10.0, 100.5), (9.0, 100.9), (10.0, None), (13.0, 50.0)])]
SCHEMA = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"


def test_fractions_are_rounded_as_in_sql(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "lineitem.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in ("iv_a", "reads", "genotypes"):
        columns = COLUMNS[name][1]
        rows = duck.execute("SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in columns.items()) + " FROM lineitem").fetchall()
        df = view(spark, str(tmp_path), name)
        shown = df.selectExpr("site", "sample", "gt[0]", "gt[1]", "gq", "dp") if name == "genotypes" else df.select(*columns)
        assert sorted(map(tuple, shown.collect()), key=repr) == sorted(rows, key=repr), name
    got = catalogue.QUERIES["dup_representative"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(duck.execute(catalogue.SQL["dup_representative"]).fetchall(), key=repr)
