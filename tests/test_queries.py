"""Every query with SQL against that SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()
OWN = [n for n in SQL if not (n[:2] == "op" and n[2].isdigit()) and n != "pipeline"]


@pytest.fixture(scope="module")
def oracle(sf):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{sf}/{t}'")
    return c


@pytest.mark.parametrize("name", OWN)
def test_query_matches_sql(spark, sf, oracle, tmp_path, name):
    entry.queries()[name](spark, sf).write.parquet(str(tmp_path / "a"))
    got = spark.read.parquet(str(tmp_path / "a"))
    cols = ",".join(f'"{c}"' for c in sorted(got.columns))
    files = tmp_path / "a" / "*.parquet"
    oracle.execute(f"create or replace table a as select {cols} from '{files}'")
    oracle.execute(f"create or replace table b as select {cols} from ({SQL[name]})")
    assert oracle.sql("select * from a except all select * from b").fetchall() == []
    assert oracle.sql("select * from b except all select * from a").fetchall() == []


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
