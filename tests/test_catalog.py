"""Every registered query against its check SQL in DuckDB, on the smallest given tables."""

from pathlib import Path

import pytest

import __spark_entry__

duckdb = pytest.importorskip("duckdb")
SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="test tables not present")
CHECKS = __spark_entry__.oracle_sql()
ROWS_ONLY = sorted(set(__spark_entry__.queries()) - set(CHECKS))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in SF_DIR.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def comparable(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", CHECKS)
def test_agrees_with_check(spark, db, name):
    df = __spark_entry__.queries()[name](spark, str(SF_DIR))
    cursor = db.execute(CHECKS[name])
    names = [c[0] for c in cursor.description]
    assert comparable(df.columns, [tuple(r) for r in df.collect()]) == \
        comparable(names, cursor.fetchall())


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, name):
    assert __spark_entry__.queries()[name](spark, str(SF_DIR)).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
