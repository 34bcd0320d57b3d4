import glob
from pathlib import Path

import duckdb
import pytest

from tessella import catalog

NAMES = sorted(catalog.queries())


def canon(rows):
    plain = lambda x: None if isinstance(x, float) and x != x else x
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for path in glob.glob(f"{tables}/*.parquet"):
        con.sql(f"create view {Path(path).stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, duck, tables, name):
    got = catalog.queries()[name](spark, tables)
    cols = sorted(got.columns)
    want = duck.sql(f"select {', '.join(cols)} from ({catalog.oracle_sql()[name]}) q").fetchall()
    assert canon(tuple(r) for r in got.select(*cols).collect()) == canon(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(NAMES) <= set(__spark_entry__.queries())
