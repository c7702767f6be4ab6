import glob
import os

import duckdb
import pytest

import __spark_entry__
from inkstrata.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, tables, name):
    got = registry.QUERIES[name](spark, SF)
    rows = got.collect()
    assert rows
    if name in registry.ORACLES:
        want = tables.execute(registry.ORACLES[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert plain(rows, got.columns) == plain(want.fetchall(), columns)


def test_entry(spark):
    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(registry.ORACLES) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).columns == ["doc_id", "segments", "target_chars", "context_chars", "all_chars"]
