"""Driver contract: entry() and every registered query run at sf0.001."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 3
    for r in rows:
        assert r.latex.count("&") == 8 and 0 < r.accuracy_before <= 1 and r.n_items > 0


def test_oracles_only_for_registered_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def compared(columns, rows):
    """Rows as sorted text, columns by name, doubles to nine places."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: repr(round(v, 9)) if isinstance(v, float) else str(v)
    return sorted("\x1f".join(show(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).split('.')[0]} as select * from read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_equals_its_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    assert len(df.columns) == len(set(df.columns))
    rows = df.collect()
    if name in E.oracle_sql():
        found = duck.execute(E.oracle_sql()[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert compared(df.columns, rows) == compared(columns, found.fetchall())
