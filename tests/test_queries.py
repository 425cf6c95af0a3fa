"""Every registered query runs, and equals its SQL where it has one."""

import math
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [q for q in entry.queries() if not q.startswith("op") and q != "pipeline"]


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return f"{float(x):.6g}" if float(x) else "0"
    return str(x)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(row[i]) for i in order) for row in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


@pytest.mark.parametrize("name", OWN)
def test_query(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cur = duck.execute(sql)
    want = table([c[0] for c in cur.description], cur.fetchall())
    got = table(df.columns, rows)
    assert got[0] == want[0]
    assert got[1] == want[1]
