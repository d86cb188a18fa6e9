"""Every registered query against its SQL oracle on the smallest data, as the driver compares them."""

import os
from collections import Counter

import pytest

from annolink.catalog import QUERIES, SQL

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def values(rows, cols, at):
    return Counter(tuple(repr(at(r, c)) for c in cols) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    cols = sorted(df.columns)
    if name not in SQL:
        assert cols
        return
    cur = duck.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    index = {c: i for i, c in enumerate(names)}
    assert values(rows, cols, lambda r, c: r[c]) == values(cur.fetchall(), cols, lambda r, c: r[index[c]])
