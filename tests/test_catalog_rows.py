"""Registered queries against their SQL on rows that the given tables do not hold."""

from datetime import datetime

import duckdb
import pytest

from annolink.catalog import QUERIES, SQL


@pytest.fixture
def same_as_sql(spark, tmp_path):
    def check(name, **tables):
        con = duckdb.connect()
        for table, df in tables.items():
            df.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        got = QUERIES[name](spark, str(tmp_path))
        want = con.execute(SQL[name])
        names = [c[0] for c in want.description]
        assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))

    return check


def test_snap_points_in_single_precision(spark, same_as_sql):
    """(-0.2 + 1) * 500 is 400 as a float and just under it as a double."""
    e = spark.createDataFrame([(1, [-0.2, 0.0], 0), (2, [-0.19, 0.0], 1), (3, [0.3, None], 2), (4, [-0.2, 0.1], -1)], "vec_id long, embedding array<float>, label int")
    same_as_sql("jn_17_snap_points", embeddings=e)


LINES = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
         "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")


def test_a_part_numbered_like_a_shifted_supplier(spark, same_as_sql):
    day = datetime(2020, 1, 2)
    rows = [(i, part, 7, 1, 2.0, 3.0, 0.0, 0.0, flag, "O", day) for i, (part, flag) in enumerate([(1000007, "A"), (7, "A"), (1000007, "N"), (7, "R"), (1000007, "R")])]
    same_as_sql("prj_03_resolve_ids", lineitem=spark.createDataFrame(rows, LINES))
