"""Whole-table ranks: equal to a sort, and one heavy value spread over all tasks."""

import random

from pyspark.sql import functions as F

from annolink.operators.ordering import time_rank
from annolink.operators.ranking import rank_rows


def test_equals_a_sort(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([None, 0, 1, 1, 1, 5]), rnd.choice("abc"), "x") for i in range(5000)]
    df = spark.createDataFrame(rows, "id int, v int, s string, __place string").repartition(7)
    order = [F.col("v").desc_nulls_last(), "s", F.col("id").asc()]
    got = {r.id: r["rank"] for r in rank_rows(df, order, ranges=9).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2], r[0]))
    assert [got[r[0]] for r in want] == list(range(1, 5001))
    again = rank_rows(df.withColumn("rank", F.lit(0)), ["id"], ranges=3)
    assert sorted(again.columns) == sorted([*df.columns, "rank"]) and all(r["rank"] == r.id + 1 for r in again.collect())


def test_empty_and_equal_rows(spark):
    df = spark.createDataFrame([(1,)] * 50, "v int")
    assert sorted(r["rank"] for r in rank_rows(df, ["v"], ranges=6).collect()) == list(range(1, 51))
    assert rank_rows(df.where("v = 2"), ["v"], ranges=6).collect() == []


def test_one_heavy_value_uses_all_tasks(spark):
    n, ranges = 400_000, 16
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("id"), F.lit(0.5).alias("confidence"))
    out = rank_rows(df, ["confidence", "id"], ranges=ranges)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "Aggregate" in plan[plan.index("Window ["):]
    got = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.count_if(F.col("rank") != F.col("id") + 1).alias("bad")).collect()
    assert sum(r.n for r in got) == n and sum(r.bad for r in got) == 0
    assert len(got) == ranges and max(r.n for r in got) < 2 * n / ranges


def test_musical_time(spark):
    rows = [("a", "2", "3", "xml_event", None, None), ("b", "2", "3", "yolo", "7", "slur"), ("c", None, "NA", "yolo", "1", "slur"), ("d", "2", None, "yolo", "1", "x"),
            ("e", "2", "3", "yolo", "7", "clef"), ("f", "1.5", "9", "xml_node", "1", "x"), ("g", "2", "3", "other", "1", "x")]
    df = spark.createDataFrame(rows, "record_id string, start_meas string, end_meas string, source_record_type string, yolo_line string, class string")
    assert [r.record_id for r in time_rank(df).orderBy("time_rank").collect()] == ["f", "e", "b", "a", "g", "d", "c"]
