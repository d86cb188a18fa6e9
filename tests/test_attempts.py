"""Failing units stand alone, lost attempts do not count, a second run builds only what is left."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from annolink.operators.aggregates import batch_summary
from annolink.streaming import attempts as AT
from annolink.streaming import incremental as I

EMPTY = "unit_id string, digest string, version string, status string, row_count long"


def test_one_bad_unit_and_a_lost_attempt(spark, tmp_path):
    out, led = str(tmp_path / "rows"), str(tmp_path / "ledger")
    src = spark.createDataFrame([(f"u{i:02d}", i, j) for i in range(20) for j in range(3)] + [(None, 1, 1)], "unit_id string, v int, j int")
    manifest = I.unit_digest(src.where("unit_id is not null"), ["unit_id"], ["v", "j"], "1")
    bad = lambda hurt: lambda d: d.withColumn("v", F.when(F.col("v").isin(hurt), F.raise_error(F.lit("no staff found")).cast("int")).otherwise(F.col("v") * 2))
    # an executor died after its rows were written and before the ledger knew
    src.withColumn("v", F.lit(-1)).where("unit_id = 'u03'").write.parquet(f"{out}/attempt=a-lost")
    todo = I.pending(manifest, spark.createDataFrame([], EMPTY), version="1")
    tally = AT.run_units(todo, src, bad([7, 13]), out, led, "1")
    assert (tally["completed"], tally["failed"]) == (18, 2) and 5 <= tally["attempts"] <= 25
    rows = AT.committed(spark, out, led)
    assert rows.count() == 54 and rows.where("v < 0").isEmpty() and {r.unit_id for r in rows.collect()} == {f"u{i:02d}" for i in range(20) if i not in (7, 13)}
    dead = AT.last_entries(spark.read.parquet(led)).where("status = 'failed'").collect()
    assert sorted(r.unit_id for r in dead) == ["u07", "u13"] and all("no staff found" in r.error and r.row_count == 0 for r in dead)
    got = {r.status: (r.units, r["rows"]) for r in batch_summary(manifest, AT.unit_results(spark.read.parquet(led)), "unit_id").collect()}
    assert got == {"completed": (18, 54), "failed": (2, 0)}
    # the next run takes the failed ones only
    todo = I.pending(manifest, I.latest(spark.read.parquet(led)), version="1")
    assert sorted((r.unit_id, r.reason) for r in todo.collect()) == [("u07", "failed"), ("u13", "failed")]
    assert AT.run_units(todo, src, bad([13]), out, led, "1") == {"completed": 1, "failed": 1, "attempts": 3}
    assert AT.committed(spark, out, led).count() == 57
    # a changed unit is built again and replaces what it had
    src2 = src.unionByName(spark.createDataFrame([("u03", 3, 9)], src.schema))
    todo = I.pending(I.unit_digest(src2.where("unit_id is not null"), ["unit_id"], ["v", "j"], "1"), I.latest(spark.read.parquet(led)), version="1").where("reason = 'stale'")
    assert AT.run_units(todo, src2, bad([]), out, led, "1")["completed"] == 1
    assert AT.committed(spark, out, led).where("unit_id = 'u03'").count() == 4


def test_missing_rows_and_faults_of_the_plan(spark, tmp_path):
    out, led = str(tmp_path / "rows"), str(tmp_path / "ledger")
    src = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "unit_id string, v int")
    todo = I.pending(I.unit_digest(src, ["unit_id"], ["v"]), spark.createDataFrame([], EMPTY))
    assert AT.run_units(todo, src, lambda d: d.where("v <> 2"), out, led, "") == {"completed": 1, "failed": 1, "attempts": 1}
    assert [(r.unit_id, r.error) for r in AT.last_entries(spark.read.parquet(led)).where("status = 'failed'").collect()] == [("a", "1 rows, expected 2")]
    assert [r.unit_id for r in AT.committed(spark, out, led).collect()] == ["b"]
    with pytest.raises(AnalysisException):
        AT.run_units(todo, src, lambda d: d.select("unit_id", "nowhere"), out, led, "")
    with pytest.raises(Exception, match="stop"):
        AT.run_units(todo, src, lambda d: d.withColumn("v", F.raise_error(F.lit("stop"))), out, led, "", fail_fast=True)
    assert AT.run_units(todo.where("false"), src, lambda d: d, out, led, "") == {"completed": 0, "failed": 0, "attempts": 0}
