"""Units built in attempts: one failing unit does not keep the others from being committed.

An attempt builds a group of units in one Spark job and writes their rows below a folder of its own. The rows count
from the moment the ledger names that attempt for the unit, so an attempt that was lost half way leaves nothing but a
folder that no entry points to. Where an attempt fails, its units are halved and each half is tried again, until the
units that fail stand alone and get a dead-letter entry with their error. k bad units among n cost some k log n
attempts, each over fewer units; without a failure there is one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, settle

MAX_ERROR = 2000


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder of the cluster."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/units-{uuid.uuid4().hex}"


def _note(entries: DataFrame, version: str, attempt: str, ledger_path: str) -> None:
    """Append entries (unit_id, digest, status, row_count, error) to the ledger."""
    entries.select("unit_id", "digest", F.lit(version).alias("version"), "status", F.col("row_count").cast("bigint").alias("row_count"),
                   F.current_timestamp().alias("noted_at"), F.lit(attempt).alias("attempt"), "error").write.mode("append").parquet(ledger_path)


def run_units(todo: DataFrame, source: DataFrame, build: Callable[[DataFrame], DataFrame], out_path: str, ledger_path: str, version: str,
              fail_fast: bool = False) -> dict[str, int]:
    """Build the pending units (see pending) and note each one in the ledger; returns units by status and the attempts made.

    build works on all source rows of a group of units and keeps unit_id. A unit whose rows are not as many as
    expected is failed. An error in the plan itself, which no unit can be blamed for, and with fail_fast any error, is
    raised. Null unit ids are not built.
    """
    spark = todo.sparkSession
    todo = settle(todo.where("unit_id is not null").select("unit_id", "digest", "expected_rows"))
    stack, tally = [(todo, 0)], {"completed": 0, "failed": 0, "attempts": 0}
    while stack:
        group, depth = stack.pop()
        n = group.count()
        if not n:
            continue
        attempt = f"a-{uuid.uuid4().hex}"
        path = f"{out_path}/attempt={attempt}"
        tally["attempts"] += 1
        try:
            build(source.join(group.select("unit_id"), "unit_id", "left_semi")).write.parquet(path)
        except AnalysisException:
            raise
        except Exception as error:
            if fail_fast:
                raise
            if n > 1:
                bit = F.shiftright(F.xxhash64(F.lit(depth // 60), "unit_id"), depth % 60).bitwiseAND(F.lit(1))
                stack += [(settle(group.where(bit == side)), depth + 1) for side in (0, 1)]
            else:
                bad = group.withColumns({"status": F.lit("failed"), "row_count": F.lit(0), "error": F.lit(str(error)[:MAX_ERROR])})
                _note(bad, version, attempt, ledger_path)
                tally["failed"] += 1
            continue
        rows = spark.read.parquet(path).groupBy("unit_id").agg(F.count(F.lit(1)).alias("row_count"))
        done = group.join(rows, "unit_id", "left").withColumn("row_count", F.coalesce("row_count", F.lit(0)))
        wrong = F.col("expected_rows").isNotNull() & (F.col("row_count") != F.col("expected_rows"))
        done = settle(done.withColumns({"status": F.when(wrong, "failed").otherwise("completed"),
                                        "error": F.when(wrong, F.format_string("%d rows, expected %d", F.col("row_count"), F.col("expected_rows")))}))
        _note(done, version, attempt, ledger_path)
        failed = done.where("status = 'failed'").count()
        tally["completed"] += n - failed
        tally["failed"] += failed
    return tally


def last_entries(ledger: DataFrame) -> DataFrame:
    """Last entry of each unit, with its attempt and error."""
    entry = F.struct("digest", "version", "status", "row_count", "attempt", "error")
    return ledger.groupBy("unit_id").agg(F.max_by(entry, "noted_at").alias("l")).select("unit_id", "l.*")


def committed(spark: SparkSession, out_path: str, ledger_path: str) -> DataFrame:
    """Rows of the attempts that the ledger names; rows of lost, failed and replaced attempts are left out."""
    good = last_entries(spark.read.parquet(ledger_path)).where("status = 'completed'").select("unit_id", "attempt")
    return spark.read.parquet(out_path).join(good, ["unit_id", "attempt"]).drop("attempt")


def unit_results(ledger: DataFrame) -> DataFrame:
    """unit_id, rows, error: what batch_summary counts."""
    return last_entries(ledger).select("unit_id", F.col("row_count").alias("rows"), "error")
