"""Sinks: fixed-schema tables, run reports, path sanitising."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename


# SNK-01 -----------------------------------------------------------------
def write_table(df: DataFrame, cols: Sequence[str], path: str, partition_by: Sequence[str] = (), fmt: str = "parquet",
                order: Sequence[str] = ()) -> None:
    """Write exactly `cols`; with partitions, only the partitions present in df are replaced.

    Rows meet by partition value first so that a partition is few files, split further by
    AQE when one value is large.
    """
    out = df.select(*cols)
    if partition_by:
        out = out.hint("rebalance", *partition_by)
    if order:
        out = out.sortWithinPartitions(*partition_by, *order)
    w = out.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    w.save(path)


# SNK-02 -----------------------------------------------------------------
def run_report(metrics: DataFrame, errors: DataFrame) -> DataFrame:
    """Long report (stage, metric, key, value) with the error counts and a passed flag per stage.

    metrics: stage, metric, key, value. errors: stage, rule, detail.
    """
    e = errors.groupBy("stage", F.col("rule").alias("key")).agg(F.count(F.lit(1)).alias("value"))
    e = e.select("stage", F.lit("validation_errors").alias("metric"), "key", "value")
    stages = metrics.select("stage").unionByName(errors.select("stage")).groupBy("stage").agg(F.count(F.lit(1)).alias("__n"))
    failed = errors.groupBy("stage").agg(F.count(F.lit(1)).alias("__e"))
    p = stages.join(failed, "stage", "left").select(
        "stage", F.lit("passed").alias("metric"), F.lit("").alias("key"),
        F.when(F.coalesce("__e", F.lit(0)) == 0, 1).otherwise(0).cast("bigint").alias("value"))
    return metrics.select("stage", "metric", "key", F.col("value").cast("bigint").alias("value")).unionByName(e).unionByName(p)


def write_report(metrics: DataFrame, errors: DataFrame, path: str) -> None:
    run_report(metrics, errors).write.mode("overwrite").partitionBy("stage").parquet(f"{path}/report")
    errors.write.mode("overwrite").parquet(f"{path}/errors")


# SNK-03 -----------------------------------------------------------------
def basename_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Keep only the file name in path columns (by default every column named *_path)."""
    cols = [c for c in df.columns if c.endswith("_path")] if cols is None else cols
    return df.withColumns({c: basename(c) for c in cols})
