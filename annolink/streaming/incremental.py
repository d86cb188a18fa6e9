"""Fingerprints, ledger, resumable batches and their streaming twin."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classes import recode_status
from ..operators.quality import expect_same_keys, expect_unique
from ..session import settle


# INC-01 -----------------------------------------------------------------
def digest(cols: Sequence[str], version: str = "") -> Column:
    """SHA-256 of the named columns in name order plus a version; equal inputs give equal digests."""
    return F.sha2(F.to_json(F.struct(*[F.col(c).alias(c) for c in sorted(cols)], F.lit(version).alias("~version")), {"ignoreNullFields": "false"}), 256)


def unit_digest(df: DataFrame, unit: Sequence[str], cols: Sequence[str], version: str = "") -> DataFrame:
    """One digest per unit over its rows, independent of their order: 120 hash bits summed."""
    h = df.withColumn("__h", digest(cols, version))
    part = lambda i: F.conv(F.substring("__h", i, 15), 16, 10).cast("decimal(20,0)")
    g = h.groupBy(*unit).agg(F.count(F.lit(1)).alias("expected_rows"), F.sum(part(1)).alias("a"), F.sum(part(16)).alias("b"))
    return g.select(*unit, F.concat_ws(":", *[F.col(c).cast("string") for c in ("expected_rows", "a", "b")]).alias("digest"), "expected_rows")


# INC-02 -----------------------------------------------------------------
def pending(manifest: DataFrame, ledger: DataFrame, outputs: DataFrame | None = None, version: str = "") -> DataFrame:
    """Units that must run, with the reason: new, failed, stale, wrong row count, duplicate rows.

    manifest: unit_id, digest, expected_rows (NULL where not known beforehand). ledger: unit_id, digest, version, status,
    row_count (the last entry of a unit). outputs: unit_id, rows, distinct_rows as found.
    """
    l = ledger.select("unit_id", F.col("digest").alias("__d"), F.col("version").alias("__v"), F.col("status").alias("__s"), F.col("row_count").alias("__n"))
    j = manifest.join(l, "unit_id", "left")
    rows, dup = F.col("__n"), F.lit(False)
    if outputs is not None:
        j = j.join(outputs.select("unit_id", "rows", "distinct_rows"), "unit_id", "left")
        rows, dup = F.coalesce("rows", F.lit(0)), F.coalesce(F.col("rows") != F.col("distinct_rows"), F.lit(False))
    why = (
        F.when(F.col("__s").isNull(), "new").when(F.col("__s") != "completed", "failed")
        .when(~F.col("__d").eqNullSafe(F.col("digest")) | ~F.col("__v").eqNullSafe(F.lit(version)), "stale")
        .when(F.col("expected_rows").isNotNull() & (~rows.eqNullSafe(F.col("expected_rows")) | ~F.col("__n").eqNullSafe(F.col("expected_rows"))), "row_count").when(dup, "duplicate_rows"))
    return j.withColumn("reason", why).where("reason is not null").select("unit_id", "digest", "expected_rows", "reason")


def run_pending(todo: DataFrame, source: DataFrame, build: Callable[[DataFrame], DataFrame], out_path: str, ledger_path: str, version: str) -> int:
    """Build the pending units into their own partitions and note them in the ledger; returns how many.

    Only the pending units are built, written and counted; other partitions are not read. One error fails the run;
    attempts.run_units keeps failing units apart.
    """
    todo = settle(todo.select("unit_id", "digest", "expected_rows"))
    n = todo.count()
    if n:
        out = settle(build(source.join(todo.select("unit_id"), "unit_id", "left_semi")))
        out.write.mode("overwrite").partitionBy("unit_id").option("partitionOverwriteMode", "dynamic").parquet(out_path)
        done = out.groupBy("unit_id").agg(F.count(F.lit(1)).alias("row_count"))
        todo.join(done, "unit_id", "left").select(
            "unit_id", "digest", F.lit(version).alias("version"), F.when(F.col("expected_rows").isNull() | (F.coalesce("row_count", F.lit(0)) == F.col("expected_rows")), "completed").otherwise("failed").alias("status"),
            F.coalesce("row_count", F.lit(0).cast("bigint")).alias("row_count"), F.current_timestamp().alias("noted_at")).write.mode("append").parquet(ledger_path)
    return n


def latest(ledger: DataFrame) -> DataFrame:
    """Last entry of each unit of an append-only ledger."""
    return ledger.groupBy("unit_id").agg(F.max_by(F.struct("digest", "version", "status", "row_count"), "noted_at").alias("l")).select("unit_id", "l.*")


def stream_units(spark: SparkSession, path: str, schema, build: Callable[[DataFrame], DataFrame], out_path: str, checkpoint: str):
    """Streaming twin: new files since the last run, processed in bounded batches, then stop.

    A batch that is replayed replaces its own partition, so a retry leaves no duplicates.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        build(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").partitionBy("batch_id").option("partitionOverwriteMode", "dynamic").parquet(out_path)

    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10_000).parquet(path)
    return src.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# INC-03 -----------------------------------------------------------------
def adopt(manifest: DataFrame, outputs: DataFrame, keys: Sequence[str], version: str) -> tuple[DataFrame, DataFrame]:
    """(ledger rows, errors) for outputs made earlier: keys unique, unit set and row counts as expected."""
    n = outputs.groupBy("unit_id").agg(F.count(F.lit(1)).alias("row_count"))
    j = manifest.join(n, "unit_id", "left")
    bad = j.where(~F.col("row_count").eqNullSafe(F.col("expected_rows")))
    err = bad.select(F.lit("row_count").alias("rule"), F.col("unit_id").cast("string").alias("detail")).unionByName(expect_unique(outputs, keys)).unionByName(expect_same_keys(outputs, manifest, ["unit_id"]))
    dup = outputs.groupBy("unit_id", *keys).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("unit_id").distinct()
    ok = j.where(F.col("row_count") == F.col("expected_rows")).join(dup, "unit_id", "left_anti")
    return ok.select("unit_id", "digest", F.lit(version).alias("version"), F.lit("completed").alias("status"), "row_count"), err


# INC-04 -----------------------------------------------------------------
def reusable(have: DataFrame, expected: DataFrame, unit: Sequence[str], cols: Sequence[str], inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Units whose stored rows equal the expected ones and whose output is newer than every input.

    inputs and outputs: unit, mtime.
    """
    a, b = unit_digest(have, unit, cols).withColumnRenamed("digest", "__have"), unit_digest(expected, unit, cols)
    t = inputs.groupBy(*unit).agg(F.max("mtime").alias("__in")).join(outputs.groupBy(*unit).agg(F.min("mtime").alias("__out")), list(unit))
    j = b.join(a.drop("expected_rows"), list(unit), "left").join(t, list(unit), "left")
    ok = F.coalesce((F.col("digest") == F.col("__have")) & (F.col("__out") >= F.col("__in")), F.lit(False))
    return j.select(*unit, ok.alias("reusable"))


# INC-06 -----------------------------------------------------------------
def canonical_rows(detail: DataFrame, pages: DataFrame, version: str, dataset: str) -> DataFrame:
    """Master rows: identity, recoded status, page provenance, version.

    detail: page_id, yolo_line, status, and the row's own columns. pages: page_id and its
    provenance columns (score_id, paths, hashes).
    """
    out = detail.join(pages, "page_id", "left")
    return out.withColumns({
        "dataset_id": F.lit(dataset), "bbox_id": F.concat(F.col("page_id").cast("string"), F.lit(":Y"), F.col("yolo_line").cast("string")), "alignment_status": recode_status("status"),
        "review_status": F.lit("needs_review"), "human_approved": F.lit("false"), "pipeline_version": F.lit(version), "page_known": F.col("score_id").isNotNull()})


# INC-07 -----------------------------------------------------------------
def prepare_score(sources: DataFrame, build: Callable[[DataFrame], DataFrame], ledger: DataFrame | None, out_path: str, ledger_path: str, version: str) -> int:
    """Score-level tables shared by all pages, built once per content.

    sources: score_id and the content columns; the unit is the score and its digest covers
    every column, so a changed source is built again and an unchanged one is not. ledger: all its entries, or the
    last one of each unit.
    """
    cols = [c for c in sources.columns if c != "score_id"]
    m = unit_digest(sources, ["score_id"], cols, version).withColumnRenamed("score_id", "unit_id")
    m = m.withColumn("expected_rows", F.lit(None).cast("bigint"))  # known only once built
    if ledger is None:
        todo = m
    else:
        todo = pending(m, latest(ledger) if "noted_at" in ledger.columns else ledger, version=version)
    return run_pending(todo, sources.withColumnRenamed("score_id", "unit_id"), lambda d: build(d.withColumnRenamed("unit_id", "score_id")).withColumnRenamed("score_id", "unit_id"), out_path, ledger_path, version)
