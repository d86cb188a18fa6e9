"""Sort orders and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classes import lookup
from ..functions.text import _c, norm_text, try_float, try_int
from .ranking import rank_rows
from .scan import number_rows

SOURCE_RANK = {"yolo": 0, "xml_event": 1, "xml": 1, "xml_node": 2}  # fixed values


# SRT-01 -----------------------------------------------------------------
def time_order(source="source_record_type") -> list[Column]:
    """Musical time: start and end (unknown last), kind of source, line, class, id."""
    return [
        try_float("start_meas").asc_nulls_last(),
        try_float("end_meas").asc_nulls_last(),
        F.coalesce(lookup(SOURCE_RANK, source), F.lit(3)).asc(),
        try_float("yolo_line").asc_nulls_last(),
        F.coalesce(F.col("class"), F.lit("")).asc(),
        F.coalesce(F.col("record_id"), F.lit("")).asc(),
    ]


def time_sort(df: DataFrame, source="source_record_type", within_files=False) -> DataFrame:
    order = time_order(source)
    return df.sortWithinPartitions(*order) if within_files else df.orderBy(*order)


def time_rank(df: DataFrame, source="source_record_type", out="time_rank") -> DataFrame:
    """Exact place of every row in musical time over the whole table."""
    return rank_rows(df, time_order(source), out)


# SRT-02 -----------------------------------------------------------------
def priority_columns(status="combined_status", confidence="confidence") -> dict[str, Column]:
    """Risk first: ambiguous before the rest, then low confidence (unreadable counts as -1)."""
    return {
        "__p0": F.when(_c(status) == "ambiguous", 0).otherwise(1),
        "__p1": F.coalesce(try_float(confidence), F.lit(-1.0)),
    }


def priority_rank(df: DataFrame, tail, out="queue_rank", status="combined_status", confidence="confidence",
                  keys=(), fine: Column | None = None) -> DataFrame:
    """Exact rank in risk-first order over the whole table, by ranges of the full order (or per keys).

    Per keys, cells are the status and a hundredth of confidence, or a finer column that grows
    with the order, so that no task sees more than one such slice.
    """
    pc = priority_columns(status, confidence)
    out_df = df.withColumns(pc)
    cells = [F.col("__p0"), F.floor(F.col("__p1") * 100).cast("int")]
    if fine is not None:
        cells = [F.col("__p0"), F.col("__p1"), fine]
    return number_rows(out_df, list(keys), ["__p0", "__p1", *tail], out, cells).drop("__p0", "__p1")


# SRT-03 -----------------------------------------------------------------
def reader_queue(rows: DataFrame, decisions: DataFrame, page=None, class_name=None, status=None, include_matched=False) -> DataFrame:
    """Review list with the saved action: open items first, unmatched first, low confidence first."""
    s = F.coalesce(norm_text("status"), F.lit("unresolved"))
    out = rows.withColumn("status", s)
    if not include_matched:
        out = out.where(F.col("status") != "matched")
    for name, want in (("page_id", page), ("class", class_name), ("status", status)):
        if want:
            out = out.where(F.col(name) == want)
    d = decisions.select("page_id", "yolo_line", F.col("action").alias("__a"))
    out = out.join(d, ["page_id", "yolo_line"], "left")
    out = out.withColumn("saved_action", F.coalesce(norm_text("__a"), F.lit("pending"))).drop("__a")
    open_ = F.when(F.col("saved_action").isin("pending", "uncertain", "skipped"), 0).otherwise(1)
    return out.withColumns({
        "open_rank": open_, "matched_rank": F.when(F.col("status") == "matched", 1).otherwise(0),
        "conf_rank": F.coalesce(try_float("confidence"), F.lit(-1.0)), "line_rank": F.coalesce(try_int("yolo_line"), F.lit(0)),
    })


READER_ORDER = ["open_rank", "matched_rank", "conf_rank", "page_id", "line_rank"]


def reader_rank(queue: DataFrame, out="queue_rank") -> DataFrame:
    """Exact place of every row of a reader_queue over the whole table."""
    return rank_rows(queue, READER_ORDER, out)


# SRT-04 -----------------------------------------------------------------
def top_k(df: DataFrame, keys, order: list[Column], k: int, out="rank") -> DataFrame:
    """k first rows per group; map tasks already drop rows past their own k-th."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)
