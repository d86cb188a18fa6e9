"""Exact ranks over a whole table.

The table is cut into ranges of its order from a sample (Spark's range partitioning), each range is sorted in its own
task and written as a reliable checkpoint. The place of a row is then the rows of all ranges before, one number for
each range, and its place in the range, which is the place in the checkpoint's partition. The order takes part in
the cut with all its columns, so rows of one heavy value are split by the columns that break ties. The only window
without keys runs over one row for each range.

Contract: the order is total. Rows equal in all order columns stay in one range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

#: monotonically_increasing_id() counts rows of a partition in its lower bits.
PLACE_BITS = 33


def _unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def rank_rows(df: DataFrame, order: Sequence[str | Column], out: str = "rank", ranges: int | None = None) -> DataFrame:
    """Add the row number (from 1) of each row in the order of the whole table.

    ranges: number of tasks that sort, spark.sql.shuffle.partitions by default. An empty table stays empty; a
    column named `out` is replaced.
    """
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = settle(df.repartitionByRange(n, *order).sortWithinPartitions(*order))
    place = _unused(df, "__place")
    # the checkpoint keeps partitions and their order, so the number below is the place in the sorted range
    placed = placed.withColumn(place, F.monotonically_increasing_id())
    number = F.shiftright(place, PLACE_BITS)
    rows = placed.groupBy(number.alias("__range")).agg(F.count(F.lit(1)).alias("__rows"))
    before = F.sum("__rows").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    start = rows.select(F.col("__range").alias(f"{place}r"), F.coalesce(before, F.lit(0)).alias(f"{place}n"))
    met = placed.join(F.broadcast(start), number == F.col(f"{place}r"))  # one row for each of n ranges
    rank = F.col(f"{place}n") + F.col(place).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + 1
    return met.withColumn(out, rank).drop(place, f"{place}r", f"{place}n")
