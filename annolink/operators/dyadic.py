"""Interval covers by aligned power-of-two blocks.

An integer interval is the union of at most two blocks per level. A point lies in one
block per level. Matching points to intervals then becomes an equi-join on blocks, and
blocks can be aggregated before the join, so no point/interval pairs are formed.

Ticks lie in [0, 2**bits); a block is one bigint, its place in the binary tree of blocks.
Rows are exploded by level and everything else is plain arithmetic inside codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shr(x: Column, j: Column) -> Column:
    return F.call_function("shiftright", x, j)


def place(level: Column, cell: Column, bits: int) -> Column:
    """Number of a block: 2**(bits - level) + cell."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(bits) - level) + cell


def _inside(x: Column, bits: int) -> Column:
    x = x.cast("bigint")
    return F.when(x.isNull() | ((x >= 0) & (x < (1 << bits))), x).otherwise(
        F.raise_error(F.concat(F.lit(f"tick outside [0, 2**{bits}): "), x.cast("string"))).cast("bigint"))


def node_rows(df: DataFrame, x: Column, bits: int, out: str = "node", levels: int | None = None) -> DataFrame:
    """One row per block (levels 0..levels) that holds tick x."""
    top = bits if levels is None else min(levels, bits)
    d = df.withColumn("__x", _inside(x, bits)).withColumn("__lv", F.explode(F.sequence(F.lit(0), F.lit(top))))
    return d.withColumn(out, place(F.col("__lv"), shr(F.col("__x"), F.col("__lv")), bits)).where(F.col("__x").isNotNull()).drop("__x", "__lv")


def cover_rows(df: DataFrame, lo: Column, hi: Column, bits: int, out: str = "node", levels: int | None = None) -> DataFrame:
    """One row per block of the disjoint cover of [lo, hi]; an empty interval gives no row.

    On each level an odd first block and an odd end are split off; the top level takes all
    that is left. Choose levels near log2 of the usual length: points then need few levels,
    and a longer interval only takes more blocks of the top level.
    """
    top = bits if levels is None else min(levels, bits)
    d = df.withColumns({"__lo": _inside(lo, bits), "__hi": _inside(hi, bits) + 1}).where(F.col("__lo") < F.col("__hi"))
    d = d.withColumn("__lv", F.explode(F.sequence(F.lit(0), F.lit(top))))
    lv = F.col("__lv")
    d = d.withColumns({"__a": -shr(-F.col("__lo"), lv), "__b": shr(F.col("__hi"), lv)}).where(F.col("__a") < F.col("__b"))
    odd = lambda c: F.col(c).bitwiseAND(F.lit(1)) == 1
    edge = F.array(F.when(odd("__a"), F.col("__a")), F.when(odd("__b"), F.col("__b") - 1))
    d = d.withColumn("__cell", F.explode(F.when(lv == top, F.sequence(F.col("__a"), F.col("__b") - 1)).otherwise(edge))).where(F.col("__cell").isNotNull())
    return d.withColumn(out, place(lv, F.col("__cell"), bits)).drop("__lo", "__hi", "__lv", "__a", "__b", "__cell")
