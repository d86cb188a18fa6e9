"""Smallest (value, id) per key in a form that Spark can aggregate by hashing.

min(struct) keeps a variable-size buffer, which forces a sort of every map partition. Two
whole numbers fit one decimal, whose order is that of the pair, and min_by over it keeps
fixed-size buffers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHOLE = ("tinyint", "smallint", "int", "bigint")


def smallest(df: DataFrame, keys, value: str, row_id: str) -> DataFrame:
    """keys, value, row_id of the smallest pair per key. Ids must not be negative."""
    types = dict(df.dtypes)
    if types[value] in WHOLE and types[row_id] in WHOLE:
        pair = F.col(value).cast("decimal(19,0)") * F.lit(str(10**19)).cast("decimal(20,0)") + F.col(row_id).cast("decimal(19,0)")
        d = df.select(*keys, value, row_id, pair.alias("__pair"))
        return d.groupBy(*keys).agg(F.min_by(value, "__pair").alias(value), F.min_by(row_id, "__pair").alias(row_id))
    m = df.groupBy(*keys).agg(F.min(F.struct(value, row_id)).alias("__m"))
    return m.select(*keys, "__m.*")
