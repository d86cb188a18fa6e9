"""Expectations: every check returns error rows (rule, detail); no rows means it holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import valid_box
from ..functions.text import _c


def _rows(df: DataFrame, rule: str, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))


def _key(keys) -> Column:
    return F.concat_ws("|", *[F.col(k).cast("string") for k in keys])


# SET-05 -----------------------------------------------------------------
def expect_subset(df: DataFrame, other: DataFrame, keys, rule="not_a_subset") -> DataFrame:
    d = df.select(*keys).distinct().join(other.select(*keys), list(keys), "left_anti")
    return _rows(d, rule, _key(keys))


def expect_same_keys(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    return expect_subset(a, b, keys, "missing_on_the_right").unionByName(expect_subset(b, a, keys, "missing_on_the_left"))


def expect_disjoint(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    return _rows(a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_semi"), "in_both", _key(keys))


def expect_unique(df: DataFrame, keys) -> DataFrame:
    d = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return _rows(d, "duplicate_key", _key(keys))


# SET-06 -----------------------------------------------------------------
def expect_unchanged(src: DataFrame, out: DataFrame, keys, cols: Sequence[str]) -> DataFrame:
    """Rows whose source columns differ in the output; NULL equals NULL only."""
    o = out.select(*keys, *[F.col(c).alias(f"__o_{c}") for c in cols])
    j = src.select(*keys, *cols).join(o, list(keys))
    changed = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__o_{c}")), F.lit(c)) for c in cols]), lambda x: x.isNotNull())
    d = j.withColumn("__ch", changed).where(F.size("__ch") > 0)
    return _rows(d, "changed_field", F.concat(_key(keys), F.lit(":"), F.array_join("__ch", ",")))


# SET-07 -----------------------------------------------------------------
def expect_refs(df: DataFrame, keys, array: str, target: DataFrame, target_key: str) -> DataFrame:
    """Ids inside an array column that do not exist in the target."""
    d = df.select(*keys, F.explode(array).alias(target_key)).join(target.select(target_key), target_key, "left_anti")
    return _rows(d, "dangling_reference", F.concat(_key(keys), F.lit("->"), F.col(target_key).cast("string")))


def expect_json(df: DataFrame, keys, col: str) -> DataFrame:
    t = F.col(col)
    return _rows(df.where(t.isNotNull() & (t != "") & F.try_parse_json(t).isNull()), "invalid_json", _key(keys))


# INC-05 -----------------------------------------------------------------
def validate_boxes(boxes: DataFrame, keys, classes: DataFrame | None = None, class_id: str = "class_id") -> DataFrame:
    """Geometry outside the page, and class ids the dictionary does not know."""
    bad = _rows(boxes.where(~valid_box("x", "y", "w", "h")), "bad_geometry", _key(keys))
    if classes is None:
        return bad
    unknown = boxes.join(classes.select(F.col("id").alias(class_id)).distinct(), class_id, "left_anti")
    return bad.unionByName(_rows(unknown, "unknown_class", _key(keys)))


def validate_pages(pages: DataFrame, boxes: DataFrame, max_pages: int = 200) -> DataFrame:
    """Pages without boxes, and too many pages in one request."""
    none = _rows(pages.join(boxes.select("page_id"), "page_id", "left_anti"), "empty_table", F.col("page_id"))
    n = pages.groupBy("request_id").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > max_pages)
    return none.unionByName(_rows(n, "page_limit", F.concat(F.col("request_id").cast("string"), F.lit(":"), F.col("__n").cast("string"))))


def validate_mapping(edits: DataFrame, pages: DataFrame) -> DataFrame:
    """Edited page numbers: the same page names, whole positive numbers, none used twice.

    edits: stem, page_text. pages: stem.
    """
    from ..functions.text import try_float

    v = try_float("page_text")
    bad = edits.where(v.isNull() | (v != F.floor(v)) | (v < 1))
    e = _rows(bad, "page_not_positive_integer", F.col("stem"))
    ok = edits.where(v.isNotNull() & (v == F.floor(v)) & (v >= 1)).withColumn("__p", F.floor(v).cast("bigint"))
    return expect_same_keys(edits, pages, ["stem"]).unionByName(e).unionByName(expect_unique(ok, ["__p"]))
