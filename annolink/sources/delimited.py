"""Delimited text with quoted line breaks, in parallel inside one file.

A physical line is a map of two states, outside and inside a quoted field: for each state before it, the state after
it, found by one linear pattern. Maps are constant, the identity or a swap, so a run of lines composes to "the value
of the last constant, turned as often as swaps follow", and two running values over (chunk, line) give the state
before every line. A chunk is what one file split holds, so chunks of one large file are worked on in different tasks
and only chunk summaries meet. A record starts at every line outside quotes; its number is one more running sum.

Quotes count as the csv module of Python counts them: they open a field only at its start, are doubled inside, and
what follows a closing quote up to the separator belongs to the field. Empty lines between records are no rows. A
quote that is never closed runs to the end of its file. Separators are single characters, lines end with \\n or \\r\\n.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import Fold, scan
from ..session import settle

QUOTED = r'[^"]*+(?:""[^"]*+)*+'
KEY = ["file", "name", "block"]


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """file, name, block, pos, line: physical lines of files in order of (block, pos).

    Kept as a reliable checkpoint, since the cut of files into splits can differ from one reading to the next.
    """
    raw = spark.read.option("lineSep", "\n").text(paths)
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))
    # a byte order mark stands at the start of a file
    return settle(lines.withColumn("line", F.when(F.col("block") == 0, F.regexp_replace("line", "^﻿", "")).otherwise(F.col("line"))))


def _patterns(sep: str) -> tuple[str, str]:
    """Lines that end inside quotes: when they start outside, and when they start inside."""
    if len(sep) != 1 or sep in '"\r\n':
        raise ValueError("the separator must be one character other than a quote or a line end")
    s = re.escape(sep)
    rest = rf"[^{s}]*+"
    whole = rf'(?:(?:"{QUOTED}"{rest}|(?!"){rest}){s})*+'
    opened = rf'{whole}"{QUOTED}$'
    return rf"^{opened}", rf'^{QUOTED}(?:$|"{rest}{s}{opened})'


def records(lines: DataFrame, sep: str = ",") -> DataFrame:
    """file, name, block, row (from 1, the header included), record; one row per logical record.

    lines: file, name, block, pos, line; block never falls along pos. A record is one value: only records of
    several lines are put together, each from its own lines.
    """
    outside, inside = _patterns(sep)
    d = lines.select(*KEY, "pos", "line", F.col("line").rlike(outside).alias("__out"), F.col("line").rlike(inside).alias("__in"))
    keys, order, cells = ["file", "name"], ["block", "pos"], [F.col("block")]
    swap, const = F.col("__out") & ~F.col("__in"), F.col("__out") == F.col("__in")
    d = scan(d, keys, order, [Fold("__swaps", "sum", swap.cast("int"), inclusive=False)], cells)
    d = scan(d, keys, order, [Fold("__set", "last", F.when(const, F.struct(F.col("__out").alias("v"), F.col("__swaps").alias("n"))), inclusive=False)], cells)
    turned = (F.col("__swaps") - F.coalesce("__set.n", F.lit(0))) % 2 == 1
    d = d.withColumn("__open", F.coalesce("__set.v", F.lit(False)) != turned)
    d = d.where(F.col("__open") | (F.regexp_replace("line", r"\r$", "") != ""))
    d = scan(d, keys, order, [Fold("row", "sum", (~F.col("__open")).cast("int"))], cells)
    after = F.when(F.col("__open"), F.col("__in")).otherwise(F.col("__out"))
    d = d.withColumn("__alone", ~F.col("__open") & ~after)
    part = F.array_sort(F.collect_list(F.struct("pos", "line")))
    several = d.where("not __alone").groupBy("file", "name", "row").agg(F.min("block").alias("block"), F.array_join(F.transform(part, lambda p: p["line"]), "\n").alias("record"))
    every = d.where("__alone").select(*KEY, "row", F.col("line").alias("record")).unionByName(several)
    return every.withColumn("record", F.regexp_replace("record", r"\r$", ""))


def raw_fields(record, sep: str = ",") -> Column:
    """Fields of a record as they stand, quotes included."""
    s = re.escape(sep)
    return F.regexp_extract_all(F.concat(F.lit(sep), record), F.lit(rf'{s}("{QUOTED}(?:"[^{s}]*+)?+|[^{s}]*+)'), F.lit(1))


def unquoted(field: Column) -> Column:
    """Value of a field: outer quotes off, doubled quotes single, text after the closing quote kept."""
    pattern = rf'(?s)^"({QUOTED})(?:"(.*))?$'
    value = F.concat(F.replace(F.regexp_extract(field, pattern, 1), F.lit('""'), F.lit('"')), F.regexp_extract(field, pattern, 2))
    return F.when(field.startswith('"'), value).otherwise(field)


def rows(lines: DataFrame, sep: str = ",") -> DataFrame:
    """file, name, row (from 2: the header is row 1), names, fields; one row per record below the header of its file.

    Headers meet the records of their file chunk by chunk, so that a large file is not gathered by its name.
    """
    r = settle(records(lines, sep))
    fields = raw_fields(F.col("record"), sep)
    head = r.where("row = 1").select("file", "name", F.transform(fields, lambda c: F.trim(unquoted(c))).alias("names"))
    head = r.select(*KEY).distinct().join(head, ["file", "name"])
    return r.where("row > 1").select(*KEY, "row", fields.alias("fields")).join(head, KEY).drop("block")


def field(name: str) -> Column:
    """Raw field of a column by its header; of a repeated header the last one, null where there is none."""
    at = F.array_position(F.reverse(F.col("names")), name)
    return F.when(at > 0, F.get(F.col("fields"), (F.size("names") - at).cast("int")))


def typed(table: DataFrame, ddl: str, empty_is_null: bool = False) -> dict[str, Column]:
    """The columns of a DDL list from rows(); a value that does not fit its type is null."""
    out = {}
    for part in ddl.split(","):
        name, kind = part.strip().split(" ", 1)
        raw = field(name)
        out[name] = (F.when(raw != "", unquoted(raw)) if empty_is_null else unquoted(raw)).try_cast(kind)
    return out


def header_names(table: DataFrame) -> list[str]:
    """All column names of all headers, sorted; as many as there are columns, not files."""
    found = table.select("names").distinct().select(F.explode("names").alias("n")).where("n <> ''").distinct()
    return sorted(r.n for r in found.collect())
