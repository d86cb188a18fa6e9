"""File sources: label files, dictionaries, note tables, CSVs, JSON configs, inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import try_float, try_int
from ..session import settle
from . import delimited


def _lines(df: DataFrame, text: str) -> DataFrame:
    """Rows of a text with their 1-based physical line number; a final line break ends no extra line."""
    parts = F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n")
    return df.select("*", F.posexplode(parts).alias("__p", "line")).withColumn("line_no", F.col("__p") + 1).drop("__p", text)


# SRC-01 -----------------------------------------------------------------
def parse_labels(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(boxes, errors) from label texts: class id and four numbers per line.

    Blank lines are skipped but counted, so line numbers stay those of the file.
    """
    d = _lines(docs.select(key, text), text).where(F.trim("line") != "")
    f = F.split(F.trim("line"), r"\s+")
    nums = [try_float(F.get(f, F.lit(i))) for i in range(1, 5)]
    cls = try_int(F.get(f, F.lit(0)))
    ok = (F.size(f) == 5) & cls.isNotNull()
    for n in nums:
        ok = ok & n.isNotNull()
    d = d.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    boxes = d.where("__ok").select(key, F.col("line_no").alias("yolo_line"), cls.cast("int").alias("class_id"), *[n.alias(c) for n, c in zip(nums, "xywh")])
    return boxes, d.where("not __ok").select(key, F.col("line_no").alias("yolo_line"), F.size(f).alias("fields"), "line")


def read_labels(spark: SparkSession, path, categories: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Label files, one page per file; the page is the file name without its ending."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("page_id"), "value")
    boxes, errors = parse_labels(raw, "page_id", "value")
    if categories is not None:
        boxes = boxes.join(categories.select(F.col("id").cast("int").alias("class_id"), F.col("name").alias("class")), "class_id", "left")
    return boxes, errors


# SRC-02 -----------------------------------------------------------------
def read_categories(spark: SparkSession, path) -> DataFrame:
    """(id, name) of a category file; of a repeated id the last entry counts, an empty name is an error."""
    raw = spark.read.schema("categories array<struct<id:int,name:string>>").json(path, multiLine=True)
    c = raw.select(F.posexplode("categories").alias("pos", "c")).select("pos", "c.*")
    name = F.when(F.trim(F.coalesce("name", F.lit(""))) == "", F.raise_error(F.lit("category without a name"))).otherwise(F.col("name"))
    return c.groupBy("id").agg(F.max_by(name, "pos").alias("name"))


# SRC-03 -----------------------------------------------------------------
def _stem(name) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def positional_rows(lines: DataFrame, ddl: str, sep: str = ";", id_col: str = "note_id", group: str = "score_id") -> DataFrame:
    """Records of delimited lines (see delimited.py) whose key is the zero-based row position inside the file."""
    d = delimited.rows(lines, sep)
    cols = {n: c.alias(n) for n, c in delimited.typed(d, ddl).items() if n != id_col}
    return d.select(_stem("name").alias(group), (F.col("row") - 2).cast("bigint").alias(id_col), *cols.values())


def read_positional_csv(spark: SparkSession, path, ddl: str, sep: str = ";", id_col: str = "note_id", group: str = "score_id") -> DataFrame:
    """Delimited tables whose key is the zero-based row position inside the file."""
    return positional_rows(delimited.read_lines(spark, path), ddl, sep, id_col, group)


# SRC-04 -----------------------------------------------------------------
def read_table(spark: SparkSession, path, ddl: str) -> DataFrame:
    """CSV with a header under a given schema; columns are taken by name, a byte order mark is skipped, an empty field is null."""
    d = delimited.rows(delimited.read_lines(spark, path))
    return d.select(*[c.alias(n) for n, c in delimited.typed(d, ddl, empty_is_null=True).items()])


# SRC-05 -----------------------------------------------------------------
def heterogeneous_rows(lines: DataFrame, sep: str = ",") -> DataFrame:
    """Lines of CSVs with different headers as one table of text columns, with source_file and source_row (the header is row 1)."""
    d = settle(delimited.rows(lines, sep))
    cols = [delimited.unquoted(delimited.field(n)).alias(n) for n in delimited.header_names(d)]
    return d.select(F.col("name").alias("source_file"), F.col("row").alias("source_row"), *cols)


def read_heterogeneous_csv(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """CSVs with different headers as one table of text columns, with source_file and source_row."""
    return heterogeneous_rows(delimited.read_lines(spark, list(paths)))


# SRC-08 -----------------------------------------------------------------
def read_repeat_map(df: DataFrame, group: str = "score_id") -> DataFrame:
    """Usable rows of a repeat map: resolved, with both indices, typed, with their occurrence order."""
    w, u = try_int("written_measure_index"), try_int("unfolded_measure_index")
    ok = (F.coalesce("mapping_status", F.lit("")) != "unresolved") & w.isNotNull() & u.isNotNull()
    return df.where(ok).withColumns({"written_measure_index": w.cast("int"), "unfolded_measure_index": u.cast("int"), "repeat_occurrence": F.coalesce(try_int("repeat_occurrence"), F.lit(1)).cast("int"),
                                     "repeat_occurrence_count": F.coalesce(try_int("repeat_occurrence_count"), F.lit(1)).cast("int")})


# SRC-09 -----------------------------------------------------------------
def parse_overrides(df: DataFrame, text: str) -> DataFrame:
    """Override config: page -> system -> mapping, one row per system."""
    ty = "struct<overrides:map<string,map<string,struct<xml_page:int,xml_systems:array<int>,mapping_status:string,movement_scope_status:string>>>>"
    o = df.select(F.from_json(text, ty).alias("c")).select(F.explode("c.overrides").alias("page_id", "s"))
    return o.select("page_id", F.explode("s").alias("k", "v")).select("page_id", F.col("k").cast("int").alias("scan_system"), "v.*")


def read_overrides(spark: SparkSession, path) -> DataFrame:
    return parse_overrides(spark.read.text(path, wholetext=True), "value")


# SRC-10 -----------------------------------------------------------------
def read_feedback(spark: SparkSession, path) -> DataFrame:
    """Feedback JSON: the header's columns on every entry, with the entry's position."""
    raw = spark.read.schema(S.REVIEW_FEEDBACK).json(path, multiLine=True)
    return raw.select("reviewer", "recorded_date", "source", F.posexplode("entries").alias("entry_no", "e")).select("reviewer", "recorded_date", "source", "entry_no", "e.*")


def read_decisions(spark: SparkSession, path, entry_ddl: str) -> DataFrame:
    """Decision JSON (header fields and entries[]) with entries of a given schema."""
    raw = spark.read.schema(f"schema_version string, alignment_fingerprint string, score_id string, pipeline_version string, reviewer string, entries array<struct<{entry_ddl}>>").json(path, multiLine=True)
    return raw.select("schema_version", F.col("alignment_fingerprint").alias("fingerprint"), "score_id", F.col("pipeline_version").alias("version"), "reviewer", F.explode("entries").alias("e")).select("*", "e.*").drop("e")


# SRC-11 -----------------------------------------------------------------
def file_inventory(spark: SparkSession, path, glob: str = "*", hash: bool = False) -> DataFrame:
    """path, length, modification time and, on request, SHA-256; contents are read only for the hash."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    cols: list[Column] = [F.col("path"), F.col("length"), F.col("modificationTime")]
    cols.append((F.sha2("content", 256) if hash else F.lit(None).cast("string")).alias("sha256"))
    return raw.select(*cols)
