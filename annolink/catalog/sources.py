"""SRC queries over texts and pages that the driver's tables hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files as SF
from ..sources import markup as SM
from .base import EV, LI, events, lines, query, t

_LINES = r"""d AS (SELECT doc_id, string_split(regexp_replace(text, '\r?\n$', ''), chr(10)) AS a FROM documents), l AS (SELECT doc_id, unnest(generate_series(1, len(a))) AS n, a FROM d), x AS (SELECT doc_id, n, regexp_replace(a[n], '\r$', '') AS line FROM l)"""


@query("src_01_label_lines", f"""WITH {_LINES} SELECT doc_id, CAST(n AS INTEGER) AS yolo_line, CAST(len(string_split_regex(trim(line, ' '), '[ \\t\\n\\x0B\\f\\r]+')) AS INTEGER) AS fields FROM x WHERE trim(line, ' ') <> ''""")
def src_01(spark, d):
    boxes, errors = SF.parse_labels(t(spark, d, "documents"), "doc_id", "text")
    return errors.select("doc_id", "yolo_line", "fields").unionByName(boxes.select("doc_id", "yolo_line", F.lit(5).alias("fields")))


@query("src_01_label_rows", f"""WITH {LI} SELECT l_suppkey, count(*) AS boxes, sum(l_linenumber) AS class_sum, CAST(sum(qty) AS BIGINT) AS x_sum, 2 AS last_line FROM li GROUP BY 1""")
def src_01b(spark, d):
    # every row as a label text of its own: a blank first line, then the box
    row = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("l_linenumber", "qty", "disc", "tax", "cents")])
    boxes, _ = SF.parse_labels(lines(spark, d).select("l_suppkey", F.concat(F.lit("\r\n"), row, F.lit("\n")).alias("text")), "l_suppkey", "text")
    return boxes.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("boxes"), F.sum("class_id").alias("class_sum"), F.sum("x").cast("bigint").alias("x_sum"), F.max("yolo_line").alias("last_line"))


def _csv_lines(spark, d, record, header):
    """Documents as delimited files, one per source, cut into physical lines: texts bring quotes and line breaks."""
    docs = t(spark, d, "documents")
    body = docs.select("source", "doc_id", F.posexplode(F.split(record, "\n")).alias("n", "line"))
    body = body.select("source", (F.floor(F.col("doc_id") / 200) + 1).alias("block"), (F.col("doc_id") * (1 << 24) + F.col("n")).alias("pos"), "line")
    head = docs.select("source").distinct().select("source", F.lit(0).cast("bigint").alias("block"), F.lit(-1).cast("bigint").alias("pos"), header.alias("line"))
    every = head.unionByName(body)
    return every.select(F.col("source").alias("file"), F.concat("source", F.lit(".csv")).alias("name"), "block", "pos", "line")


def _quoted(c):
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


@query("src_03_positional_rows", """SELECT source AS score_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS note_id, doc_id, md5(text) AS digest, length(text) AS chars, n_chars FROM documents""")
def src_03(spark, d):
    record = F.concat_ws(";", "doc_id", _quoted(F.col("text")), "n_chars")
    lines_ = _csv_lines(spark, d, record, F.lit('doc_id;"text";n_chars'))
    out = SF.positional_rows(lines_, "doc_id bigint, text string, n_chars bigint")
    return out.select("score_id", "note_id", "doc_id", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("chars"), "n_chars")


@query("src_05_heterogeneous_rows", """SELECT concat(source, '.csv') AS source_file, row_number() OVER (PARTITION BY source ORDER BY doc_id) + 1 AS source_row, CAST(doc_id AS VARCHAR) AS doc_id, CAST(n_chars AS VARCHAR) AS n_chars,
 CASE WHEN ascii(right(source, 1)) % 2 = 0 THEN md5(text) END AS body, CASE WHEN ascii(right(source, 1)) % 2 = 1 THEN md5(text) END AS remark FROM documents""")
def src_05(spark, d):
    even = F.ascii(F.right("source", F.lit(1))) % 2 == 0
    record = F.when(even, F.concat_ws(",", "doc_id", _quoted(F.col("text")), "n_chars")).otherwise(F.concat_ws(",", _quoted(F.col("text")), "n_chars", F.lit("extra"), "doc_id"))
    header = F.when(even, F.lit("doc_id,body,n_chars")).otherwise(F.lit('remark,n_chars,"a, b",doc_id'))
    out = SF.heterogeneous_rows(_csv_lines(spark, d, record, header))
    return out.select("source_file", "source_row", "doc_id", "n_chars", F.md5("body").alias("body"), F.md5("remark").alias("remark"))


@query("src_06_shred_pages")
def src_06(spark, d):
    n = SM.shred(t(spark, d, "pages"), "page_id", "html", "html")
    return n.select("doc_id", "node_id", "parent_id", "depth", "sibling_index", "xpath", "tag", "text", "tail")


@query("src_06_shred_xml")
def src_06b(spark, d):
    c = t(spark, d, "conversations")
    esc = lambda x: F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    clean = F.regexp_replace(esc(F.col("text")), r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}]", "")
    doc = c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat(F.lit("<turn role='"), "role", F.lit("'><!--t--><body>"), clean, F.lit("</body>end</turn>")).alias("xml"))
    return SM.shred(doc, "id", "xml").select("doc_id", "node_id", "parent_id", "tag", "text", "tail")


@query("src_08_repeat_map", f"""WITH {LI} SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS INTEGER) AS written_measure_index, CAST(qty AS INTEGER) AS unfolded_measure_index, CAST(CASE WHEN disc = 0 THEN 1 ELSE disc END AS INTEGER) AS repeat_occurrence
FROM li WHERE l_returnflag <> 'R' AND l_linenumber <> 5""")
def src_08(spark, d):
    s = lambda c: F.col(c).cast("string")
    m = lines(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", F.when(F.col("l_linenumber") != 5, s("l_linenumber")).otherwise("").alias("written_measure_index"), s("qty").alias("unfolded_measure_index"),
                               F.when(F.col("disc") > 0, s("disc")).otherwise("").alias("repeat_occurrence"), F.lit("2").alias("repeat_occurrence_count"), F.when(F.col("l_returnflag") == "R", "unresolved").otherwise("matched_fingerprint").alias("mapping_status"))
    return SF.read_repeat_map(m).select("l_orderkey", "l_partkey", "l_suppkey", "written_measure_index", "unfolded_measure_index", "repeat_occurrence")


@query("src_09_overrides", f"""WITH {EV} SELECT 'p' || CAST(user_id AS VARCHAR) AS page_id, CAST(cents % 5 AS INTEGER) AS scan_system, CAST(event_id AS INTEGER) AS xml_page, '1,2' AS xml_systems, event_type AS mapping_status FROM ev""")
def src_09(spark, d):
    js = F.concat(F.lit('{"overrides":{"p'), "user_id", F.lit('":{"'), F.col("cents") % 5, F.lit('":{"xml_page":'), "event_id", F.lit(',"xml_systems":[1,2],"mapping_status":"'), "event_type", F.lit('"}}}}'))
    o = SF.parse_overrides(events(spark, d).select(js.alias("j")), "j")
    return o.select("page_id", "scan_system", "xml_page", F.array_join("xml_systems", ",").alias("xml_systems"), "mapping_status")
