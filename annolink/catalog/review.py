"""REV and INC queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import review as V
from ..operators.scan import cell_of
from ..streaming import incremental as I
from .base import EV, LI, OD, events, lines, orders, query, t

_ST = """CASE o_orderstatus WHEN 'P' THEN 'ambiguous' WHEN 'O' THEN 'candidate' ELSE 'aligned' END"""


def _combined(spark, d):
    o = orders(spark, d)
    s = F.when(F.col("o_orderstatus") == "P", "ambiguous").when(F.col("o_orderstatus") == "O", "candidate").otherwise("aligned")
    return o.select(F.col("o_orderkey").alias("bbox_id"), F.lit("yolo").alias("row_origin"), s.alias("combined_status"), (F.col("cents") % 100 / 100.0).alias("confidence"), F.col("o_orderpriority").alias("class"),
                    (F.col("o_custkey") % 5).alias("score_id"), F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("yolo_line"))


@query("rev_01_review_queue", f"""WITH {OD}, {LI}, m AS (SELECT l_orderkey, string_agg(l_returnflag, '>' ORDER BY r, l_returnflag) AS methods FROM (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS r FROM li GROUP BY 1, 2) GROUP BY 1),
q AS (SELECT o_orderkey AS bbox_id, {_ST} AS st, cents % 100 / 100.0::DOUBLE AS c, o_orderpriority AS cl, o_custkey % 5 AS sc, o_custkey AS pg FROM od WHERE o_orderstatus <> 'F')
SELECT bbox_id, row_number() OVER (ORDER BY CASE st WHEN 'ambiguous' THEN 0 ELSE 1 END, c, cl, sc, pg, bbox_id) AS priority_rank, printf('Q%05d', row_number() OVER (ORDER BY CASE st WHEN 'ambiguous' THEN 0 ELSE 1 END, c, cl, sc, pg, bbox_id)) AS queue_id,
 coalesce(methods, '') AS link_methods, CASE WHEN bbox_id % 3 = 0 THEN 'ready' ELSE 'missing' END AS asset_status FROM q LEFT JOIN m ON l_orderkey = bbox_id""")
def rev_01(spark, d):
    links = lines(spark, d).select(F.col("l_orderkey").alias("bbox_id"), F.col("l_returnflag").alias("link_method"), F.col("l_linenumber").alias("link_rank"))
    a = orders(spark, d).where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("bbox_id"), F.lit("b").alias("batch_id"), F.lit("ready").alias("asset_status"))
    q = V.review_queue(_combined(spark, d), links, a)
    return q.select("bbox_id", "priority_rank", "queue_id", F.array_join("link_methods", ">").alias("link_methods"), "asset_status")


@query("rev_02_review_assets", """WITH f AS (SELECT s_suppkey AS n, s_nationkey % 5 > 0 AS png FROM supplier WHERE s_nationkey % 7 > 0),
c AS (SELECT bbox_id, l_suppkey AS n, png FROM (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS bbox_id, l_suppkey FROM lineitem) JOIN f ON n = l_suppkey)
SELECT bbox_id, max(n) AS sheet, CASE WHEN count(*) > 1 THEN 'duplicate' WHEN bool_and(png) THEN 'ready' ELSE 'missing' END AS asset_status FROM c GROUP BY bbox_id""")
def rev_02(spark, d):
    s = t(spark, d, "supplier")
    name = lambda ext: F.concat(F.col("s_suppkey").cast("string"), F.lit(ext))
    idx = s.select(F.col("s_suppkey").alias("sheet_no"), F.lit("p").alias("page_id"), F.lit("slur").alias("class"), F.lit(1).alias("part"), name(".png").alias("png"), name(".csv").alias("csv"))
    files = s.where("s_nationkey % 7 > 0").select(name(".csv").alias("path")).unionByName(s.where("s_nationkey % 5 > 0").select(name(".png").alias("path")))
    c = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("sheet_no"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("bbox_id")).distinct()
    return V.review_assets(idx, c, files).select("bbox_id", F.regexp_replace("review_csv", ".csv$", "").cast("bigint").alias("sheet"), "asset_status")


_PROP = f"""{LI}, q AS (SELECT ((l_orderkey * 100000000 + l_partkey * 10000 + l_suppkey) * 10 + l_linenumber) * 100 + qty AS bbox_id, l_suppkey AS score_id, l_returnflag AS class, qty / 50.0::DOUBLE AS confidence,
 l_linestatus = 'O' AND l_returnflag <> 'R' AND qty / 50.0::DOUBLE >= 0.8 AND disc <> 3 AND tax <> 2 AND l_linenumber <> 4 AS eligible, l_orderkey FROM li)"""


def _proposals(spark, d):
    li = lines(spark, d)
    bbox = ((F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")) * 100 + F.col("qty")
    k = F.col("l_orderkey").cast("string")
    q = li.select(bbox.alias("bbox_id"), F.col("l_suppkey").alias("score_id"), F.col("l_returnflag").alias("class"), (F.col("qty") / 50.0).alias("confidence"), F.when(F.col("l_linestatus") == "O", "candidate").otherwise("ambiguous").alias("source_status"),
                  F.when(F.col("disc") == 3, F.array(k, F.lit("other"))).otherwise(F.array(k, k, F.lit(""))).alias("xml_event_ids"), F.when(F.col("tax") == 2, "missing").otherwise("ready").alias("asset_status"))
    m = li.select(bbox.alias("bbox_id"), F.lit("direct").alias("page_mapping_status"), F.lit("in_bpsd_scope").alias("movement_scope_status"), F.when(F.col("l_linenumber") == 4, "page_failed").otherwise("").alias("error_code"))
    return V.split_auto_accept(q, m, 0.8, blocked=["R"])


@query("rev_03_auto_accept", f"WITH {_PROP} SELECT bbox_id, class, eligible, CASE WHEN eligible THEN CAST(l_orderkey AS VARCHAR) END AS event FROM q")
def rev_03(spark, d):
    p = _proposals(spark, d)
    return p.select("bbox_id", "class", "eligible", F.when(F.col("eligible"), F.col("evidence.unique_xml_event_id")).alias("event"))


@query("rev_04_audit_sample", f"""WITH {_PROP}, r AS (SELECT bbox_id, row_number() OVER (PARTITION BY score_id, class ORDER BY confidence, bbox_id) AS a, row_number() OVER (PARTITION BY score_id, class ORDER BY confidence DESC, bbox_id DESC) AS b FROM q WHERE eligible)
SELECT bbox_id, a = 1 OR b = 1 AS audit_sampled, CASE WHEN a = 1 THEN '1:lowest_confidence' WHEN b = 1 THEN '2:highest_confidence' END AS sample_position FROM r""")
def rev_04(spark, d):
    return V.audit_sample(_proposals(spark, d).where("eligible")).select("bbox_id", "audit_sampled", "sample_position")


@query("rev_05_apply_feedback", f"""WITH {OD}, a AS (SELECT o_orderkey AS sample_id, o_custkey AS bbox_id FROM od), f AS (SELECT *, CASE WHEN o_custkey % 10 = 3 THEN 'bbox_mismatch' WHEN cents % 10 = 0 THEN 'no_note_ids' END AS why FROM od WHERE o_orderstatus = 'P' AND day % 4 > 0)
SELECT a.sample_id, CASE WHEN f.o_orderkey IS NOT NULL AND why IS NULL THEN 'corrected' END AS decision, CASE WHEN f.o_orderkey IS NOT NULL AND why IS NULL THEN CAST(f.day AS VARCHAR) END AS corrected_start_meas, why AS rule FROM a LEFT JOIN f ON f.o_orderkey = a.sample_id""")
def rev_05(spark, d):
    o = orders(spark, d)
    audit = o.select(F.col("o_orderkey").cast("string").alias("sample_id"), F.col("o_custkey").cast("string").alias("bbox_id"))
    none = F.array().cast("array<int>")
    f = o.where("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("entry_no"), F.col("o_orderkey").cast("string").alias("sample_id"), F.when(F.col("o_custkey") % 10 == 3, "x").otherwise(F.col("o_custkey").cast("string")).alias("bbox_id"), F.lit("resolved_by_user").alias("resolution_status"),
        (F.col("day") % 4 > 0).alias("apply_to_audit"), F.when(F.col("cents") % 10 == 0, none).otherwise(F.array(F.lit(1))).alias("corrected_note_ids"), F.array(F.lit("e")).alias("corrected_xml_event_ids"), F.col("day").cast("string").alias("corrected_start_meas"),
        F.lit("C4").alias("canonical_pitch"), F.lit("seen").alias("evidence"), F.lit(None).cast("string").alias("measure_numbering_domain"), F.struct(F.lit("C4").alias("pitch"), F.lit("1").alias("staff"), F.lit("3").alias("measure")).alias("user_correction"),
        F.lit("r").alias("reviewer"), F.lit("2024-01-01").alias("recorded_date"), F.lit("s").alias("source"))
    rev, _, err = V.apply_feedback(audit, f)
    return rev.join(err.select(F.col("detail").alias("sample_id"), "rule"), "sample_id", "left").select(F.col("sample_id").cast("bigint").alias("sample_id"), "decision", "corrected_start_meas", "rule")


def _rows(spark, d):
    o = orders(spark, d)
    s = lambda c: F.col(c).cast("string")
    return o.select(s("o_custkey").alias("page_id"), s("o_orderkey").alias("yolo_line"), F.lit(7).alias("class_id"), F.lit("slur").alias("class"), s("day").alias("start_meas"), s("day").alias("end_meas"), s("o_orderkey").alias("start_note"),
                    s("o_orderkey").alias("end_note"), F.concat(F.lit("["), "o_orderkey", F.lit("]")).alias("connected_note"), F.lit("NA").alias("stem_dir"), F.lit("1").alias("xml_staff"),
                    F.when(F.col("o_orderstatus") == "F", "matched").when(F.col("o_orderstatus") == "O", "review").otherwise("unmatched").alias("status"), F.lit("auto").alias("match_source"), (F.col("cents") % 100 / 100.0).alias("confidence"), "cents", "day", "o_orderkey")


def _decisions(spark, d):
    names = F.array(*map(F.lit, S.REVIEW_ACTIONS))
    r = _rows(spark, d)
    act = F.element_at(names, (F.col("cents") % 10 + 1).cast("int"))
    return r.select("page_id", "yolo_line", act.alias("action"), F.col("start_meas"), (F.col("day") + F.col("cents") % 3 - 1).cast("string").alias("end_meas"), "start_note", "end_note", "connected_note", F.lit("").alias("stem_dir"),
                    F.when(F.col("cents") % 7 == 0, "3").otherwise("1").alias("staff"), F.when(F.col("cents") % 20 == 4, "9").otherwise("7").alias("corrected_class_id"), F.when(F.col("cents") % 20 == 4, "tie").otherwise("slur").alias("corrected_class"), F.lit("ok").alias("comment"))


_DEC = f"""{OD}, r AS (SELECT CAST(o_custkey AS VARCHAR) AS page_id, CAST(o_orderkey AS VARCHAR) AS yolo_line, day, cents, o_orderstatus AS st, o_orderkey,
 ['pending','confirm','correct','scan_only','wrong_class','bad_bbox','not_a_symbol','uncertain','skipped','reject'][cents % 10 + 1] AS act, day + cents % 3 - 1 AS e2, CASE WHEN cents % 7 = 0 THEN '3' ELSE '1' END AS staff FROM od)"""


@query("rev_06_validate_decisions", f"""WITH {_DEC}, v AS (SELECT *, concat(page_id, ':Y', yolo_line) AS detail FROM r WHERE act <> 'pending')
SELECT 'start_after_end' AS rule, detail FROM v WHERE day > e2 UNION ALL SELECT 'bad_staff', detail FROM v WHERE staff = '3' UNION ALL SELECT 'nothing_changed', detail FROM v WHERE act = 'correct' AND e2 = day AND staff = '1'
UNION ALL SELECT 'class_missing', detail FROM v WHERE act = 'wrong_class' AND cents % 20 <> 4 UNION ALL SELECT 'unknown_note', concat(detail, '->', o_orderkey) FROM v WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'class_id_mismatch', detail FROM v WHERE act = 'wrong_class' AND cents % 20 = 4""")
def rev_06(spark, d):
    ids = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("note_id")).distinct()
    cls = t(spark, d, "region").select((F.col("r_regionkey") + 7).alias("id"), F.when(F.col("r_regionkey") == 0, "slur").otherwise("other").alias("name"))
    return V.validate_decisions(_rows(spark, d), _decisions(spark, d), ids, cls)


_APPLIED = """CASE WHEN act IN ('reject','scan_only','wrong_class') THEN '' WHEN act = 'correct' THEN CAST(e2 AS VARCHAR) ELSE CAST(day AS VARCHAR) END"""


@query("rev_07_apply_decisions", f"""WITH {_DEC} SELECT page_id, yolo_line, CASE act WHEN 'wrong_class' THEN CASE WHEN cents % 20 = 4 THEN 'tie' ELSE 'slur' END ELSE 'slur' END AS class, {_APPLIED} AS end_meas,
 CASE WHEN act IN ('reject','scan_only','wrong_class') THEN 'unresolved' WHEN act IN ('correct','confirm') THEN 'matched' WHEN st = 'F' THEN 'matched' WHEN st = 'O' THEN 'ambiguous' ELSE 'unresolved' END AS alignment_status,
 CASE act WHEN 'confirm' THEN 'confirmed' WHEN 'correct' THEN 'corrected' WHEN 'uncertain' THEN 'deferred' WHEN 'skipped' THEN 'deferred' WHEN 'pending' THEN NULL ELSE act END AS review_status,
 CASE WHEN act IN ('correct','wrong_class') THEN 'true' ELSE 'false' END AS human_approved FROM r WHERE act NOT IN ('bad_bbox','not_a_symbol')""")
def rev_07(spark, d):
    return V.apply_decisions(_rows(spark, d), _decisions(spark, d))[0].select("page_id", "yolo_line", "class", "end_meas", "alignment_status", "review_status", "human_approved")


@query("rev_08_apply_to_master", f"""WITH {_DEC} SELECT page_id, yolo_line, {_APPLIED} AS end_meas, CASE WHEN act IN ('correct','wrong_class') THEN 'true' WHEN act <> 'pending' THEN 'false' ELSE 'old' END AS human_approved,
 CASE WHEN act <> 'pending' THEN concat('{{"class":"slur","class_id":"7","connected_note":"[', yolo_line, ']","end_meas":"', day, '","end_note":"', yolo_line, '","staff":"1","start_meas":"', day, '","start_note":"', yolo_line, '","stem_dir":"NA"}}') END AS original_candidate_json
FROM r WHERE act NOT IN ('bad_bbox','not_a_symbol')""")
def rev_08(spark, d):
    rows = _rows(spark, d)
    _, log = V.apply_decisions(rows, _decisions(spark, d))
    master = rows.withColumns({"staff": F.col("xml_staff"), "alignment_status": F.lit("candidate"), "review_status": F.lit("needs_review"), "human_approved": F.lit("old")})
    return V.apply_to_master(master, log, "User", "2024-01-01").select("page_id", "yolo_line", "end_meas", "human_approved", "original_candidate_json")


@query("rev_09_normalize_truth", """WITH s AS (SELECT doc_id, lang, source, n_chars, row_number() OVER (PARTITION BY n_chars ORDER BY source, doc_id) AS rn FROM documents)
SELECT source AS source_file, 'p' || CAST(n_chars AS VARCHAR) AS page_id, '1' AS yolo_line, CASE WHEN lang = 'en' THEN '' ELSE CAST(doc_id AS VARCHAR) END AS expected_start_meas,
 CASE WHEN lang = 'fr' THEN '5' ELSE CAST(doc_id AS VARCHAR) END AS expected_start_note, CASE WHEN lang = 'fr' THEN '6' ELSE CAST(doc_id AS VARCHAR) END AS expected_end_note,
 CASE WHEN lang = 'fr' THEN '["5","6"]' ELSE '["' || CAST(doc_id AS VARCHAR) || '"]' END AS expected_connected_note FROM s WHERE rn = 1""")
def rev_09(spark, d):
    doc = t(spark, d, "documents").select(
        F.col("source").alias("source_file"), F.col("doc_id").alias("source_row"), F.concat(F.lit(" p"), F.col("n_chars").cast("string")).alias("page_id"), F.lit("1").alias("yolo_line"),
        F.when(F.col("lang") == "fr", "5+6").otherwise("NA").alias("note_ids"), F.when(F.col("lang") != "fr", F.col("doc_id").cast("string")).alias("note_id"),
        F.when(F.col("lang") == "en", "NA").otherwise(F.col("doc_id").cast("string")).alias("start_bps_time"))
    out, _ = V.normalize_truth(doc)
    return out.select("source_file", "page_id", "yolo_line", "expected_start_meas", "expected_start_note", "expected_end_note", "expected_connected_note")


@query("rev_10_import_reviews", f"""WITH {_DEC}, v AS (SELECT *, cents % 10 < 4 AS hit, cents % 5 = 0 AS clash FROM r)
SELECT page_id, yolo_line, CASE WHEN hit AND NOT clash AND cents % 2 = 1 THEN '9.5' ELSE CAST(day AS VARCHAR) END AS start_meas, CASE WHEN hit AND NOT clash AND cents % 2 = 1 THEN '[3,4]' ELSE concat('[', yolo_line, ']') END AS connected_note,
 CASE WHEN hit AND NOT clash AND cents % 2 = 1 THEN 'true' ELSE 'false' END AS human_approved, CASE WHEN hit AND NOT clash THEN 'note' END AS comment, hit AND clash AS rejected FROM v""")
def rev_10(spark, d):
    rows = _rows(spark, d).withColumns({"comment": F.lit(None).cast("string"), "alignment_status": F.lit("candidate"), "review_status": F.lit(""), "human_approved": F.lit("false"), "confidence": F.col("confidence").cast("string")})
    rv = rows.where("cents % 10 < 4").select("page_id", "yolo_line", F.when(F.col("cents") % 5 == 0, "tie").otherwise("slur").alias("class"), F.when(F.col("cents") % 2 == 1, "corrected").otherwise("open").alias("review_status"), F.lit("note").alias("comment"),
                                             F.lit("9.5").alias("start_meas"), F.lit(None).cast("string").alias("end_meas"), F.array(F.lit(3), F.lit(4)).alias("note_ids"))
    out, err = V.import_reviews(rows, rv)
    e = err.select(F.col("detail"), F.lit(True).alias("rejected"))
    out = out.withColumn("detail", F.concat("page_id", F.lit(":Y"), "yolo_line")).join(e, "detail", "left")
    return out.select("page_id", "yolo_line", "start_meas", "connected_note", "human_approved", "comment", F.coalesce("rejected", F.lit(False)).alias("rejected"))


@query("rev_11_preserve_reviews", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE 'pending' END AS review_status, CASE WHEN o_orderstatus = 'P' AND o_custkey % 2 = 0 THEN 'kept' ELSE '' END AS comment FROM orders""")
def rev_11(spark, d):
    o = t(spark, d, "orders")
    old = o.where("o_orderstatus = 'P'").select("o_orderkey", F.col("o_orderpriority").alias("review_status"), F.when(F.col("o_custkey") % 2 == 0, "kept").otherwise("NA").alias("comment"))
    return V.preserve_reviews(o.select("o_orderkey"), old, ["o_orderkey"], {"review_status": "pending", "comment": ""})


@query("rev_12_restore_decisions", f"""WITH {_DEC} SELECT 'wrong_version' AS rule, '' AS detail UNION ALL SELECT 'unknown_row', concat(page_id, ':Y', yolo_line) FROM r WHERE st = 'P'""")
def rev_12(spark, d):
    saved = _decisions(spark, d).withColumns({"schema_version": F.lit("2.0"), "fingerprint": F.lit("f1"), "score_id": F.lit("s"), "version": F.lit("1"), "reviewer": F.lit("u")})
    return V.restore_decisions(saved, _rows(spark, d).where("status <> 'unmatched'"), "f1", "s", "2")[1]


@query("rev_13_audit_batch", """WITH m AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND n_chars % 11 > 0),
a AS (SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS k, lang, source FROM m WHERE n_chars % 2 = 0), b AS (SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS k, lang, source FROM m WHERE n_chars % 2 = 1)
SELECT doc_id AS bbox_id, 'unresolved' AS selection_reason FROM (SELECT * FROM a ORDER BY k, lang, source LIMIT 60) UNION ALL SELECT doc_id, 'high_risk_link' FROM (SELECT * FROM b ORDER BY k, lang, source LIMIT 40)""")
def rev_13(spark, d):
    m = t(spark, d, "documents").select(F.col("doc_id").alias("bbox_id"), F.col("lang").alias("page_id"), F.concat(F.lit("fingering"), "source").alias("class"), F.lit("in_bpsd_scope").alias("movement_scope_status"), F.when(F.col("n_chars") % 11 == 0, "bad").otherwise("").alias("error_code"),
                                        F.when(F.col("n_chars") % 2 == 0, "unresolved").otherwise("candidate").alias("alignment_status"), F.col("n_chars").alias("confidence"))
    return V.audit_batch(m, t(spark, d, "labels").select(F.col("doc_id").alias("bbox_id")), 60, 40).select("bbox_id", "selection_reason")


@query("rev_14_scan_only", f"""WITH {LI}, n AS (SELECT l_orderkey, l_linenumber, count(*) AS c, bool_or(l_returnflag = 'R') AS mk FROM li GROUP BY 1, 2)
SELECT CAST(o_orderkey AS VARCHAR) AS yolo_line, CASE WHEN coalesce(a.c, 0) <> 1 OR coalesce(b.c, 0) <> 1 THEN 'endpoint_not_found' WHEN a.mk OR b.mk THEN 'endpoint_has_mark' ELSE 'accepted' END AS outcome
FROM orders LEFT JOIN n a ON a.l_orderkey = o_orderkey AND a.l_linenumber = 1 LEFT JOIN n b ON b.l_orderkey = o_orderkey AND b.l_linenumber = 2""")
def rev_14(spark, d):
    n = lines(spark, d).select(F.col("l_orderkey").alias("note_id"), F.col("l_linenumber").alias("tick"), F.lit("C4").alias("pitch"), (F.col("l_returnflag") == "R").alias("has_mark"))
    r = orders(spark, d).select(F.lit("p").alias("page_id"), F.col("o_orderkey").cast("string").alias("yolo_line"), F.col("o_orderkey").alias("start_id"), F.lit(1).alias("start_tick"), F.lit("C4").alias("start_pitch"), F.col("o_orderkey").alias("end_id"), F.lit(2).alias("end_tick"), F.lit("C4").alias("end_pitch"))
    ok, err = V.scan_only(r, n)
    return ok.select("yolo_line", F.lit("accepted").alias("outcome")).unionByName(err.select(F.substring_index("detail", ":Y", -1).alias("yolo_line"), F.col("rule").alias("outcome")))


@query("rev_15_endpoint_rows", f"""WITH {LI}, n AS (SELECT l_orderkey, l_linenumber, count(*) AS c, min(l_returnflag) AS f FROM li GROUP BY 1, 2)
SELECT o_orderkey AS yolo_line, coalesce(a.c, 0) AS start_matches, coalesce(b.c, 0) AS end_matches, CASE WHEN a.c = 1 THEN a.f END AS start_staff FROM orders LEFT JOIN n a ON a.l_orderkey = o_orderkey AND a.l_linenumber = 1 LEFT JOIN n b ON b.l_orderkey = o_orderkey AND b.l_linenumber = 2 WHERE o_orderstatus = 'F'""")
def rev_15(spark, d):
    n = lines(spark, d).select(F.col("l_orderkey").alias("note_id"), F.col("l_linenumber").alias("tick"), F.lit("C4").alias("pitch"), F.col("l_returnflag").alias("staff"))
    s = orders(spark, d).select(F.lit("p").alias("page_id"), F.col("o_orderkey").alias("yolo_line"), F.when(F.col("o_orderstatus") == "F", "high_confidence_candidate").otherwise("needs_review").alias("status"), F.col("o_orderkey").alias("start_note"), F.lit(1).alias("start_tick"),
                                F.lit("C4").alias("start_pitch"), F.col("o_orderkey").alias("end_note"), F.lit(2).alias("end_tick"), F.lit("C4").alias("end_pitch"))
    return V.endpoint_rows(s, n).select("yolo_line", "start_matches", "end_matches", "start_staff")


@query("rev_16_check_rows", f"""WITH {LI} SELECT o_orderkey AS yolo_line, count(l_orderkey) AS chord_size, string_agg(CAST(l_partkey AS VARCHAR), '+' ORDER BY l_linenumber, l_partkey * 100000 + l_suppkey, day) AS note_ids FROM orders LEFT JOIN li ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def rev_16(spark, d):
    m = lines(spark, d).select(F.col("l_orderkey").alias("chord"), F.col("l_partkey").alias("note_id"), F.lit("C4").alias("pitch"), F.col("l_linenumber").alias("midi"), ((F.col("l_partkey") * 100000 + F.col("l_suppkey")) * 100000 + F.col("day")).alias("seq"), F.lit(1.0).alias("beat"))
    p = orders(spark, d).select(F.col("o_orderkey").alias("yolo_line"), F.col("o_orderkey").alias("chord"))
    return V.check_rows(p, m, ["yolo_line"], "chord").select("yolo_line", F.col("chord_size").cast("bigint").alias("chord_size"), "note_ids")


@query("rev_17_review_progress", f"""WITH {_DEC}, q AS (SELECT * FROM r WHERE st <> 'F') SELECT count(*) AS total, count(*) FILTER (act NOT IN ('pending','skipped')) AS reviewed, round(CAST(count(*) FILTER (act NOT IN ('pending','skipped')) AS DOUBLE) / greatest(count(*), 1), 6) AS share FROM q""")
def rev_17(spark, d):
    return V.review_progress(_rows(spark, d), _decisions(spark, d))[0]


@query("rev_18_decision_from_choice", f"""WITH {_DEC} SELECT yolo_line, CASE WHEN cents % 2 = 0 THEN 'confirm' ELSE 'correct' END AS action, CASE WHEN cents % 2 = 0 THEN CAST(day AS VARCHAR) ELSE CAST(c_nationkey AS VARCHAR) END AS start_meas,
 CASE WHEN cents % 2 = 0 THEN concat('[', yolo_line, ']') WHEN cents % 4 = 1 OR page_id = CAST(cents % 100 AS VARCHAR) THEN concat('[', page_id, ']') ELSE concat('[', page_id, ', ', cents % 100, ']') END AS connected_note FROM r JOIN customer ON CAST(c_custkey AS VARCHAR) = page_id""")
def rev_18(spark, d):
    r = _rows(spark, d)
    c = r.select("page_id", "yolo_line", F.when(F.col("cents") % 2 == 0, "confirm").otherwise("correct").alias("action"), F.col("page_id").cast("bigint").alias("start_choice"), F.when(F.col("cents") % 4 != 1, F.col("cents") % 100).alias("end_choice"))
    n = t(spark, d, "customer").select(F.col("c_custkey").alias("note_id"), F.col("c_nationkey").alias("time"), F.lit(1).alias("staff"))
    return V.decision_from_choice(r, c, n).select("yolo_line", "action", "start_meas", "connected_note")


@query("inc_01_unit_digest", """WITH c AS (SELECT o_custkey, md5(concat(o_orderkey)) AS h FROM orders) SELECT o_custkey AS unit_id, count(*) AS expected_rows, 64 AS digest_length FROM c GROUP BY 1""")
def inc_01(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("unit_id"), "o_orderkey", "o_orderstatus")
    n = o.withColumn("x", F.length(I.digest(["o_orderkey", "o_orderstatus"], "1"))).groupBy("unit_id").agg(F.max("x").alias("digest_length"))
    return I.unit_digest(o, ["unit_id"], ["o_orderkey", "o_orderstatus"], "1").join(n, "unit_id").select("unit_id", "expected_rows", "digest_length")


_MONTH = f"""{OD}, m AS (SELECT day // 30 AS unit_id, count(*) AS n, count(*) FILTER (o_orderstatus <> 'P') AS have FROM od GROUP BY 1)"""


@query("inc_02_pending", f"""WITH {_MONTH} SELECT unit_id, n AS expected_rows, CASE WHEN unit_id % 7 = 0 THEN 'new' WHEN unit_id % 7 = 1 THEN 'failed' WHEN unit_id % 7 = 2 THEN 'stale' WHEN n <> have THEN 'row_count' END AS reason FROM m
WHERE unit_id % 7 < 3 OR n <> have""")
def inc_02(spark, d):
    o = orders(spark, d).withColumn("unit_id", F.floor(F.col("day") / 30))
    m = I.unit_digest(o, ["unit_id"], ["o_orderkey", "cents"], "1")
    k = F.col("unit_id") % 7
    led = m.where("unit_id % 7 > 0").select("unit_id", F.when(k == 2, "old").otherwise(F.col("digest")).alias("digest"), F.lit("1").alias("version"), F.when(k == 1, "failed").otherwise("completed").alias("status"), F.col("expected_rows").alias("row_count"))
    have = o.where("o_orderstatus <> 'P'").groupBy("unit_id").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("o_orderkey").alias("distinct_rows"))
    return I.pending(m, led, have, "1").select("unit_id", "expected_rows", "reason")


@query("inc_03_adopt", f"""WITH {_MONTH} SELECT unit_id, n AS row_count, 'completed' AS status FROM m WHERE n = have OR unit_id % 3 > 0""")
def inc_03(spark, d):
    o = orders(spark, d).withColumn("unit_id", F.floor(F.col("day") / 30))
    return I.adopt(I.unit_digest(o, ["unit_id"], ["o_orderkey"]), o.where("o_orderstatus <> 'P' or unit_id % 3 > 0"), ["o_orderkey"], "1")[0].select("unit_id", "row_count", "status")


@query("inc_04_reusable", f"""WITH {_MONTH} SELECT unit_id, n = have AND unit_id % 2 = 0 AS reusable FROM m""")
def inc_04(spark, d):
    o = orders(spark, d).withColumn("unit_id", F.floor(F.col("day") / 30))
    times = o.select("unit_id").distinct()
    return I.reusable(o.where("o_orderstatus <> 'P'"), o, ["unit_id"], ["o_orderkey", "cents"], times.withColumn("mtime", F.lit(5)), times.withColumn("mtime", F.when(F.col("unit_id") % 2 == 0, 6).otherwise(4)))


@query("inc_06_canonical_rows", """SELECT concat(o_custkey, ':Y', o_orderkey) AS bbox_id, CASE o_orderstatus WHEN 'F' THEN 'matched' WHEN 'O' THEN 'ambiguous' ELSE 'unresolved' END AS alignment_status, c_mktsegment AS score_id, 'v1' AS pipeline_version, c_mktsegment IS NOT NULL AS page_known
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey > 2) ON c_custkey = o_custkey""")
def inc_06(spark, d):
    s = F.when(F.col("o_orderstatus") == "F", "matched").when(F.col("o_orderstatus") == "O", "review").otherwise("none")
    det = t(spark, d, "orders").select(F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("yolo_line"), s.alias("status"))
    pages = t(spark, d, "customer").where("c_nationkey > 2").select(F.col("c_custkey").alias("page_id"), F.col("c_mktsegment").alias("score_id"))
    return I.canonical_rows(det, pages, "v1", "set").select("bbox_id", "alignment_status", "score_id", "pipeline_version", "page_known")
