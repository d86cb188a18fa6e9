"""The human part: queues, auto-accept, samples, decisions, corrections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.classes import BLOCKED_CLASSES, STATUS_REVIEW, recode_status
from ..functions.text import blank_na, first_nonblank, id_list, json_list, norm_text, try_float, try_int
from .joins import lookup_one
from .ordering import READER_ORDER, priority_rank, reader_queue
from .quality import _rows, expect_unique
from .scan import number_rows
from .windows import round_robin, sample_extremes

KEY = ["page_id", "yolo_line"]
#: Target columns and the decision columns that correct them, the first stated one counts (fixed values).
TARGETS = {
    "target_x_px": ["review_start_target_x_px", "review_target_x_px"], "target_y_px": ["review_start_target_y_px", "review_target_y_px"],
    "end_target_x_px": ["review_end_target_x_px"], "end_target_y_px": ["review_end_target_y_px"],
}


def _id(df_keys=KEY) -> Column:
    return F.concat(F.col(df_keys[0]).cast("string"), F.lit(":Y"), F.col(df_keys[1]).cast("string"))


# REV-01 -----------------------------------------------------------------
def review_queue(combined: DataFrame, links: DataFrame, assets: DataFrame, bbox: str = "bbox_id", fine: Column | None = None) -> DataFrame:
    """Candidate and ambiguous boxes in risk-first order with their asset and link methods.

    combined: bbox, row_origin, combined_status, confidence, class, score_id, page_id,
    yolo_line. links: bbox, link_method, link_rank. assets: bbox, batch_id, asset_status.
    Methods come in first-seen order; there are only a handful of different ones.
    """
    q = combined.where((F.col("row_origin") == "yolo") & F.col("combined_status").isin("candidate", "ambiguous"))
    m = links.groupBy(bbox, "link_method").agg(F.min("link_rank").alias("r"))
    m = m.groupBy(bbox).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "link_method"))), lambda x: x["link_method"]).alias("link_methods"))
    q = q.join(m, bbox, "left").join(assets.select(bbox, "batch_id", "asset_status"), bbox, "left")
    q = q.withColumns({"asset_status": F.coalesce("asset_status", F.lit("missing")), "link_methods": F.coalesce("link_methods", F.array().cast("array<string>")),
                       "priority_tier": F.when(F.col("combined_status") == "ambiguous", "P1_ambiguous").otherwise("P2_candidate"), "__line": F.coalesce(try_int("yolo_line"), F.lit(0))})
    q = priority_rank(q, ["class", "score_id", "page_id", "__line", bbox], "priority_rank", fine=fine)
    return q.withColumn("queue_id", F.format_string("Q%05d", "priority_rank")).drop("__line")


# REV-02 -----------------------------------------------------------------
def review_assets(index: DataFrame, candidates: DataFrame, files: DataFrame, bbox: str = "bbox_id") -> DataFrame:
    """Asset state per box: ready, missing, or duplicate when several sheets list it (the last sheet stays).

    index: sheet_no, page_id, class, part, png, csv. candidates: sheet_no, box. files: path.
    """
    f = files.select("path").distinct()
    i = index.join(f.select(F.col("path").alias("png"), F.lit(True).alias("__p")), "png", "left").join(f.select(F.col("path").alias("csv"), F.lit(True).alias("__c")), "csv", "left")
    i = i.withColumn("__ready", F.col("__p").isNotNull() & F.col("__c").isNotNull())
    i = i.withColumn("batch_id", F.concat_ws(":", "page_id", "class", F.format_string("part%02d", "part"))).where("__c")
    c = candidates.join(i, "sheet_no").groupBy(bbox).agg(
        F.count(F.lit(1)).alias("__n"), F.max(F.struct("sheet_no", "batch_id", "png", "csv", "__ready")).alias("s"))
    status = F.when(F.col("__n") > 1, "duplicate").when(F.col("s.__ready"), "ready").otherwise("missing")
    return c.select(bbox, "s.batch_id", F.col("s.png").alias("review_png"), F.col("s.csv").alias("review_csv"), status.alias("asset_status"))


# REV-03 -----------------------------------------------------------------
def split_auto_accept(queue: DataFrame, master: DataFrame, threshold: float, bbox: str = "bbox_id", blocked: Sequence[str] = BLOCKED_CLASSES) -> DataFrame:
    """Queue rows with eligible (all eight conditions) and the evidence for it.

    queue: bbox, source_status, class, confidence, xml_event_ids array, asset_status.
    master: bbox, page_mapping_status, movement_scope_status, error_code.
    """
    q = queue.join(master.select(bbox, "page_mapping_status", "movement_scope_status", "error_code"), bbox, "left")
    ids = F.array_distinct(F.filter("xml_event_ids", lambda x: x.isNotNull() & (x != "")))
    conf = try_float("confidence")
    ok = (
        (F.col("source_status") == "candidate") & ~F.col("class").isin(list(blocked)) & (conf >= threshold) & (F.size(ids) == 1) & (F.col("asset_status") == "ready")
        & (F.col("page_mapping_status") == "direct") & (F.col("movement_scope_status") == "in_bpsd_scope") & norm_text("error_code").isNull())
    evidence = F.struct(conf.alias("confidence"), F.get(ids, F.lit(0)).alias("unique_xml_event_id"), "page_mapping_status", "movement_scope_status", "error_code", "asset_status")
    return q.withColumns({"eligible": F.coalesce(ok, F.lit(False)), "unique_xml_event_id": F.when(F.size(ids) == 1, F.get(ids, F.lit(0))), "evidence": evidence}).withColumn(
        "proposal_status", F.when(F.col("eligible"), "proposed_pending_audit"))


# REV-04 -----------------------------------------------------------------
def audit_sample(proposals: DataFrame, strata=("score_id", "class"), confidence="confidence", bbox="bbox_id") -> DataFrame:
    """Proposals with audit_sampled and the sample position; lowest and highest of each stratum are taken."""
    s = sample_extremes(proposals, list(strata), confidence, bbox).select(bbox, F.concat_ws(":", "position", F.concat("reason", F.lit("_confidence"))).alias("sample_position"))
    return proposals.join(s, bbox, "left").withColumn("audit_sampled", F.col("sample_position").isNotNull())


# REV-05 -----------------------------------------------------------------
def apply_feedback(audit: DataFrame, feedback: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reviewed audit rows, correction log, errors) from resolved feedback entries.

    audit: sample_id, bbox_id, score_id, page_id, class, start_meas, note_ids ... feedback:
    one row per entry (see sources.read_feedback). Withdrawn and open entries are ignored.
    """
    live = feedback.where(~F.col("apply_to_audit").eqNullSafe(F.lit(False)) & F.coalesce("resolution_status", F.lit("")).startswith("resolved"))
    named = live.where(norm_text("sample_id").isNotNull())
    err = _rows(live.where(norm_text("sample_id").isNull()), "missing_sample_id", F.coalesce("bbox_id", F.lit("")))
    first = number_rows(named, ["sample_id"], ["entry_no"], "__rn")
    err = err.unionByName(_rows(first.where("__rn > 1"), "duplicate_feedback", F.col("sample_id")))
    one = first.where("__rn = 1").drop("__rn")
    err = err.unionByName(_rows(one.join(audit.select("sample_id"), "sample_id", "left_anti"), "unknown_sample", F.col("sample_id")))
    f = one.select("sample_id", F.col("bbox_id").alias("__bbox"), "corrected_note_ids", "corrected_xml_event_ids", F.col("corrected_start_meas").alias("__start"),
                   F.coalesce(norm_text("canonical_pitch"), F.col("user_correction.pitch")).alias("corrected_pitch"), F.col("user_correction.staff").alias("corrected_staff"),
                   F.col("user_correction.measure").alias("__measure"), F.coalesce("measure_numbering_domain", F.lit("bps_start_meas")).alias("__domain"), "evidence", "reviewer", "recorded_date", "source")
    j = audit.join(f, "sample_id", "left")
    why = (F.when(F.col("__bbox").isNull(), F.lit(None)).when(F.col("__bbox") != F.col("bbox_id"), "bbox_mismatch")
           .when(F.coalesce(F.size("corrected_note_ids"), F.lit(0)) < 1, "no_note_ids").when(F.coalesce(F.size("corrected_xml_event_ids"), F.lit(0)) < 1, "no_event_ids"))
    j = j.withColumns({"__why": why})
    err = err.unionByName(j.where("__why is not null").select(F.col("__why").alias("rule"), F.col("sample_id").alias("detail")))
    use = F.col("__bbox").isNotNull() & F.col("__why").isNull()
    has = lambda c: F.col(c) if c in audit.columns else F.lit(None).cast("string")
    set_ = lambda c, v: F.when(use, v).otherwise(has(c))
    reviewed = j.withColumns({
        "proposal_status": set_("proposal_status", F.lit("audit_rejected_original_corrected")), "proposed_combined_status": set_("proposed_combined_status", F.lit("human_corrected")),
        "audit_decision": set_("audit_decision", F.lit("incorrect_original_match_corrected")), "decision": set_("decision", F.lit("corrected")), "human_approved": set_("human_approved", F.lit("true")),
        "corrected_start_meas": set_("corrected_start_meas", F.col("__start")), "audited_by": set_("audited_by", F.coalesce("reviewer", F.lit("User"))),
        "audited_at": set_("audited_at", F.col("recorded_date")), "comment": set_("comment", F.col("evidence"))})
    ref = F.to_json(F.struct(F.col("__domain").alias("domain"), F.col("__measure").alias("measure")))
    log = reviewed.where(use).select(
        "sample_id", "bbox_id", has("score_id").alias("score_id"), has("page_id").alias("page_id"), has("class").alias("class"), has("start_meas").alias("original_start_meas"),
        has("note_ids").alias("original_note_ids"), "corrected_start_meas", F.to_json("corrected_note_ids").alias("corrected_note_ids"), F.to_json("corrected_xml_event_ids").alias("corrected_xml_event_ids"),
        "corrected_pitch", "corrected_staff", ref.alias("corrected_measure_reference"), "audit_decision", F.col("audited_by").alias("reviewer"), F.col("evidence").alias("feedback_evidence"))
    keep = list(dict.fromkeys([*audit.columns, "proposal_status", "proposed_combined_status", "audit_decision", "decision", "human_approved", "corrected_start_meas", "audited_by", "audited_at", "comment"]))
    return reviewed.select(*keep), log, err


# REV-06 -----------------------------------------------------------------
def validate_decisions(rows: DataFrame, decisions: DataFrame, ids: DataFrame | None = None, classes: DataFrame | None = None) -> DataFrame:
    """Error rows of a decision batch; any row here blocks the whole batch (see gate).

    rows: page_id, yolo_line, class, class_id, semantic columns, xml_staff. decisions: page_id,
    yolo_line, action, semantic columns, staff, corrected_class_id, corrected_class. ids:
    note_id. classes: id, name.
    """
    act = F.coalesce(norm_text("action"), F.lit("pending"))
    d = decisions.withColumn("action", act)
    err = _rows(d.where(~F.col("action").isin(S.REVIEW_ACTIONS)), "invalid_action", F.concat_ws(" ", _id(), "action"))
    d = d.where(F.col("action").isin(S.REVIEW_ACTIONS) & (F.col("action") != "pending"))
    err = err.unionByName(_rows(d.join(rows.select(*KEY), KEY, "left_anti"), "unknown_row", _id()))
    dup = d.groupBy(*KEY).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    err = err.unionByName(_rows(dup, "duplicate_decision", _id()))
    a, b = norm_text("start_meas"), norm_text("end_meas")
    fa, fb = try_float("start_meas"), try_float("end_meas")
    text = lambda c: F.coalesce(norm_text(c), F.lit(""))
    conn = id_list("connected_note")
    num = lambda c: norm_text(c).isNotNull() & ~norm_text(c).rlike("^[0-9]+$")
    outside = lambda c: norm_text(c).isNotNull() & (F.size(conn) > 0) & ~F.array_contains(conn, norm_text(c))
    src = rows.select(*KEY, *[F.col(c).alias(f"__s_{c}") for c in S.SEMANTIC], F.col("xml_staff").alias("__s_staff"), F.col("class").alias("__s_class"), F.col("class_id").cast("string").alias("__s_class_id"))
    j = d.join(src, KEY)
    same = text("staff") == text("__s_staff")
    for c in S.SEMANTIC:
        same = same & (text(c) == text(f"__s_{c}"))
    wrong = F.col("action") == "wrong_class"
    checks = {
        "time_not_numeric": (a.isNotNull() & fa.isNull()) | (b.isNotNull() & fb.isNull()),
        "start_after_end": fa > fb,
        "bad_staff": norm_text("staff").isNotNull() & ~norm_text("staff").isin("1", "2"),
        "note_not_integer": num("start_note") | num("end_note") | F.exists(conn, lambda x: ~x.rlike("^[0-9]+$")),
        "note_not_connected": outside("start_note") | outside("end_note"),
        "nothing_changed": (F.col("action") == "correct") & same,
        "class_missing": wrong & (norm_text("corrected_class").isNull() | norm_text("corrected_class_id").isNull()
                                  | ((text("corrected_class") == text("__s_class")) & (text("corrected_class_id") == text("__s_class_id")))),
    }
    hit = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in checks.items()]))
    err = err.unionByName(j.select(F.explode(hit).alias("rule"), _id().alias("detail")))
    if ids is not None:
        used = j.select(*KEY, F.explode(F.array_distinct(F.array_compact(F.concat(conn, F.array(norm_text("start_note"), norm_text("end_note")))))).alias("note_id")).where(F.col("note_id").rlike("^[0-9]+$"))
        gone = used.join(ids.select(F.col("note_id").cast("string").alias("note_id")), "note_id", "left_anti")
        err = err.unionByName(_rows(gone, "unknown_note", F.concat(_id(), F.lit("->"), "note_id")))
    if classes is not None:
        c = classes.select(F.col("id").cast("string").alias("corrected_class_id"), F.col("name").alias("__name"))
        m = j.where(wrong & norm_text("corrected_class_id").isNotNull() & norm_text("corrected_class").isNotNull()).join(c, "corrected_class_id", "left")
        err = err.unionByName(_rows(m.where(~F.col("__name").eqNullSafe(F.col("corrected_class"))), "class_id_mismatch", _id()))
    return err


def gate(df: DataFrame, errors: DataFrame) -> DataFrame:
    """df if there are no errors, else no rows at all: decisions apply together or not at all."""
    return df.limit(0) if not errors.isEmpty() else df


# REV-07 -----------------------------------------------------------------
def apply_decisions(rows: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows after the decisions, log). not_a_symbol and bad_bbox remove the row from the result, not from the log.

    Approval is only ever set by a correction (of values or of the class). A correction may also move the target
    points; the start of a span goes before the single point.
    """
    pre = [*S.SEMANTIC, "staff", "corrected_class_id", "corrected_class", "comment", "action", *[c for sources in TARGETS.values() for c in sources]]
    d = decisions.where(F.coalesce(norm_text("action"), F.lit("pending")) != "pending").select(*KEY, *[F.col(c).alias(f"__d_{c}") for c in pre if c in decisions.columns])
    j = rows.join(d, KEY, "left").withColumn("__act", F.coalesce("__d_action", F.lit("none")))
    act = F.col("__act")
    blank, correct, wrong, confirm = act.isin("reject", "scan_only", "bad_bbox", "wrong_class"), act == "correct", act == "wrong_class", act == "confirm"
    new = {c: F.when(blank, "").when(correct, blank_na(f"__d_{c}")).otherwise(F.col(c)) for c in S.SEMANTIC}
    new["xml_staff"] = F.when(correct, blank_na("__d_staff")).otherwise(F.col("xml_staff"))
    for c, sources in TARGETS.items():
        given = [norm_text(f"__d_{x}") for x in sources if x in decisions.columns]
        if c in rows.columns and given:
            new[c] = F.when(correct, F.coalesce(*[g.cast(rows.schema[c].dataType) for g in given], F.col(c))).otherwise(F.col(c))
    new["class"] = F.when(wrong, F.col("__d_corrected_class")).otherwise(F.col("class"))
    new["class_id"] = F.when(wrong, F.col("__d_corrected_class_id").cast(rows.schema["class_id"].dataType)).otherwise(F.col("class_id"))
    new["alignment_status"] = F.when(blank, "unresolved").when(correct | confirm, "matched").otherwise(recode_status("status", STATUS_REVIEW))
    new["review_status"] = F.when(confirm, "confirmed").when(correct, "corrected").when(act.isin("uncertain", "skipped"), "deferred").when(act != "none", act)
    new["match_source"] = F.when(confirm, "human_confirmation").when(correct, "human_review").when(wrong, "human_wrong_class").otherwise(F.col("match_source"))
    new["human_approved"] = F.when(correct | wrong, "true").otherwise("false")
    gone = act.isin("not_a_symbol", "bad_bbox")
    out = j.where(~gone).withColumns(new).select(*rows.columns, *[c for c in ("alignment_status", "review_status", "human_approved") if c not in rows.columns])
    machine = F.struct(*[blank_na(c).alias(c) for c in S.SEMANTIC], blank_na("xml_staff").alias("staff"))
    empty = F.struct(*[F.lit("").alias(c) for c in S.EVALUATED])
    fixed = F.struct(*[blank_na(f"__d_{c}").alias(c) for c in S.SEMANTIC], blank_na("__d_staff").alias("staff"))
    log = j.where(act != "none").select(
        *KEY, "class", act.alias("action"), F.col("__d_corrected_class_id").alias("corrected_class_id"), F.col("__d_corrected_class").alias("corrected_class"), machine.alias("original"),
        F.when(confirm, machine).when(correct, fixed).otherwise(empty).alias("corrected"),
        (F.col("__d_comment") if "comment" in decisions.columns else F.lit("")).alias("comment"), act.isin("confirm", "correct", "reject").alias("evaluated"))
    return out, log


# REV-08 -----------------------------------------------------------------
def apply_to_master(master: DataFrame, log: DataFrame, reviewer: str, reviewed_at: str) -> DataFrame:
    """The logged corrections on master rows, with the values before and after as JSON."""
    d = log.select(*KEY, F.col("action").alias("__act"), F.col("corrected").alias("__new"), F.col("corrected_class_id").alias("__cid"), F.col("corrected_class").alias("__cn"), F.col("comment").alias("__comment"))
    j = master.join(d, KEY, "left").withColumn("__act", F.coalesce("__act", F.lit("none")))
    act = F.col("__act")
    correct, wrong, confirm, none = act == "correct", act == "wrong_class", act == "confirm", act == "none"
    blank = act.isin("reject", "scan_only", "wrong_class")
    before = F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in sorted([*S.SEMANTIC, "staff", "class_id", "class"])]))
    after = F.to_json(F.struct(*[F.col("__new")[c].alias(c) for c in sorted(S.EVALUATED)]))
    new = {c: F.when(blank, "").when(correct, F.col("__new")[c]).otherwise(F.col(c)) for c in S.SEMANTIC}
    new |= {
        "staff": F.when(correct, F.col("__new")["staff"]).otherwise(F.col("staff")),
        "class_id": F.when(wrong, F.col("__cid").cast(master.schema["class_id"].dataType)).otherwise(F.col("class_id")), "class": F.when(wrong, F.col("__cn")).otherwise(F.col("class")),
        "alignment_status": F.when(confirm | correct, "matched").when(blank, "unresolved").otherwise(F.col("alignment_status")),
        "review_status": F.when(confirm, "confirmed").when(correct, "corrected").when(wrong, "corrected_class_needs_alignment").when(act.isin("reject", "scan_only"), act)
        .when(act.isin("uncertain", "skipped"), "deferred").otherwise(F.col("review_status")),
        "match_source": F.when(confirm, "human_confirmation").when(correct, "human_review").when(act.isin("wrong_class", "reject", "scan_only"), F.concat(F.lit("human_"), act)).otherwise(F.col("match_source")),
        "human_approved": F.when(correct | wrong, "true").when(~none, "false").otherwise(F.col("human_approved")),
        "reviewer": F.when(~none, reviewer), "reviewed_at": F.when(~none, reviewed_at), "review_source": F.when(~none, "website"),
        "original_candidate_json": F.when(~none, before), "corrected_value_json": F.when(~none, after), "comment": F.when(~none, blank_na("__comment"))}
    return j.where(~act.isin("not_a_symbol", "bad_bbox")).withColumns(new).drop("__act", "__new", "__cid", "__cn", "__comment")


# REV-09 -----------------------------------------------------------------
def normalize_truth(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(truth, errors) from review tables with differing headers; needs source_file and source_row.

    The first row of a key wins, by file name and then by row.
    """
    names = ["page_id", "yolo_line", "note_ids", "start_note_id", "end_note_id", "note_id", "class_id", "class", "review_status", "candidate_status", "corrected_start_meas", "candidate_start_meas",
             "bps_time", "start_bps_time", "corrected_end_meas", "candidate_end_meas", "end_note_bps_time", "staff", "comment"]
    d = df.withColumns({c: F.lit(None).cast("string") for c in names if c not in df.columns})
    ok = norm_text("page_id").isNotNull() & norm_text("yolo_line").isNotNull()
    where = F.concat_ws(":", "source_file", F.col("source_row").cast("string"))
    err = _rows(d.where(~ok), "missing_key", where)
    d = d.where(ok).withColumns({"page_id": norm_text("page_id"), "yolo_line": norm_text("yolo_line")})
    d = number_rows(d, KEY, ["source_file", "source_row"], "__rn")
    err = err.unionByName(_rows(d.where("__rn > 1"), "duplicate_key", _id()))
    d = d.where("__rn = 1")
    ids = id_list("note_ids")
    s = F.coalesce(first_nonblank("start_note_id", "note_id"), F.get(ids, F.lit(0)))
    e = F.coalesce(first_nonblank("end_note_id", "note_id"), F.get(ids, F.size(ids) - 1))
    listed = F.when(F.size(ids) > 0, ids).otherwise(F.array_distinct(F.array_compact(F.array(s, e))))
    out = d.select(
        "source_file", *KEY, blank_na("class_id").alias("class_id"), blank_na("class").alias("class"), F.coalesce(first_nonblank("review_status", "candidate_status"), F.lit("")).alias("review_status"),
        F.coalesce(first_nonblank("corrected_start_meas", "candidate_start_meas", "bps_time", "start_bps_time"), F.lit("")).alias("expected_start_meas"),
        F.coalesce(first_nonblank("corrected_end_meas", "candidate_end_meas", "bps_time", "end_note_bps_time"), F.lit("")).alias("expected_end_meas"),
        F.coalesce(s, F.lit("")).alias("expected_start_note"), F.coalesce(e, F.lit("")).alias("expected_end_note"),
        F.when(F.size(listed) > 0, F.to_json(listed)).otherwise("").alias("expected_connected_note"), blank_na("staff").alias("expected_staff"), blank_na("comment").alias("comment"))
    return out, err


# REV-10 -----------------------------------------------------------------
def import_reviews(rows: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): confirmed and corrected reviews override with confidence 1; another class rejects the review.

    reviews: page_id, yolo_line, class, review_status, comment, start_meas, end_meas, note_ids (array).
    """
    r = reviews.select(*KEY, F.col("class").alias("__c"), F.col("review_status").alias("__s"), F.col("comment").alias("__comment"), F.col("start_meas").alias("__a"), F.col("end_meas").alias("__b"),
                       F.col("note_ids").alias("__ids"), F.lit(True).alias("__hit"))
    j = rows.join(r, KEY, "left")
    clash = F.col("__hit").isNotNull() & norm_text("__c").isNotNull() & (F.col("__c") != F.col("class"))
    j = j.withColumn("__clash", F.coalesce(clash, F.lit(False)))
    err = _rows(j.where("__clash"), "class_mismatch", _id())
    seen = F.col("__hit").isNotNull() & ~F.col("__clash")
    use = seen & F.coalesce(F.col("__s").isin("confirmed", "corrected"), F.lit(False))
    set_ = lambda c, v: F.when(use, v).otherwise(F.col(c))
    out = j.withColumns({
        "comment": F.when(seen, F.col("__comment")), "start_meas": set_("start_meas", F.col("__a")), "end_meas": set_("end_meas", F.coalesce("__b", "__a")),
        "start_note": set_("start_note", F.get("__ids", F.lit(0)).cast("string")), "end_note": set_("end_note", F.get("__ids", F.size("__ids") - 1).cast("string")),
        "connected_note": set_("connected_note", F.to_json("__ids")), "alignment_status": set_("alignment_status", F.lit("matched")), "review_status": set_("review_status", F.col("__s")),
        "human_approved": set_("human_approved", F.lit("true")), "match_source": set_("match_source", F.lit("human_review")), "confidence": set_("confidence", F.lit("1.000"))})
    return out.drop("__c", "__s", "__comment", "__a", "__b", "__ids", "__hit", "__clash"), err


# REV-11 -----------------------------------------------------------------
def preserve_reviews(new: DataFrame, old: DataFrame, keys, cols: dict) -> DataFrame:
    """Fresh candidates that keep the human columns of the earlier table (else the default given)."""
    keys = list(keys)
    o = old.select(*keys, *[F.col(c).alias(f"__o_{c}") for c in cols])
    return new.join(o, keys, "left").withColumns({c: F.coalesce(norm_text(f"__o_{c}"), F.lit(v)) for c, v in cols.items()}).drop(*[f"__o_{c}" for c in cols])


# REV-12 -----------------------------------------------------------------
def save_decisions(decisions: DataFrame, fingerprint: str, score_id: str, version: str, reviewer: str, path: str) -> None:
    """Decisions with the fingerprint of the batch they belong to on every row."""
    if not fingerprint:
        raise ValueError("a fingerprint is required")
    head = {"schema_version": F.lit("2.0"), "fingerprint": F.lit(fingerprint), "score_id": F.lit(score_id), "version": F.lit(version), "reviewer": F.lit(reviewer or "User")}
    decisions.withColumns(head).write.mode("overwrite").parquet(path)


def restore_decisions(saved: DataFrame, rows: DataFrame, fingerprint: str, score_id: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(decisions, errors). Another batch, score or version, unknown and duplicate keys are errors."""
    want = {"schema_version": "2.0", "fingerprint": fingerprint, "score_id": score_id, "version": version}
    heads = saved.select(*want).distinct()
    bad = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.lit(v)), F.lit(f"wrong_{c}")) for c, v in want.items()]))
    err = heads.select(F.explode(bad).alias("rule"), F.lit("").alias("detail")).distinct()
    act = F.coalesce(norm_text("action"), F.lit("pending"))
    err = err.unionByName(_rows(saved.where(~act.isin(S.REVIEW_ACTIONS)), "invalid_action", _id()))
    err = err.unionByName(_rows(saved.join(rows.select(*KEY), KEY, "left_anti"), "unknown_row", _id())).unionByName(expect_unique(saved, KEY))
    return saved.drop(*want, "reviewer"), err


# REV-13 -----------------------------------------------------------------
def audit_batch(master: DataFrame, reviewed: DataFrame, n_unresolved: int, n_risk: int, prefix: str = "fingering", bbox: str = "bbox_id") -> DataFrame:
    """Two stratified takes by (page, class) of rows not reviewed yet: unresolved ones, then risky links."""
    m = master.where(F.col("class").startswith(prefix) & (F.col("movement_scope_status") == "in_bpsd_scope") & norm_text("error_code").isNull()).join(reviewed.select(bbox), bbox, "left_anti")
    strata = ["page_id", "class"]
    a = round_robin(m.where("alignment_status = 'unresolved'"), strata, [F.col(bbox)], n_unresolved).withColumn("selection_reason", F.lit("unresolved"))
    conf = F.coalesce(try_float("confidence"), F.lit(0.0))
    b = round_robin(m.where("alignment_status in ('candidate', 'ambiguous')"), strata, [conf.desc(), F.col(bbox)], n_risk).withColumn("selection_reason", F.lit("high_risk_link"))
    return a.unionByName(b)


# REV-14 -----------------------------------------------------------------
def scan_only(reviews: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, errors): both endpoints must be found exactly once and carry no XML mark.

    reviews: page_id, yolo_line, start_id, start_tick, start_pitch, end_id, end_tick,
    end_pitch. notes: note_id, tick, pitch, has_mark (boolean).
    """
    out = reviews
    for side in ("start", "end"):
        n = notes.select(F.col("note_id").alias(f"{side}_id"), F.col("tick").alias(f"{side}_tick"), F.col("pitch").alias(f"{side}_pitch"), F.col("has_mark").alias(f"{side}_mark"))
        out = lookup_one(out, n, [f"{side}_id", f"{side}_tick", f"{side}_pitch"], [f"{side}_mark"]).withColumnRenamed("matches", f"{side}_matches")
    lost = (F.col("start_matches") != 1) | (F.col("end_matches") != 1)
    marked = F.coalesce(F.col("start_mark") | F.col("end_mark"), F.lit(False))
    why = F.when(lost, "endpoint_not_found").when(marked, "endpoint_has_mark")
    out = out.withColumn("rule", why)
    return out.where("rule is null").drop("rule", "start_mark", "end_mark", "start_matches", "end_matches"), out.where("rule is not null").select("rule", _id().alias("detail"))


# REV-15 -----------------------------------------------------------------
def endpoint_rows(summary: DataFrame, notes: DataFrame, status: str = "high_confidence_candidate") -> DataFrame:
    """Rows of one status with both endpoint notes looked up; the matches columns tell a failed lookup."""
    out = summary.where(F.col("status") == status)
    for side in ("start", "end"):
        n = notes.select(F.col("note_id").alias(f"{side}_note"), F.col("tick").alias(f"{side}_tick"), F.col("pitch").alias(f"{side}_pitch"), F.col("staff").alias(f"{side}_staff"))
        out = lookup_one(out, n, [f"{side}_note", f"{side}_tick", f"{side}_pitch"], [f"{side}_staff"]).withColumnRenamed("matches", f"{side}_matches")
    return out.orderBy("page_id", "yolo_line")


# REV-16 -----------------------------------------------------------------
def check_rows(pairs: DataFrame, members: DataFrame, pair_keys, chord: str) -> DataFrame:
    """One row per matched mark with its chord's pitches and ids joined by "+".

    pairs: pair_keys, chord. members: chord, note_id, pitch, midi, seq, beat.
    """
    m = members.groupBy(chord).agg(F.array_sort(F.collect_list(F.struct("midi", "seq", "pitch", "note_id"))).alias("m"), F.min("beat").alias("beat"))
    j = pairs.join(m, chord, "left")
    text = lambda f: F.array_join(F.transform("m", lambda x: x[f].cast("string")), "+")
    return j.select(*pair_keys, chord, "beat", F.coalesce(F.size("m"), F.lit(0)).alias("chord_size"), text("pitch").alias("pitches"), text("note_id").alias("note_ids"), F.lit("").alias("review_status"))


# REV-17 -----------------------------------------------------------------
def review_progress(rows: DataFrame, decisions: DataFrame, **filters) -> tuple[DataFrame, DataFrame]:
    """(total, reviewed, share) under the filters, and the next open item."""
    q = reader_queue(rows, decisions, **filters)
    done = ~F.col("saved_action").isin("pending", "skipped")
    n = q.agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("reviewed"))
    n = n.withColumn("share", F.when(F.col("total") > 0, F.round(F.col("reviewed") / F.greatest("total", F.lit(1)), 6)).otherwise(1.0))
    return n, q.where(~done).orderBy(*READER_ORDER).limit(1)


# REV-18 -----------------------------------------------------------------
def decision_from_choice(rows: DataFrame, choices: DataFrame, notes: DataFrame) -> DataFrame:
    """Decision rows from a reviewer's choice of a note or of two endpoints.

    choices: page_id, yolo_line, action, start_choice, end_choice (note ids; a missing end
    means the start). notes: note_id, time, staff. confirm copies the machine values.
    """
    c = choices.withColumn("end_choice", F.coalesce("end_choice", "start_choice"))
    j = rows.join(c, KEY)
    for side in ("start", "end"):
        n = notes.select(F.col("note_id").alias(f"{side}_choice"), F.col("time").alias(f"__{side}_t"), F.col("staff").cast("string").alias(f"__{side}_s"))
        j = lookup_one(j, n, [f"{side}_choice"], [f"__{side}_t", f"__{side}_s"]).drop("matches")
    keep = F.col("action") == "confirm"
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    ids = F.array_distinct(F.array_compact(F.array(F.col("start_choice").cast("string"), F.col("end_choice").cast("string"))))
    pick = lambda own, chosen: F.when(keep, blank_na(own)).otherwise(chosen)
    return j.select(
        *KEY, "action", pick("start_meas", text("__start_t")).alias("start_meas"), pick("end_meas", text("__end_t")).alias("end_meas"), pick("start_note", text("start_choice")).alias("start_note"),
        pick("end_note", text("end_choice")).alias("end_note"), pick("connected_note", F.concat(F.lit("["), F.array_join(ids, ", "), F.lit("]"))).alias("connected_note"),
        pick("xml_staff", F.coalesce("__start_s", F.lit(""))).alias("staff"))
