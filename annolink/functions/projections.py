"""Row-shaped rules: final projection, masks, default rows, relation and match status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from .classes import recode_status
from .text import _c, blank_na, norm_text


# PRJ-01 -----------------------------------------------------------------
def final_projection(df: DataFrame) -> DataFrame:
    """Strict output row: only confirmed rows keep their semantic columns."""
    approved = F.lower(F.trim(F.col("human_approved").cast("string"))) == "true"
    corrected = F.coalesce(approved, F.lit(False)) | F.coalesce(F.col("match_source") == "human_review", F.lit(False))
    confirmed = corrected | F.coalesce(F.col("alignment_status") == "matched", F.lit(False))
    cols = []
    for name in S.OFFICIAL:
        value = blank_na(name)
        if name in S.SEMANTIC:
            value = F.when(confirmed, value).otherwise("")
        if name == "stem_dir":
            value = F.when(F.col("class") == "stem", value).otherwise("")
        cols.append(value.alias(name))
    return df.select(*cols, F.when(corrected, "1").otherwise("0").alias("human_corrected"))


# PRJ-12 -----------------------------------------------------------------
def apply_scope_mask(df: DataFrame) -> DataFrame:
    """Blank the semantic columns of rows outside the scope or with a merged mapping."""
    outside = F.coalesce(F.col("movement_scope_status") == "outside_bpsd_scope", F.lit(False))
    merged = ~outside & F.coalesce(F.col("scope_review_status") == "needs_review", F.lit(False))
    new = {}
    for name in S.SCOPE_MASKED:
        if name in df.columns:
            hide = outside if name in S.SCOPE_MASKED_OUTSIDE_ONLY else outside | merged
            new[name] = F.when(~hide, F.col(name))
    new["alignment_status"] = F.when(outside, "xml_missing").when(merged, "unresolved").otherwise(F.col("alignment_status"))
    new["review_status"] = F.when(outside, "not_required").otherwise(F.col("review_status"))
    new["error_code"] = F.when(merged, "merged_system_mapping_review").otherwise(F.col("error_code"))
    return df.withColumns(new)


# PRJ-16 -----------------------------------------------------------------
def base_rows(boxes: DataFrame) -> DataFrame:
    """Default unmatched row per box: every semantic column "not applicable"."""
    na = {c: F.lit("NA") for c in S.SEMANTIC + ["xml_measure", "xml_symbol", "xml_staff", "match_source"]}
    return boxes.withColumns({**na, "musical_time": F.lit(0), "confidence": F.lit(0.0), "status": F.lit("unmatched")})


def conservative_rows(boxes: DataFrame, kind: Column) -> DataFrame:
    """Default row by class family: columns that apply but are unknown are blank, others NA.

    kind is "timed" (time and notes apply), "stem" (only the stem direction applies) or "plain".
    """
    unknown = F.lit("")
    timed, stem = kind == "timed", kind == "stem"
    cols = {}
    for c in S.SEMANTIC:
        applies = stem if c == "stem_dir" else timed
        cols[c] = F.when(applies, unknown).otherwise("NA")
    cols["status"] = F.when(timed | stem, "unresolved").otherwise("not_applicable")
    return boxes.withColumns({**cols, "musical_time": F.lit(0)})


# PRJ-17 -----------------------------------------------------------------
def editor_rows(df: DataFrame, include_matched: bool = False) -> DataFrame:
    status = F.coalesce(norm_text("status"), F.lit("unresolved"))
    out = df if include_matched else df.where(status != "matched")
    keep = [c for c in S.SEMANTIC if c != "stem_dir"]
    return out.select(
        F.lit("pending").alias("action"),
        "page_id",
        "yolo_line",
        "class",
        status.alias("machine_status"),
        *[blank_na(c).alias(c) for c in keep],
        blank_na("xml_staff").alias("staff"),
        F.lit("").alias("comment"),
    )


# PRJ-19 -----------------------------------------------------------------
def relation_type(target_type, note, start, end) -> Column:
    """Role of a note for a box: target, start of a span, end of a span, or an endpoint."""
    t, n, s, e = _c(target_type), _c(note), _c(start), _c(end)
    at_start, at_end = s.eqNullSafe(n), e.eqNullSafe(n)
    return (
        F.when(~t.eqNullSafe(F.lit("span")), "target_note")
        .when(at_start & ~at_end, "span_start")
        .when(at_end & ~at_start, "span_end")
        .otherwise("span_endpoint")
    )


# PRJ-20 -----------------------------------------------------------------
def note_match_status(found, midi, note_midi, tick, start_tick, end_tick) -> Column:
    """How an event agrees with the note it points to; times are integer ticks."""
    return (
        F.when(~_c(found), "unresolved")
        .when(~_c(midi).eqNullSafe(_c(note_midi)), "pitch_mismatch")
        .when(_c(tick) == _c(start_tick), "exact")
        .when(_c(tick).between(_c(start_tick), _c(end_tick)), "within_tied_span")
        .otherwise("time_mismatch")
    )


def machine_status(df: DataFrame, table: dict) -> DataFrame:
    """Recode the machine status and mark the row as not human-approved."""
    return df.withColumns(
        {"alignment_status": recode_status("status", table), "human_approved": F.lit("false")}
    )
