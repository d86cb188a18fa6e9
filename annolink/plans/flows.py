"""Stages as functions from tables to tables. The page is a key of every stage, never a loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classes import class_rule
from ..operators.aggregates import count_by
from ..operators.joins import nearest_band, nearest_join, zip_join
from ..operators.matching import match_points, match_ties, match_tuplets, overlay
from ..operators.pairing import align_sequences, build_spans, expand_timeline, fill_bounded_gaps, fingerprints, note_token, repeat_rows
from ..operators.quality import expect_same_keys, expect_unique
from ..operators.reconcile import build_links, combine_lossless, tagged_union
from ..operators.review import audit_sample, review_queue, split_auto_accept
from ..operators.spans import match_spans
from ..session import settle


def repeat_map(written: DataFrame, unfolded: DataFrame) -> DataFrame:
    """Repeat map of scores from the notes of the printed and the played version.

    Both: score_id, measure (from 0), seq, step, alter, octave, staff, is_chord, is_grace; a
    measure without notes has one row with step NULL.
    """
    def tokens(df):
        full = fingerprints(df.where("step is not null"), ["score_id", "measure"], ["seq"], note_token())
        every = df.select("score_id", "measure").distinct()
        return every.join(full, ["score_id", "measure"], "left").select("score_id", F.col("measure").alias("pos"), F.coalesce("fingerprint", F.lit("empty")).alias("token"))

    mapped = align_sequences(tokens(written), tokens(unfolded), ["score_id"])
    return repeat_rows(fill_bounded_gaps(mapped, ["score_id"]), ["score_id"])


def align_pages(boxes: DataFrame, systems: DataFrame, dynamics: DataFrame, targets: DataFrame, anchors: DataFrame, bits: int = 13,
                spans: DataFrame | None = None, ties: DataFrame | None = None, tuplets: DataFrame | None = None, fingerings: DataFrame | None = None) -> DataFrame:
    """Every box with its best source: nearest-anchor estimate < dynamics < point marks < slurs < ties < tuplets < fingerings.

    boxes: page_id, yolo_line, class, x, y (integer pixels), page_w, page_h; with spans or ties also w (pixels). systems:
    page_id, system, center; with spans also x_left, x_right, upper_center, staff_spacing. dynamics: page_id, system,
    class, event_id, x, time. targets: see match_points. anchors: page_id, system, anchor_id, x, y. spans: see
    match_spans. ties: see match_ties. tuplets: see match_tuplets. fingerings: the rows of allocate_groups, whose
    unmatched boxes keep what they had.
    """
    placed = nearest_band(boxes.withColumn("bx", F.col("y")), systems.withColumn("center", F.round("center").cast("bigint")), ["page_id"], "yolo_line", "bx", "center", "system")
    b = settle(boxes.join(placed.drop("gap"), ["page_id", "yolo_line"]))
    key = ["page_id", "yolo_line"]
    row = [*key, "target", "confidence", "status", "match_source"]
    est = nearest_join(b, anchors, ["page_id", "system"], "yolo_line", "anchor_id", "x", "y", bits, F.col("page_w"))
    est = est.select(*key, F.col("anchor_id").alias("target"), "confidence", F.lit("review").alias("status"), F.lit("geometric_nearest_anchor_time_estimate").alias("match_source"))
    dyn = zip_join(b.where(F.col("class").startswith("dynamic")), dynamics, ["page_id", "system", "class"], ["x", "yolo_line"], ["x", "time", "event_id"], {"yolo_line": "yolo_line"}, {"event_id": "target"})
    dyn = dyn.where("pair_status in ('matched', 'review')").select(*key, "target", "confidence", F.col("pair_status").alias("status"), F.lit("musicxml_dynamic").alias("match_source"))
    ruled = b.withColumn("r", class_rule("class")).where("r is not null").select("*", "r.kind", "r.mark")
    pts = match_points(ruled.drop("r"), targets, bits).select(*key, F.col("seq").alias("target"), "confidence", "status", F.concat(F.lit("musicxml_"), "mark").alias("match_source"))
    sources = [est, dyn, pts]
    if spans is not None:
        slurs = b.where("class = 'slur'").select(*key, "system", F.col("x").cast("double").alias("center_x"), F.col("y").cast("double").alias("center_y"), F.col("w").cast("double").alias("width_px"))
        sources.append(match_spans(slurs, spans, systems.drop("center")).withColumnRenamed("span_id", "target").select(*row))
    if ties is not None:
        found = match_ties(b.where("class = 'tie'"), ties, bits)
        sources.append(found.withColumns({"target": F.col("tie_id"), "match_source": F.lit("musicxml_tie_endpoints")}).select(*row))
    if tuplets is not None:
        found = match_tuplets(b.where(F.col("class").startswith("tuplet")), tuplets)
        sources.append(found.withColumns({"target": F.col("group_id"), "match_source": F.lit("musicxml_tuplet")}).select(*row))
    if fingerings is not None:
        sources.append(fingerings.where("status <> 'unmatched'").withColumn("target", F.col("note_id")).select(*row))
    best = overlay(sources, key, ["target", "confidence", "status", "match_source"])
    return b.join(best, key, "left").fillna({"status": "unmatched", "match_source": "no_musicxml_anchor"})


# SET-04 -----------------------------------------------------------------
def build_exports(boxes: DataFrame, events: DataFrame, occurrences: DataFrame, nodes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Links, combined rows, spans, timeline and all-information tables, and the conservation checks."""
    links = settle(build_links(boxes, events, occurrences))
    combined = settle(combine_lossless(boxes, events, links))
    slim = boxes.withColumns({"record_id": F.col("bbox_id").cast("string"), "start_meas": F.col("start_meas").cast("string")})
    ev = events.withColumns({"record_id": F.col("xml_event_id").cast("string"), "start_meas": F.col("start_meas").cast("string"), "staff": F.col("staff").cast("string"), "xml_measure": F.col("xml_measure").cast("string")})
    common = ["record_id", "score_id", "class", "staff", "xml_measure", "start_meas"]
    sources = {"yolo": slim.select(*common), "xml_event": ev.select(*common)}
    timeline = tagged_union(sources)
    if nodes is not None:
        sources["xml_node"] = nodes.select(F.concat_ws(":N", "doc_id", F.col("node_id").cast("string")).alias("record_id"), F.col("doc_id").alias("score_id"), F.col("tag").alias("class"))
    rows = combined.select("record_id", "row_origin")
    errors = (
        expect_same_keys(boxes.select(F.col("bbox_id").cast("string").alias("record_id")), rows.where("row_origin = 'yolo'"), ["record_id"])
        .unionByName(expect_unique(rows, ["row_origin", "record_id"])).unionByName(expect_unique(links, ["bbox_id", "link_rank"])))
    out = {"links": links, "combined": combined, "timeline": timeline, "all_information": tagged_union(sources), "errors": errors, "counts": count_by(combined, ["row_origin"], ["combined_status"], ["row_origin", "combined_status"])}
    if {"attributes", "start_note", "midi_pitch"} <= set(events.columns):
        out["spans"] = build_spans(events)
    return out


def performance_order(boxes: DataFrame, events: DataFrame) -> DataFrame:
    """Both sources, one row per performance. boxes and events carry their occurrences as JSON."""
    a = expand_timeline(boxes, "repeat_occurrences_json", "yolo", "bbox_id")
    b = expand_timeline(events, "repeat_json", "xml_event", "xml_event_id")
    return a.unionByName(b, allowMissingColumns=True)


def review_round(combined: DataFrame, links: DataFrame, assets: DataFrame, master: DataFrame, threshold: float = 0.95) -> dict[str, DataFrame]:
    """Queue, proposals with their audit sample, and the rows left for people."""
    q = settle(review_queue(combined, links, assets))
    split = settle(split_auto_accept(q.withColumn("source_status", F.col("combined_status")), master, threshold))
    return {"queue": q, "proposals": audit_sample(split.where("eligible")), "manual": split.where("not eligible")}
