"""Column lists and types of the stored tables.

The names are fixed values: files written by other tools carry them.
"""

from __future__ import annotations

OFFICIAL = [
    "class_id", "x", "y", "w", "h", "class", "musical_time", "start_meas", "end_meas",
    "start_note", "end_note", "connected_note", "stem_dir",
]
SEMANTIC = ["start_meas", "end_meas", "start_note", "end_note", "connected_note", "stem_dir"]
EVALUATED = SEMANTIC + ["staff"]
SCOPE_MASKED_OUTSIDE_ONLY = ["musical_time"]
SCOPE_MASKED = [
    "musical_time", "start_meas", "end_meas", "start_note", "end_note", "connected_note",
    "xml_measure", "xml_symbol", "staff", "target_type", "note_ids", "pitches",
    "repeat_occurrences_json", "repeat_occurrence_count", "repeat_group_id", "match_source",
    "confidence", "target_x_px", "target_y_px",
]
REVIEW_ACTIONS = [
    "pending", "confirm", "correct", "scan_only", "wrong_class", "bad_bbox", "not_a_symbol",
    "uncertain", "skipped", "reject",
]
LINKABLE = ["matched", "candidate", "ambiguous"]
MATCH_METHOD_RANK = {"exact": 0, "rounded_tolerance": 1, "within_tied_span": 2}

# DDL of the stored tables.

LABEL = (
    "page_id string, yolo_line int, class_id int, class string, x double, y double, w double, h double"
)
NOTE = (
    "note_id long, start_meas double, end_meas double, duration_quarterLength double, pitch int, "
    "pitchName string, timeSig string, articulation string, grace int"
)
NODE = (
    "doc_id string, node_id long, parent_id long, depth int, sibling_index int, xpath string, "
    "tag string, namespace string, attributes map<string,string>, text string, tail string, "
    "child_ids array<long>"
)
REPEAT_MAP = (
    "score_id string, unfolded_measure_index int, unfolded_measure string, written_measure_index int, "
    "written_measure string, is_repeated_measure string, repeat_occurrence int, "
    "repeat_occurrence_count int, repeat_group_id string, mapping_status string"
)
REVIEW_FEEDBACK = (
    "reviewer string, recorded_date string, source string, entries array<struct<sample_id:string,"
    "bbox_id:string,resolution_status:string,apply_to_audit:boolean,corrected_note_ids:array<int>,"
    "corrected_xml_event_ids:array<string>,corrected_start_meas:string,canonical_pitch:string,"
    "evidence:string,measure_numbering_domain:string,"
    "user_correction:struct<pitch:string,staff:string,measure:string>>>"
)
LEDGER = ("unit_id string, digest string, version string, status string, row_count long")
