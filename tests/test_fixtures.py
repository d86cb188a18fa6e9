"""Small domain fixtures with the results a user of the toolkit expects."""

import json

import pytest
from pyspark.sql import functions as F

from annolink.functions import classes as C
from annolink.functions import geometry as G
from annolink.functions import text as X
from annolink.operators import aggregates as A
from annolink import schemas as S
from annolink.operators import pairing as P
from annolink.operators import quality as Q
from annolink.operators import reconcile as R
from annolink.operators import review as V
from annolink.operators import windows as W
from annolink.plans import export as E
from annolink.plans import flows as FL
from annolink.sources import files as SF
from annolink.sources import markup as SM
from annolink.sources import sinks as SK
from annolink.streaming import incremental as I

# A duet in 3/8 with a pickup: six ticks to the quarter, so a full measure has nine.
SCORE = """<!DOCTYPE score-partwise>
<score-partwise>
<movement-title>Duet &amp; pickup</movement-title>
<part id="Vn">
 <measure number="0" implicit="yes">
  <attributes><divisions>6</divisions><time><beats>3</beats><beat-type>8</beat-type></time><key><fifths>-2</fifths></key><clef><sign>G</sign><line>2</line></clef></attributes>
  <note><pitch><step>F</step><alter>1</alter><octave>5</octave></pitch><duration>3</duration><voice>a</voice><notations><technical><up-bow/></technical></notations></note>
 </measure>
 <measure number="1">
  <print new-system="yes"/>
  <direction placement="above"><direction-type><wedge type="crescendo"/></direction-type><offset>3</offset></direction>
  <note><pitch><step>B</step><alter>-1</alter><octave>4</octave></pitch><duration>9</duration><tie type="start"/><voice>a</voice><stem>down</stem></note>
  <note><chord/><pitch><step>D</step><octave>5</octave></pitch><duration>9</duration><voice>a</voice></note>
  <backup><duration>9</duration></backup>
  <forward><duration>3</duration></forward>
  <note><pitch><step>G</step><octave>3</octave></pitch><duration>6</duration><voice>b</voice><notations><fermata type="inverted"/></notations></note>
 </measure>
 <measure number="2">
  <print new-page="yes"/>
  <note><rest/><duration>2</duration><voice>a</voice><notations><tuplet type="start"/></notations></note>
  <note><pitch><step>A</step><octave>4</octave></pitch><duration>2</duration><voice>a</voice></note>
  <note><pitch><step>C</step><octave>5</octave></pitch><duration>2</duration><voice>a</voice><notations><tuplet type="stop"/></notations></note>
  <attributes><clef><sign>C</sign><line>3</line></clef></attributes><?layout keep?>
  <note><pitch><step>E</step><alter>-1</alter><octave>4</octave></pitch><duration>3</duration><voice>a</voice></note>
  <barline location="right"><ending number="1" type="stop"/></barline>
 </measure>
</part>
<part id="Vc">
 <measure number="0"><attributes><divisions>6</divisions><time><beats>3</beats><beat-type>8</beat-type></time></attributes><note><rest/><duration>3</duration></note></measure>
 <measure number="1"><direction><direction-type><dynamics><pp/></dynamics></direction-type></direction><note><pitch><step>G</step><octave>2</octave></pitch><duration>9</duration></note></measure>
</part>
</score-partwise>"""


@pytest.fixture(scope="module")
def score(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("xml")
    (d / "duet.xml").write_text(SCORE)
    nodes = SM.node_context(SM.shred_xml(spark, str(d / "duet.xml"))).cache()
    return nodes, E.score_events(nodes).cache()


def test_shred_is_lossless_and_knows_layout(score):
    import xml.etree.ElementTree as ET

    nodes, _ = score
    parser = ET.XMLParser(target=ET.TreeBuilder(insert_pis=True))
    tree = ET.fromstring(SCORE, parser)
    got = nodes.orderBy("node_id").collect()
    want = list(tree.iter())
    assert [r["tag"] for r in got] == [e.tag if isinstance(e.tag, str) else "#processing-instruction" for e in want]
    assert [r["text"] for r in got] == [e.text or "" for e in want]
    assert [r["tail"] for r in got] == [e.tail or "" for e in want]
    # breaks are printed in the first part only
    measures = [(r["part_id"], r["measure_index"], r["measure_number"], r["page"], r["system"]) for r in got if r["tag"] == "measure"]
    assert measures == [("Vn", 1, "0", 1, 1), ("Vn", 2, "1", 1, 2), ("Vn", 3, "2", 2, 1), ("Vc", 1, "0", 1, 1), ("Vc", 2, "1", 1, 1)]
    assert {r["measure_index"] for r in got if r["tag"] in ("part", "movement-title", "score-partwise")} == {None}


def test_shred_refuses_entities(spark):
    bad = '<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>'
    out = SM.shred(spark.createDataFrame([("d", bad), ("e", "<a><b/>t</a>")], "id string, c string"), "id", "c").collect()
    assert sorted((r["doc_id"], r["tag"]) for r in out) == [("d", "#error"), ("e", "a"), ("e", "b")]


def test_events(score):
    _, events = score
    rows = events.orderBy("xml_event_id").collect()
    kinds = {(r["event_type"], r["event_subtype"]) for r in rows}
    assert kinds == {("attribute", "time_signature"), ("attribute", "key"), ("attribute", "clef"), ("direction", "wedge"), ("direction", "dynamic"), ("notation", "up-bow"), ("notation", "tie"),
                     ("notation", "fermata"), ("notation", "tuplet"), ("barline", "barline"), ("note", "note"), ("rest", "rest")}
    # the pickup fills the last third of its measure, and counting starts below 1
    notes = [(r["part_id"], r["measure_index"], r["voice"], r["midi"], r["pitch_name"], r["onset"], r["is_chord"], round(r["within"], 4)) for r in rows if r["event_type"] == "note"]
    assert notes == [("Vn", 1, "a", 78, "F#5", 0.0, False, 0.6667), ("Vn", 2, "a", 70, "Bb4", 0.0, False, 0.0), ("Vn", 2, "a", 74, "D5", 0.0, True, 0.0), ("Vn", 2, "b", 55, "G3", 3.0, False, 0.3333),
                     ("Vn", 3, "a", 69, "A4", 2.0, False, 0.2222), ("Vn", 3, "a", 72, "C5", 4.0, False, 0.4444), ("Vn", 3, "a", 63, "Eb4", 6.0, False, 0.6667), ("Vc", 2, "", 43, "G2", 0.0, False, 0.0)]
    assert {r["timeline_offset"] for r in rows} == {0} and [r["stem_dir"] for r in rows if r["midi"] == 70] == [0]
    one = {r["event_subtype"]: r for r in rows if r["event_type"] in ("direction", "barline") or r["event_subtype"] in ("fermata", "up-bow")}
    assert (one["wedge"]["class"], one["wedge"]["onset"], one["dynamic"]["class"], one["dynamic"]["part_id"]) == ("dynamicCrescendoHairpin", 3.0, "dynamicPP", "Vc")
    assert one["barline"]["onset"] == 9.0
    owner = {r["xml_event_id"]: r["midi"] for r in rows}
    assert (owner[one["fermata"]["anchor_event_id"]], owner[one["up-bow"]["anchor_event_id"]], one["fermata"]["voice"]) == (55, 78, "b")


def test_note_ids_by_tolerance(spark, score):
    _, events = score
    rm = spark.createDataFrame([("duet", i, i, 1, 1, "", "matched_fingerprint") for i in (1, 2, 3)],
                               "score_id string, measure_index int, unfolded_index int, repeat_occurrence int, repeat_occurrence_count int, repeat_group_id string, mapping_status string")
    # F# to the thousandth, B flat a little late, D held since before, A far off, C too late for the tolerance but none holds it
    notes = spark.createDataFrame([("duet", 20, 0.667, 1.0, 78), ("duet", 21, 1.0012, 2.0, 70), ("duet", 22, 0.9, 1.5, 74), ("duet", 23, 2.9, 3.0, 69), ("duet", 24, 2.4462, 2.6, 72)],
                                  "score_id string, note_id long, start_meas double, end_meas double, midi int")
    occ, out = E.link_notes(events, rm, notes)
    got = {r["midi"]: (r["note_id"], r["note_match_status"]) for r in occ.where("event_type = 'note' and part_id = 'Vn'").collect()}
    assert got == {78: (20, "exact"), 70: (21, "rounded_tolerance"), 74: (22, "within_tied_span"), 55: (None, None), 69: (None, None), 72: (None, None), 63: (None, None)}
    assert {r["midi"]: r["validation_status"] for r in out.where("event_type = 'note'").collect()}[70] == "bps_note_matched"
    rep, issues = E.note_coverage(occ, notes)
    assert {(r["scope"], r["coverage"]) for r in rep.collect()} == {("group", 0.6), ("total", 0.6)}
    assert issues.count() == 2


BOX = "score_id string, bbox_id string, class string, alignment_status string, human_approved string, target_type string, note_ids string, connected_note string, start_note int, end_note int, staff string, xml_page int, xml_measure string, xml_symbol string, start_meas double, confidence string, review_status string"
EVT = "score_id string, xml_event_id string, ord long, event_type string, event_subtype string, class string, page int, staff string, xml_measure string, start_meas double, dynamic string, marker string, anchors array<string>"


def test_links_and_lossless_combine(spark):
    """A slur over two notes, a dynamic whose measure is unknown, a fermata on a rest of the other staff, a fingering for review, and a box out of scope."""
    boxes = spark.createDataFrame([
        ("w", "x30", "slur", "matched", "false", "span", "[7,9]", "[7,9]", 7, 9, "2", 4, "20", "", 19.5, "0.910", "open"),
        ("w", "x31", "dynamicMF", "candidate", "false", "measure_position", "[]", "NA", None, None, "", 4, "", "mf", 20.25, "0.700", ""),
        ("w", "x32", "fermataBelow", "matched", "true", "rest", "[]", "NA", None, None, "2", 4, "21", "", 20.0, "0.990", "done"),
        ("w", "x33", "fingering2", "ambiguous", "false", "note", "[8]", "[8]", 8, 8, "2", 4, "20", "", 19.75, "0.500", ""),
        ("w", "x34", "tie", "xml_missing", "false", "note", "[7]", "[7]", 7, 7, "2", 4, "20", "", 19.5, "", "")], BOX)
    events = spark.createDataFrame([
        ("w", "n7", 10, "note", "note", "note", 4, "2", "20", 19.5, None, None, []), ("w", "n8", 11, "note", "note", "note", 4, "2", "20", 19.75, None, None, []), ("w", "n9", 12, "note", "note", "note", 4, "2", "20", 19.875, None, None, []),
        ("w", "m1", 13, "notation", "slur", "slur", 4, "2", "20", 19.5, None, "start", ["n7"]), ("w", "m2", 14, "notation", "slur", "slur", 4, "2", "20", 19.875, None, "stop", ["n9"]),
        ("w", "m3", 15, "notation", "accent", "x", 4, "2", "20", 19.5, None, None, ["n7"]),
        ("w", "d1", 16, "direction", "dynamic", "dynamicMF", 4, "1", "19", 18.0, "mf", None, []), ("w", "d2", 17, "direction", "dynamic", "dynamicMF", 4, "1", "21", 20.0, "mf", None, []),
        ("w", "r1", 18, "rest", "rest", "rest", 4, "1", "21", 20.0, None, None, []), ("w", "r2", 19, "rest", "rest", "rest", 4, "2", "21", 20.0, None, None, []),
        ("w", "m4", 20, "notation", "fermata", "x", 4, "2", "21", 20.0, None, None, ["r2"])], EVT)
    occ = spark.createDataFrame([("w", "n7", 7, 19.5, "exact"), ("w", "n8", 8, 19.75, "exact"), ("w", "n9", 9, 19.875, "rounded_tolerance")], "score_id string, xml_event_id string, note_id long, start_meas double, note_match_status string")
    out = FL.build_exports(boxes, events, occ)
    links = out["links"].collect()
    assert sorted((r["bbox_id"], r["xml_event_id"], r["link_method"], r["relation_type"], r["is_primary"], r["link_status"]) for r in links) == [
        ("x30", "m1", "xml_notation_anchor", "semantic_event", True, "matched"), ("x30", "m2", "xml_notation_anchor", "semantic_event", False, "matched"),
        ("x30", "n7", "bps_note_anchor", "span_start", False, "matched"), ("x30", "n9", "bps_note_anchor", "span_end", False, "matched"),
        ("x31", "d2", "xml_direction_measure_symbol", "semantic_event", True, "candidate"),
        ("x32", "m4", "xml_notation_anchor", "semantic_event", True, "confirmed"), ("x32", "r2", "xml_rest_anchor", "target_rest", False, "confirmed"),
        ("x33", "n8", "bps_note_anchor", "target_note", True, "ambiguous")]
    rows = {r["record_id"]: r["combined_status"] for r in out["combined"].collect()}
    assert rows == {"x30": "aligned", "x31": "candidate", "x32": "aligned", "x33": "ambiguous", "x34": "yolo_only", "m3": "xml_only", "d1": "xml_only", "r1": "xml_only"}
    assert out["errors"].count() == 0
    assert out["timeline"].count() == 16


def test_combined_rows_hold_both_sides(spark):
    boxes = spark.createDataFrame([("s", "b1", "3", "slur", "1.5", "matched", "left"), ("s", "b2", "4", "tie", "", "xml_missing", None), ("s", "b3", "5", "clef", "2", "candidate", "right")],
                                  "score_id string, bbox_id string, class_id string, class string, start_meas string, alignment_status string, hint string")
    events = spark.createDataFrame([("s", f"e{i}", "note", f"c{i}", f"{i}.25", i, "p.xml") for i in range(1, 5)],
                                   "score_id string, xml_event_id string, event_type string, class string, start_meas string, page int, source_xml_path string")
    links = spark.createDataFrame([("b1", "e3", False), ("b1", "e2", True), ("b1", "e1", False), ("b1", "e2", True), ("b3", "e3", True)], "bbox_id string, xml_event_id string, is_primary boolean")
    out = R.combine_rows(boxes, events, links)
    assert out.columns[:13] == S.OFFICIAL and out.columns[13:20] == ["record_id", "row_origin", "combined_status", "source_alignment_status", "xml_event_ids_json", "xml_event_count", "xml_events_json"]
    got = {r["record_id"]: r for r in out.collect()}
    assert sorted(got) == ["b1", "b2", "b3", "e4"]
    one = got["b1"]
    assert (one["row_origin"], one["combined_status"], one["class"], one["start_meas"], one["hint"], one["xml_event_count"]) == ("yolo", "aligned", "slur", "1.5", "left", 4)
    assert json.loads(one["xml_event_ids_json"]) == ["e2", "e2", "e1", "e3"] and [e["page"] for e in json.loads(one["xml_events_json"])] == [2, 2, 1, 3]
    assert (one["event_xml_event_id"], one["event_page"], one["event_event_type"]) == ("e2", 2, "note")
    assert (got["b2"]["combined_status"], got["b2"]["xml_event_ids_json"], got["b2"]["xml_event_count"], got["b2"]["event_xml_event_id"]) == ("yolo_only", "[]", 0, None)
    assert (got["b3"]["combined_status"], got["b3"]["source_alignment_status"], got["b3"]["event_xml_event_id"]) == ("candidate", "candidate", "e3")
    lone = got["e4"]
    assert (lone["row_origin"], lone["combined_status"], lone["class"], lone["start_meas"], lone["xml_page"], lone["target_type"], lone["xml_path"], lone["score_id"], lone["hint"]) == ("xml", "xml_only", "c4", "4.25", 4, "note", "p.xml", "s", None)
    assert json.loads(lone["xml_events_json"])[0]["xml_event_id"] == "e4" and lone["event_page"] == 4
    # nothing of the boxes has changed
    assert Q.expect_unchanged(boxes, out.where("row_origin = 'yolo'"), ["bbox_id"], ["class", "start_meas", "hint"]).isEmpty()


def test_decisions_move_targets(spark):
    base = {c: "1" for c in S.SEMANTIC}
    rows = spark.createDataFrame([("p", i, 3, "slur", *base.values(), "1", "review", "m", "10", "20", "30", "40") for i in range(1, 5)],
                                 "page_id string, yolo_line int, class_id int, class string, " + ", ".join(f"{c} string" for c in base) + ", xml_staff string, status string, match_source string, target_x_px string, target_y_px string, end_target_x_px string, end_target_y_px string")
    d = spark.createDataFrame([("p", 1, "correct", "11", "21", "", "", "", ""), ("p", 2, "correct", "11", "21", "12", "NA", "33", "44"), ("p", 3, "confirm", "11", "21", "12", "22", "33", "44")],
                              "page_id string, yolo_line int, action string, review_target_x_px string, review_target_y_px string, review_start_target_x_px string, review_start_target_y_px string, review_end_target_x_px string, review_end_target_y_px string")
    d = d.withColumns({c: F.lit("2") for c in [*S.SEMANTIC, "staff", "comment"]} | {c: F.lit(None).cast("string") for c in ("corrected_class_id", "corrected_class")})
    out, _ = V.apply_decisions(rows, d)
    got = {r.yolo_line: (r.target_x_px, r.target_y_px, r.end_target_x_px, r.end_target_y_px, r.start_meas) for r in out.collect()}
    assert got == {1: ("11", "21", "30", "40", "2"), 2: ("12", "21", "33", "44", "2"), 3: ("10", "20", "30", "40", "1"), 4: ("10", "20", "30", "40", "1")}


def _span_event(i, kind, sub, marker, anchor, page=1, number=None):
    return ("s", f"e{i}", i, kind, sub, sub, "1", "1", page, "1", float(i), float(i), None, None, 60 if kind == "note" else None, {"type": marker, **({"number": number} if number else {})} if marker else {}, [anchor] if anchor else [])


SPE = "score_id string, xml_event_id string, seq int, event_type string, event_subtype string, class string, voice string, staff string, page int, xml_measure string, start_meas double, end_meas double, start_note int, end_note int, midi_pitch int, attributes map<string,string>, anchors array<string>"


def test_spans(spark):
    ev = [_span_event(i, "note", "note", None, None, page=1 if i < 3 else 2) for i in range(1, 5)]
    ev += [_span_event(11, "notation", "slur", "start", "e1", 1, "1"), _span_event(14, "notation", "slur", "stop", "e4", 2, "1")]
    n = 20
    for a, mark in (("e1", "start"), ("e2", "stop"), ("e3", "start"), ("e4", "stop")):  # each tie is coded twice
        for sub in ("tie", "tied"):
            ev.append(_span_event(n, "notation", sub, mark, a))
            n += 1
    ev += [_span_event(40, "direction", "wedge", "crescendo", None), _span_event(41, "notation", "slur", "continue", "e1"), _span_event(42, "direction", "octave-shift", "stop", None)]
    got = [(r["span_type"], r["status"], r["cross_page"]) for r in P.build_spans(spark.createDataFrame(ev, SPE)).collect()]
    want = [("slur", "paired", True), ("tie", "paired", False), ("tie", "paired", False), ("wedge", "start_without_stop", None), ("octave-shift", "stop_without_start", None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_performance_order(spark):
    occ = lambda *t: json.dumps([{"start_meas": str(x), "repeat_occurrence": i + 1} for i, x in enumerate(t)])
    boxes = spark.createDataFrame([("b", occ(1, 8), "0")], "bbox_id string, repeat_occurrences_json string, start_meas string")
    events = spark.createDataFrame([("e", occ(4, 9), "0")], "xml_event_id string, repeat_json string, start_meas string")
    got = FL.performance_order(boxes, events).select(F.col("start_meas").cast("double").alias("t"), "record_id").orderBy("t").collect()
    assert [(r["t"], r["record_id"]) for r in got] == [(1, "b"), (4, "e"), (8, "b"), (9, "e")]


def test_layout_counter_corner(spark):
    d = spark.createDataFrame([("d", 1, False, True), ("d", 2, False, False), ("d", 3, False, True), ("d", 4, True, False)], "k string, i int, new_page boolean, new_system boolean")
    got = W.layout_counters(d, ["k"], ["i"]).orderBy("i").collect()
    assert [(r["page"], r["system"]) for r in got] == [(0, 1), (1, 1), (1, 2), (2, 1)]


def test_label_files(spark, tmp_path):
    (tmp_path / "p-01.txt").write_text("18 0.2 0.3 0.1 0.1\n\n3 1 2\r\n7 0.5 0.5 0.1 0.2\n")
    (tmp_path / "cat.json").write_text(json.dumps({"categories": [{"id": 18, "name": "old"}, {"id": 7, "name": "tie"}, {"id": 18, "name": "slur"}]}))
    boxes, bad = SF.read_labels(spark, str(tmp_path / "p-01.txt"), SF.read_categories(spark, str(tmp_path / "cat.json")))
    assert sorted((r["page_id"], r["yolo_line"], r["class"]) for r in boxes.collect()) == [("p-01", 1, "slur"), ("p-01", 4, "tie")]
    assert [(r["yolo_line"], r["fields"]) for r in bad.collect()] == [(3, 3)]


def test_csv_sources(spark, tmp_path):
    (tmp_path / "n.csv").write_text("﻿start_meas;end_meas;pitch\n1.5;2;60\n2.5;3;61\n", encoding="utf-8")
    got = SF.read_positional_csv(spark, str(tmp_path / "n.csv"), "note_id long, start_meas double, end_meas double, pitch int, grace int").orderBy("note_id").collect()
    assert [(r["score_id"], r["note_id"], r["start_meas"], r["pitch"], r["grace"]) for r in got] == [("n", 0, 1.5, 60, None), ("n", 1, 2.5, 61, None)]
    (tmp_path / "a_human_review.csv").write_text("page_id,yolo_line,note_id\np,1,5\n")
    (tmp_path / "b_human_review.csv").write_text('yolo_line,page_id,note_ids,comment\n2,p,236+237+238,"x, y"\n1,p,9,dup\n,p,1,none\n')
    h = SF.read_heterogeneous_csv(spark, [str(tmp_path / f"{c}_human_review.csv") for c in "ab"])
    truth, err = V.normalize_truth(h)
    got = {r["yolo_line"]: (r["expected_start_note"], r["expected_end_note"], r["expected_connected_note"], r["comment"]) for r in truth.collect()}
    assert got == {"1": ("5", "5", '["5"]', ""), "2": ("236", "238", '["236","237","238"]', "x, y")}
    assert sorted((r["rule"], r["detail"]) for r in err.collect()) == [("duplicate_key", "p:Y1"), ("missing_key", "b_human_review.csv:4")]
    t = SF.read_table(spark, str(tmp_path / "b_human_review.csv"), "page_id string, yolo_line int, absent double")
    assert {(r["page_id"], r["yolo_line"], r["absent"]) for r in t.collect()} == {("p", 2, None), ("p", 1, None), ("p", None, None)}


def test_json_sources_and_inventory(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"overrides": {"pg": {"2": {"xml_page": 3, "xml_systems": [1, 2], "mapping_status": "merged"}}}}))
    assert [(r["page_id"], r["scan_system"], r["xml_systems"]) for r in SF.read_overrides(spark, str(tmp_path / "o.json")).collect()] == [("pg", 2, [1, 2])]
    (tmp_path / "f.json").write_text(json.dumps({"reviewer": "u", "recorded_date": "d", "source": "s", "entries": [
        {"sample_id": "S1", "bbox_id": "b1", "resolution_status": "resolved_by_user", "corrected_note_ids": [4], "corrected_xml_event_ids": ["e"], "corrected_start_meas": "2.5", "user_correction": {"pitch": "C4"}},
        {"sample_id": "S2", "bbox_id": "zz", "resolution_status": "resolved", "corrected_note_ids": [4], "corrected_xml_event_ids": ["e"]},
        {"sample_id": "S3", "bbox_id": "b3", "resolution_status": "resolved", "apply_to_audit": False}]}))
    fb = SF.read_feedback(spark, str(tmp_path / "f.json"))
    audit = spark.createDataFrame([("S1", "b1"), ("S2", "b2"), ("S3", "b3")], "sample_id string, bbox_id string")
    rev, log, err = V.apply_feedback(audit, fb)
    assert {r["sample_id"]: r["decision"] for r in rev.collect()} == {"S1": "corrected", "S2": None, "S3": None}
    assert [(r["sample_id"], r["corrected_start_meas"], r["corrected_pitch"]) for r in log.collect()] == [("S1", "2.5", "C4")]
    assert [(r["rule"], r["detail"]) for r in err.collect()] == [("bbox_mismatch", "S2")]
    inv = SF.file_inventory(spark, str(tmp_path), "*.json", hash=True).collect()
    assert len(inv) == 2 and all(len(r["sha256"]) == 64 for r in inv)


def test_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 9), ("b", 2, 9)], "page_id string, v int, extra int")
    SK.write_table(df, ["page_id", "v"], str(tmp_path / "t"), ["page_id"])
    SK.write_table(df.where("v = 2").withColumn("v", F.lit(5)), ["page_id", "v"], str(tmp_path / "t"), ["page_id"])
    assert {(r["page_id"], r["v"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", 1), ("b", 5)}


def test_ledger_second_run_does_nothing(spark, tmp_path):
    src = spark.createDataFrame([("u1", 1), ("u1", 2), ("u2", 3)], "unit_id string, v int")
    out, led = str(tmp_path / "out"), str(tmp_path / "led")
    m = I.unit_digest(src, ["unit_id"], ["v"], "1")
    empty = spark.createDataFrame([], "unit_id string, digest string, version string, status string, row_count long")
    build = lambda d: d.withColumn("w", F.col("v") * 2)
    assert I.run_pending(I.pending(m, empty, version="1"), src, build, out, led, "1") == 2
    assert I.run_pending(I.pending(m, I.latest(spark.read.parquet(led)), version="1"), src, build, out, led, "1") == 0
    src2 = src.unionByName(spark.createDataFrame([("u2", 4)], src.schema))
    todo = I.pending(I.unit_digest(src2, ["unit_id"], ["v"], "1"), I.latest(spark.read.parquet(led)), version="1")
    assert [(r["unit_id"], r["reason"]) for r in todo.collect()] == [("u2", "stale")]
    assert I.run_pending(todo, src2, build, out, led, "1") == 1
    assert spark.read.parquet(out).count() == 4
    scores = src.withColumnRenamed("unit_id", "score_id")
    args = (lambda d: d, str(tmp_path / "so"), str(tmp_path / "sl"), "1")
    assert I.prepare_score(scores, args[0], None, *args[1:]) == 2
    assert I.prepare_score(scores, args[0], I.latest(spark.read.parquet(args[2])), *args[1:]) == 0


def test_stream_takes_new_files_once(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "o"), str(tmp_path / "c")
    df = spark.createDataFrame([(1,), (2,)], "v int")
    for _ in range(2):
        df.write.mode("append").parquet(src)
        I.stream_units(spark, src, df.schema, lambda d: d, out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 4


def test_decisions_all_or_nothing(spark):
    cols = "page_id string, yolo_line string, class_id string, class string, start_meas string, end_meas string, start_note string, end_note string, connected_note string, stem_dir string, xml_staff string, status string, match_source string"
    rows = spark.createDataFrame([("p", str(i), "1", "slur", "1.0", "2.0", "3", "4", "[3, 4]", "", "1", "review", "m") for i in range(4)], cols)
    dcols = "page_id string, yolo_line string, action string, start_meas string, end_meas string, start_note string, end_note string, connected_note string, stem_dir string, staff string, corrected_class_id string, corrected_class string, comment string"
    ok = [("p", "0", "correct", "1.5", "2.0", "3", "4", "3+4", "", "1", "", "", ""), ("p", "1", "not_a_symbol", *[""] * 10), ("p", "2", "reject", *[""] * 10)]
    d = spark.createDataFrame(ok, dcols)
    assert V.validate_decisions(rows, d).count() == 0
    out, log = V.apply_decisions(rows, d)
    got = {r["yolo_line"]: (r["start_meas"], r["alignment_status"], r["human_approved"]) for r in out.collect()}
    assert got == {"0": ("1.5", "matched", "true"), "2": ("", "unresolved", "false"), "3": ("1.0", "ambiguous", "false")}
    assert log.count() == 3
    bad = spark.createDataFrame(ok + [("p", "9", "confirm", *[""] * 10), ("p", "3", "fly", *[""] * 10)], dcols)
    err = V.validate_decisions(rows, bad)
    assert sorted(r["rule"] for r in err.collect()) == ["invalid_action", "unknown_row"]
    assert V.gate(out, err).count() == 0


def test_nest_members_refuses_large_groups(spark):
    m = A.collect_members(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, id int"), ["k"], ["id"], "id")
    assert {r["k"]: list(r["members"]) for r in A.nest_members(m, ["k"], "id").collect()} == {"a": [1, 2], "b": [3]}
    with pytest.raises(Exception, match="too large"):
        A.nest_members(m, ["k"], "id", limit=1).collect()


def test_incomplete_groups_are_reported(spark):
    d = spark.createDataFrame([("k", 1, 3, True), ("k", 2, 3, False), ("k", 3, 3, False), ("k", 4, 3, True)], "k string, i int, n int, start boolean")
    full, bad = A.take_next_n(d, ["k"], ["i"], "n", F.col("start"), "i")
    assert sorted((r["start_id"], r["member_id"]) for r in full.collect()) == [(1, 1), (1, 2), (1, 3)]
    assert [(r["start_id"], r["found"], r["expected"]) for r in bad.collect()] == [(4, 1, 3)]


def test_scalar_rules(spark):
    one = spark.range(1)
    row = one.select(
        X.parse_anchors(F.lit("1, 5;9")).alias("a"), X.parse_anchors(F.lit("5 5")).alias("b"), X.page_number(F.lit("op_2-07")).alias("p"), G.printed_measure(F.lit(""), F.lit("12"), F.lit("13.5")).alias("m"),
        G.printed_measure(F.lit(""), F.lit("12"), F.lit("40.5")).alias("far"), C.threshold_for(F.lit("tupletBracket"), 0.1).alias("t"), X.natural_key(F.lit("p10")).alias("n10"), X.natural_key(F.lit("p2")).alias("n2")).first()
    assert row["a"]["anchors"] == [1, 5, 9] and row["b"]["error"] == "not_increasing" and row["p"] == 7
    assert (row["m"], row["far"], row["t"]) == ("13", "12", 0.6) and row["n2"] < row["n10"]
    with pytest.raises(ValueError):
        C.threshold_for(F.lit("x"), 0.1, {"slur": 1.5})


def test_page_alignment_keeps_every_box(spark):
    boxes = spark.createDataFrame([("p", 1, "dynamicF", 10, 12, 200, 100), ("p", 2, "articStaccatoAbove", 50, 8, 200, 100), ("p", 3, "barline", 60, 60, 200, 100), ("q", 4, "slur", 5, 5, 200, 100)],
                                  "page_id string, yolo_line int, class string, x long, y long, page_w int, page_h int")
    systems = spark.createDataFrame([("p", 1, 10.0), ("p", 2, 60.0), ("q", 1, 5.0)], "page_id string, system int, center double")
    dyn = spark.createDataFrame([("p", 1, "dynamicF", 7, 11.0, 1.0)], "page_id string, system int, class string, event_id int, x double, time double")
    tgt = spark.createDataFrame([("p", 1, "articulation", "staccato", 3, 52, 20, 200, 100)], "page_id string, system int, kind string, mark string, seq int, x long, y long, page_w int, page_h int")
    anc = spark.createDataFrame([("p", 1, 100, 12, 15), ("p", 2, 101, 70, 66)], "page_id string, system int, anchor_id int, x long, y long")
    got = {r["yolo_line"]: (r["match_source"], r["target"]) for r in FL.align_pages(boxes, systems, dyn, tgt, anc, bits=8).collect()}
    assert got == {1: ("musicxml_dynamic", 7), 2: ("musicxml_staccato", 3), 3: ("geometric_nearest_anchor_time_estimate", 101), 4: ("no_musicxml_anchor", None)}


def test_repeat_map_flow(spark):
    def notes(*steps):
        return spark.createDataFrame([("s", i, 0, st, 0, 4, "1", False, False) for i, st in enumerate(steps)], "score_id string, measure int, seq int, step string, alter int, octave int, staff string, is_chord boolean, is_grace boolean")

    out = FL.repeat_map(notes("A", "B", "C", "D"), notes("A", "B", "C", "B", "C", "D")).orderBy("pos").collect()
    assert [(r["mapped"], r["repeat_occurrence"], r["repeat_group_id"]) for r in out] == [(0, 1, None), (1, 1, "R01"), (2, 1, "R01"), (1, 2, "R01"), (2, 2, "R01"), (3, 1, None)]


def test_review_round(spark):
    c = spark.createDataFrame([("b1", "yolo", "candidate", "0.960", "slur", "s", "p", "1", ["e1"]), ("b2", "yolo", "candidate", "0.900", "slur", "s", "p", "2", ["e2"]), ("b3", "yolo", "ambiguous", "0.990", "slur", "s", "p", "3", ["e3"]),
                               ("b4", "yolo", "candidate", "0.999", "fingering1", "s", "p", "4", ["e4"])],
                              "bbox_id string, row_origin string, combined_status string, confidence string, class string, score_id string, page_id string, yolo_line string, xml_event_ids array<string>")
    links = spark.createDataFrame([("b1", "m", 1)], "bbox_id string, link_method string, link_rank int")
    assets = spark.createDataFrame([(f"b{i}", "x", "ready") for i in range(1, 5)], "bbox_id string, batch_id string, asset_status string")
    master = spark.createDataFrame([(f"b{i}", "direct", "in_bpsd_scope", "") for i in range(1, 5)], "bbox_id string, page_mapping_status string, movement_scope_status string, error_code string")
    out = FL.review_round(c, links, assets, master)
    assert [r["bbox_id"] for r in out["queue"].orderBy("priority_rank").collect()] == ["b3", "b2", "b1", "b4"]
    p = out["proposals"].collect()
    assert [(r["bbox_id"], r["audit_sampled"]) for r in p] == [("b1", True)]
    assert sorted(r["bbox_id"] for r in out["manual"].collect()) == ["b2", "b3", "b4"]
