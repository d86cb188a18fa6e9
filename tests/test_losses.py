"""Inputs on which rows were once lost or merged."""

import pytest

from annolink.operators.matching import rank_with_locks
from annolink.operators.joins import lookup_one_near
from annolink.operators.matching import allocate_groups
from annolink.operators.nearest import Axis, nearest_l1
from annolink.operators.pairing import pair_ties
from annolink.sources.files import read_positional_csv


def test_ties_with_unknown_voices(spark):
    df = spark.createDataFrame([("k", 1, 1, None, "start"), ("k", 2, 2, None, "stop"), ("m", 1, 3, "1", "start"), ("m", 2, 4, None, "start"), ("m", 3, 5, None, "stop")],
                               "k string, t int, id bigint, voice string, kind string")
    got = {(r.k, r.start_id, r.end_id, r.status) for r in pair_ties(df, ["k"], ["t", "id"], "id", "voice").collect()}
    assert got == {("k", 1, 2, "paired"), ("m", 4, 5, "paired"), ("m", 3, None, "tie_start_without_stop")}


def test_coordinates_outside_the_axis_raise(spark):
    left = spark.createDataFrame([("k", 1, 100, 10)], "k string, id bigint, x int, y int")
    right = spark.createDataFrame([("k", 1, 5000, 10), ("k", 2, 100, 1500)], "k string, id bigint, x int, y int")
    with pytest.raises(Exception, match="tick outside"):
        nearest_l1(left, right, ["k"], "id", "id", "x", "x", 1, [Axis("y", "y", 1, 10)]).collect()
    assert nearest_l1(left, right, ["k"], "id", "id", "x", "x", 100, [Axis("y", "y", 1, 13)]).first().near.id == 2


def test_group_at_the_edge_of_its_reach(spark):
    groups = spark.createDataFrame([("p", 1, 7, 171.9, 10.0, "1", [(10.0, 1)])],
                                   "page_id string, system int, group_id bigint, x double, y double, preferred_staff string, boxes array<struct<y:double,yolo_line:bigint>>")
    chords = spark.createDataFrame([("p", 1, 5, "1", 0.0, 344.5, [(10.0, 3)])],
                                   "page_id string, system int, chord_id bigint, staff string, time double, x double, notes array<struct<y:double,note_id:bigint>>")
    assert [r.note_id for r in allocate_groups(groups, chords, 1440.0).collect()] == [3]


def test_blank_lines_and_quoted_separators(spark, tmp_path):
    (tmp_path / "s.csv").write_text('a;b;pitch\n1;2;60\n\n2;3;"6;1"\n3;4;62\n')
    got = [(r.note_id, r.pitch) for r in read_positional_csv(spark, str(tmp_path / "s.csv"), "a int, b int, pitch string").orderBy("note_id").collect()]
    assert got == [(0, "60"), (1, "6;1"), (2, "62")]


def test_equal_left_rows_stay_apart(spark):
    left = spark.createDataFrame([("k", 5), ("k", 5), ("k", 90)], "k string, x int")
    right = spark.createDataFrame([("k", 6, 1)], "k string, x int, id bigint")
    got = sorted((r.x, r.matches, r.id) for r in lookup_one_near(left, right, ["k"], "x", "id", 1).select("x", "matches", "id").collect() if r.x < 50)
    assert got == [(5, 1, 1), (5, 1, 1)]


def test_rank_with_locks_runs_its_race_once(spark):
    """Boxes without a row are found in one pass; the race has two anti joins and is planned twice, before four times."""
    scored = spark.createDataFrame([(1, 7, 70, "full", 0.9), (2, 7, 70, "full", 0.5), (3, 8, 80, "full", 0.9), (4, 9, 90, "start", 0.3)], "box long, seg long, cand long, segment_type string, score double")
    reviews = spark.createDataFrame([(3, "matched", 80), (5, "scan", None)], "box long, match_status string, cand long")
    boxes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 6, None)], "box long")
    out = rank_with_locks(scored.where("score > 0"), reviews, boxes, [], "box", "seg", "cand", "score")
    want = [(None, "possible_scan_only"), (1, "high_confidence_candidate"), (2, "needs_review"), (3, "locked_xml_match"), (4, "possible_scan_only"), (5, "locked_scan_only"), (6, "possible_scan_only"), (6, "possible_scan_only")]
    assert sorted(((r.box, r.status) for r in out.collect()), key=str) == sorted(want, key=str)
    assert {r.box: r.reason for r in out.collect()}[6] == "no candidate in this system"
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftAnti") == 4
