"""Span matching against a plain page-by-page model, its candidate pairs, and the whole page alignment."""

import math
import random

import pytest
from pyspark.sql import functions as F

from annolink.operators.spans import match_spans, span_edges
from annolink.plans import flows as FL

BOX = "page_id string, system int, yolo_line int, center_x double, center_y double, width_px double"
SPAN = "page_id string, span_id int, start_system int, end_system int, x0 double, y0 double, x1 double, y1 double, orientation string, confirmed boolean"
SYSTEM = "page_id string, system int, x_left double, x_right double, upper_center double, staff_spacing double"


def agreement(box, seg):
    cx, cy, w = box
    x0, x1, ya, yb, sp, under = seg
    span, sp = max(8.0, abs(x1 - x0)), max(1.0, sp)
    lift = min(max(sp * 1.1, span * 0.38), sp * 3.5)
    edge = max(ya, yb) if under else min(ya, yb)
    wrong = max(0.0, edge - cy if under else cy - edge)
    goal = edge + lift if under else edge - lift
    xe = abs(cx - (x0 + x1) / 2) / max(18.0, span * 0.35)
    ye = abs(cy - goal) / (sp * 2.0)
    return 0.42 * math.exp(-0.5 * xe * xe) + 0.28 * math.exp(-abs(math.log(max(0.05, w / span))) / 0.65) + 0.23 * math.exp(-0.5 * ye * ye) + 0.07 * math.exp(-wrong / sp)


def segments(spans, systems):
    place = {(s[0], s[1]): s for s in systems}
    for page, span, a, b, x0, y0, x1, y1, side, confirmed in spans:
        for n in range(min(a, b), max(a, b) + 1):
            if (page, n) in place:
                _, _, left, right, upper, sp = place[page, n]
                kind = "full" if a == b else "start" if n == a else "end" if n == b else "middle"
                p = x0 if kind in ("full", "start") else left
                q = x1 if kind in ("full", "end") else right
                ya = y0 if kind in ("full", "start") else y1 if kind == "end" else upper
                yb = y1 if kind in ("full", "end") else y0 if kind == "start" else upper
                yield page, span, n, kind, confirmed, (min(p, q), max(p, q), ya, yb, sp, side == "under")


def plain(boxes, spans, systems, claim):
    segs, out = list(segments(spans, systems)), set()
    for page in {b[0] for b in boxes}:
        score = {}
        for _, n, line, *shape in (b for b in boxes if b[0] == page):
            for p, span, m, kind, confirmed, seg in segs:
                if p == page and m == n:
                    score[line, (span, m)] = (agreement(shape, seg), kind, confirmed)
        used_box, used = set(), set()
        for cost, line, seg in sorted((1 - v[0], k[0], k[1]) for k, v in score.items()):
            own = seg if claim == "segment" else seg[0]
            if line in used_box or own in used or 1 - cost < 0.42:
                continue
            used_box.add(line)
            used.add(own)
            value, kind, confirmed = score[line, seg]
            ranked = sorted(((-v[0], s) for (b, s), v in score.items() if b == line))
            second = -ranked[1][0] if len(ranked) > 1 else 0.0
            mutual = min((1 - v[0], b) for (b, s), v in score.items() if s == seg)[1] == line
            conf = min(0.99, 1 - cost)
            ok = confirmed and conf >= 0.82 and conf - second >= 0.12 and mutual and ranked[0][1] == seg and kind == "full"
            out.add((page, line, seg[0], seg[1], kind, round(conf, 9), mutual, ranked[0][1] == seg, "matched" if ok else "review"))
    return out


def pages(seed, n_boxes, n_spans, sizes):
    rnd = random.Random(seed)
    systems, boxes, spans = [], [], []
    for page in "pq":
        systems += [(page, n, 50.0, 950.0, 100.0 * n, rnd.choice(sizes)) for n in (1, 2, 3)]
        for i in range(n_spans):
            a = rnd.choice([1, 2, 3])
            b = rnd.choice([a, a, a, min(4, a + 1), 1])
            x0 = rnd.uniform(60, 900)
            x1 = x0 + rnd.choice([3, 30, 90, 200, 400])
            spans.append((page, i, a, b, x0, 100.0 * a + rnd.uniform(-40, 40), x1, 100.0 * b + rnd.uniform(-40, 40), rnd.choice(["under", "over"]), rnd.random() < 0.8))
        for i in range(n_boxes):
            _, _, a, _, x0, y0, x1, *_ = rnd.choice([s for s in spans if s[0] == page])
            boxes.append((page, a, i, (x0 + x1) / 2 + rnd.gauss(0, 30), y0 + rnd.gauss(0, 25), max(1.0, (x1 - x0) * rnd.uniform(0.5, 1.8))))
        # equal boxes: the smaller line wins
        boxes.append((*boxes[-1][:2], 1000, *boxes[-1][3:]))
    return boxes, spans, systems


@pytest.mark.parametrize("claim", ["segment", "span"])
def test_equals_the_plain_model(spark, claim):
    boxes, spans, systems = pages(8, 40, 14, [6.0, 10.0, 22.0])
    frames = spark.createDataFrame(boxes, BOX), spark.createDataFrame(spans, SPAN), spark.createDataFrame(systems, SYSTEM)
    got = match_spans(*frames, claim=claim)
    want = plain(boxes, spans, systems, claim)
    assert {(r.page_id, r.yolo_line, r.span_id, r.system, r.segment_type, round(r.confidence, 9), r.mutual_best, r.box_best, r.status) for r in got.collect()} == want
    assert {"matched", "review"} == {w[-1] for w in want} and {"full", "start"} <= {w[4] for w in want}


def test_edges_are_all_pairs_from_the_floor_on(spark):
    boxes, spans, systems = pages(3, 150, 60, [0.5, 5.0, 10.0, 40.0])
    boxes += [("p", 1, 2000, None, 1.0, 1.0), ("p", 1, 2001, 100.0, 100.0, 0.0), ("p", 1, 2002, float("nan"), 1.0, 1.0)]
    from annolink.operators.matching import expand_segments

    segs = expand_segments(spark.createDataFrame(spans, SPAN), spark.createDataFrame(systems, SYSTEM), ["page_id"])
    got = span_edges(spark.createDataFrame(boxes, BOX), segs, ["page_id"])
    want = {}
    for page, n, line, *shape in boxes:
        for p, span, m, _, _, seg in segments(spans, systems):
            if (p, m) == (page, n) and None not in shape and shape[0] == shape[0] and agreement(shape, seg) >= 0.42:
                want[page, line, span, m] = agreement(shape, seg)
    rows = got.collect()
    assert len(rows) == len(want) and {(r.page_id, r.yolo_line, r.span_id, r.system) for r in rows} == set(want)
    assert all(abs(r.score - want[r.page_id, r.yolo_line, r.span_id, r.system]) < 1e-12 for r in rows)
    with pytest.raises(ValueError):
        span_edges(spark.createDataFrame(boxes, BOX), segs, ["page_id"], floor=0.3)


def test_one_system_with_very_many_boxes(spark):
    """A third of all rows in one system: pairs that are far apart in both ways are not formed."""
    n = 20_000
    boxes = spark.range(n).select(F.lit("p").alias("page_id"), F.lit(1).alias("system"), F.col("id").cast("int").alias("yolo_line"), (F.col("id") * 400).cast("double").alias("center_x"),
                                  (F.col("id") % 7 * 1000).cast("double").alias("center_y"), F.lit(100.0).alias("width_px"))
    spans = spark.range(n).select(F.lit("p").alias("page_id"), F.col("id").cast("int").alias("span_id"), F.lit(1).alias("start_system"), F.lit(1).alias("end_system"), (F.col("id") * 400 - 50).cast("double").alias("x0"),
                                  F.lit(0.0).alias("y0"), (F.col("id") * 400 + 50).cast("double").alias("x1"), F.lit(0.0).alias("y1"), F.lit("over").alias("orientation"), F.lit(True).alias("confirmed"))
    spans = spans.withColumns({"y0": F.col("span_id") % 7 * 1000 + 35.0, "y1": F.col("span_id") % 7 * 1000 + 35.0}).where("span_id % 2857 = 0")
    systems = spark.createDataFrame([("p", 1, 0.0, 1e7, 0.0, 10.0)], SYSTEM)
    from annolink.operators.matching import expand_segments

    rows = span_edges(boxes, expand_segments(spans, systems, ["page_id"]), ["page_id"], floor=0.7).collect()
    assert sorted((r.yolo_line, r.span_id) for r in rows) == [(i * 2857, i * 2857) for i in range(8) if i * 2857 < n]


def test_whole_page_alignment(spark):
    boxes = [("p", 1, "dynamicF", 10, 102, 8), ("p", 2, "articStaccatoAbove", 50, 98, 4), ("p", 3, "barline", 60, 300, 2), ("p", 4, "slur", 200, 80, 100), ("p", 5, "slur", 600, 120, 60),
             ("p", 6, "tie", 400, 101, 40), ("p", 7, "tuplet3", 300, 90, 30), ("p", 8, "tuplet5", 500, 90, 30), ("p", 9, "fingering3", 700, 90, 5), ("p", 10, "fingering1", 20, 90, 5), ("q", 11, "slur", 5, 5, 9)]
    boxes = spark.createDataFrame([(*b, 1000, 400) for b in boxes], "page_id string, yolo_line int, class string, x long, y long, w long, page_w int, page_h int")
    systems = spark.createDataFrame([("p", 1, 100.0, 0.0, 1000.0, 100.0, 10.0), ("p", 2, 300.0, 0.0, 1000.0, 300.0, 10.0), ("q", 1, 5.0, 0.0, 1000.0, 5.0, 10.0)],
                                    "page_id string, system int, center double, x_left double, x_right double, upper_center double, staff_spacing double")
    dyn = spark.createDataFrame([("p", 1, "dynamicF", 77, 11.0, 1.0)], "page_id string, system int, class string, event_id int, x double, time double")
    tgt = spark.createDataFrame([("p", 1, "articulation", "staccato", 33, 52, 110, 1000, 400)], "page_id string, system int, kind string, mark string, seq int, x long, y long, page_w int, page_h int")
    anc = spark.createDataFrame([("p", 1, 100, 12, 105), ("p", 2, 101, 70, 306)], "page_id string, system int, anchor_id int, x long, y long")
    spans = spark.createDataFrame([("p", 40, 1, 1, 150.0, 115.0, 250.0, 115.0, "over", True), ("p", 41, 1, 2, 560.0, 90.0, 90.0, 300.0, "under", True)], SPAN)
    ties = spark.createDataFrame([("p", 60, 1, 1, 380, 101, 420, 101, True, 1000, 400)], "page_id string, tie_id int, start_system int, end_system int, x0 long, y0 long, x1 long, y1 long, confirmed boolean, page_w int, page_h int")
    tup = spark.createDataFrame([("p", 1, 70, 3, 301.0, 91.0, 1000, 400)], "page_id string, system int, group_id int, actual_notes int, mean_x double, mean_y double, page_w int, page_h int")
    fin = spark.createDataFrame([("p", 9, 90, 0.96, "grouped_nearest", "inferred"), ("p", 10, None, None, None, "unmatched")], "page_id string, yolo_line int, note_id int, confidence double, match_source string, status string")
    got = {r.yolo_line: (r.match_source, r.target, r.status) for r in FL.align_pages(boxes, systems, dyn, tgt, anc, 11, spans, ties, tup, fin).collect()}
    near = "geometric_nearest_anchor_time_estimate"
    assert got == {1: ("musicxml_dynamic", 77, "matched"), 2: ("musicxml_staccato", 33, "matched"), 3: (near, 101, "review"), 4: ("musicxml_slur_full_endpoint_candidate", 40, "matched"),
                   5: ("musicxml_slur_start_endpoint_candidate", 41, "review"), 6: ("musicxml_tie_endpoints", 60, "matched"), 7: ("musicxml_tuplet", 70, "review"), 8: (near, 100, "review"), 9: ("grouped_nearest", 90, "inferred"), 10: (near, 100, "review"),
                   11: ("no_musicxml_anchor", None, "unmatched")}


@pytest.mark.parametrize("claim", ["segment", "span"])
@pytest.mark.parametrize("n_boxes", [60, 12])
def test_lists_that_end_too_soon_ask_again(spark, claim, n_boxes):
    boxes, spans, systems = pages(11, n_boxes, 16, [6.0, 10.0])
    frames = spark.createDataFrame(boxes, BOX), spark.createDataFrame(spans, SPAN), spark.createDataFrame(systems, SYSTEM)
    short, long = (sorted(map(str, match_spans(*frames, claim=claim, k=k).collect())) for k in (1, 1000))
    assert short == long and short
