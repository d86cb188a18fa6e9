"""Span matching on shapes: the choice between members of groups, several passes, and crowds of equal rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolink.operators import spans as S
from annolink.operators.inorder import InOrder
from annolink.operators.matching import expand_segments
from test_spans import BOX, SPAN, SYSTEM, pages, plain


def test_groups_equal_the_choice_one_by_one():
    rnd = random.Random(1)
    for _ in range(500):
        sides = [{(rnd.randrange(n), rnd.randrange(g)) for _ in range(n + 1)} for n, g in ((rnd.randrange(1, 9), rnd.randrange(1, 5)) for _ in "lr")]
        score = {(a, b): rnd.choice([0.5, 0.6, 0.7]) for a in {g for _, g in sides[0]} for b in {g for _, g in sides[1]} if rnd.random() < 0.7}
        lefts, rights, want = set(), set(), set()
        for _, l, r in sorted((1 - score[g, h], l, r) for l, g in sides[0] for r, h in sides[1] if (g, h) in score):
            if l not in lefts and r not in rights:
                lefts.add(l)
                rights.add(r)
                want.add((l, r))
        order = InOrder()
        for side, rows in zip((order.left, order.right), sides):
            for member, group in rows:
                side.add(np.array([group]), np.array([member]))
        edges = sorted(((a, b, v) for (a, b), v in score.items()), key=lambda e: -e[2])
        while edges:  # equal costs go over the ends of batches
            n = rnd.randrange(1, 4)
            order.pairs(*(np.array(c) for c in zip(*edges[:n])))
            edges = edges[n:]
        order.flush()
        assert {(l, r) for *_, l, r in order.chosen()} == want


@pytest.mark.parametrize("claim, k", [("segment", 0.5), ("span", 0.1)])
def test_several_passes_equal_the_plain_model(spark, monkeypatch, claim, k):
    floors, down_to = [], S._down_to
    monkeypatch.setattr(S, "_down_to", lambda *a: floors.append(down_to(*a)) or floors[-1])
    boxes, spans, systems = pages(5, 40, 20, [6.0, 10.0])
    boxes += [(*b[:2], b[2] + 2000, *b[3:]) for b in boxes[::3]]
    spans += [(s[0], s[1] + 500, *s[2:]) for s in spans[::2]]
    frames = spark.createDataFrame(boxes, BOX), spark.createDataFrame(spans, SPAN), spark.createDataFrame(systems, SYSTEM)
    got = S.match_spans(*frames, claim=claim, k=k, least=1).collect()
    want = plain(boxes, spans, systems, claim)
    assert {(r.page_id, r.yolo_line, r.span_id, r.system, r.segment_type, round(r.confidence, 9), r.mutual_best, r.box_best, r.status) for r in got} == want
    assert floors and floors[0] > 0.42


def test_a_line_of_two_systems_is_one_box(spark):
    boxes = spark.createDataFrame([("p", 1, 7, 200.0, 80.0, 100.0), ("p", 2, 7, 200.0, 281.0, 100.0)], BOX)
    spans = spark.createDataFrame([("p", 1, 1, 1, 150.0, 115.0, 250.0, 115.0, "over", True), ("p", 2, 2, 2, 150.0, 315.0, 250.0, 315.0, "over", True)], SPAN)
    systems = spark.createDataFrame([("p", 1, 0.0, 1000.0, 100.0, 10.0), ("p", 2, 0.0, 1000.0, 300.0, 10.0)], SYSTEM)
    assert [(r.yolo_line, r.span_id) for r in S.match_spans(boxes, spans, systems).collect()] == [(7, 1)]


def test_equal_rows_are_looked_at_once(spark, monkeypatch):
    """3,000 boxes in one place and 2,000 segments in two: 6,000,000 pairs of rows, 2 pairs of shapes."""
    boxes = spark.range(3000).select(F.lit("p").alias("page_id"), F.lit(1).alias("system"), F.col("id").cast("int").alias("yolo_line"),
                                     F.lit(200.0).alias("center_x"), F.lit(80.0).alias("center_y"), F.lit(100.0).alias("width_px"))
    wide = F.when(F.col("id") % 2 == 0, 50.0).otherwise(40.0)
    spans = spark.range(2000).select(F.lit("p").alias("page_id"), F.col("id").cast("int").alias("span_id"), F.lit(1).alias("start_system"), F.lit(1).alias("end_system"), (200 - wide).alias("x0"),
                                     F.lit(115.0).alias("y0"), (200 + wide).alias("x1"), F.lit(115.0).alias("y1"), F.lit("over").alias("orientation"), F.lit(True).alias("confirmed"))
    systems = spark.createDataFrame([("p", 1, 0.0, 1e4, 100.0, 10.0)], SYSTEM)
    seen, score = [], S.segment_score
    monkeypatch.setattr(S, "segment_score", lambda df: seen.append(score(df)) or seen[-1])
    rows = sorted((r.yolo_line, r.span_id) for r in S.match_spans(boxes, spans, systems).collect())
    assert rows == [(i, 2 * i) for i in range(1000)] + [(1000 + i, 2 * i + 1) for i in range(1000)]
    assert max(df.count() for df in seen) == 2
