"""Nearest points in the plane against plain sorting, crowds and far queries included."""

import random

import pytest

from annolink.operators import matching as M
from annolink.operators.plane import k_nearest, squared, weighted_l1

ROWS, POINTS = "g int, q int, x long, y long", "g int, p int, x long, y long"


def plain(rows, points, k, cost, ties):
    out = []
    for g, q, x, y in rows:
        if x is None or y is None:
            continue
        near = sorted((cost(abs(x - a), abs(y - b)), *((a, b) if ties else ()), p) for h, p, a, b in points if h == g and a is not None)
        out += [(g, q, i + 1, n[-1], n[0]) for i, n in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize("span", [6, 90, 5000])
@pytest.mark.parametrize("k", [1, 5])
def test_equal_to_sorting(spark, span, k):
    rnd = random.Random(span + k)
    rows = [(i % 2, i, rnd.randrange(-span, span), rnd.randrange(-span, span)) for i in range(25)] + [(0, 98, None, 3), (2, 99, 1, 1)]
    points = [(i % 2, i, rnd.randrange(-span, span), rnd.randrange(-span, span)) for i in range(70)] + [(0, 100 + i, 2, 2) for i in range(9)] + [(0, 200, None, 1)]
    a, b = spark.createDataFrame(rows, ROWS), spark.createDataFrame(points, POINTS)
    for cost, model, ties in ((squared, lambda dx, dy: dx * dx + dy * dy, ()), (weighted_l1(4, 3), lambda dx, dy: 4 * dx + 3 * dy, ("x", "y"))):
        got = k_nearest(a, b, ["g"], "q", "p", k, cost, ties=ties)
        assert sorted((r.g, r.q, r["rank"], r.p, r["cost"]) for r in got.collect()) == plain(rows, points, k, model, ties)


def test_no_points(spark):
    a = spark.createDataFrame([(0, 1, 5, 5)], ROWS)
    assert k_nearest(a, spark.createDataFrame([], POINTS), ["g"], "q", "p", 3, squared).count() == 0


def test_far_crowd(spark):
    side = 500
    points = spark.range(side * side).selectExpr("0 as g", "id as p", f"id % {side} as x", f"id div {side} as y")
    rows = spark.createDataFrame([(0, 1, 1 << 30, 7), (0, 2, -(1 << 30), -(1 << 29)), (0, 3, 250, 250)], ROWS)
    got = k_nearest(rows, points, ["g"], "q", "p", 64, weighted_l1(4, 3)).collect()
    assert [sum(r.q == q for r in got) for q in (1, 2, 3)] == [64, 64, 64]
    far = sorted((4 * ((1 << 30) - x) + 3 * abs(7 - y), y * side + x) for x in range(470, side) for y in range(side))[:64]
    assert sorted((r["cost"], r.p) for r in got if r.q == 1) == far


def test_candidate_lists_equal_sorting(spark):
    rnd = random.Random(5)
    rows = [(0, i, rnd.randrange(300), rnd.randrange(300)) for i in range(20)]
    points = [(0, i, rnd.choice([10, 11, rnd.randrange(300)]), rnd.randrange(40)) for i in range(150)]
    got = M.candidate_lists(spark.createDataFrame(rows, ROWS), spark.createDataFrame(points, POINTS), ["g"], "q", "p", 64)
    want = plain(rows, points, 64, lambda dx, dy: 4 * dx + 3 * dy, True)
    assert sorted((r.g, r.q, r["rank"], r.p, r["distance4"]) for r in got.collect()) == want
