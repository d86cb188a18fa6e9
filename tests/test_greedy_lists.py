"""Greedy matching from short lists: equal rows, rows on several search keys, lists that end too soon."""

import random

import pytest

from annolink.operators.matching import greedy_l1, greedy_match
from annolink.operators.nearest import Axis


@pytest.mark.parametrize("n_left, n_right", [(40, 25), (25, 40)])
def test_short_lists_give_the_one_by_one_result(spark, n_left, n_right):
    rnd = random.Random(n_left)
    left = [(1, s, i, rnd.randrange(4) * 3, rnd.randrange(3)) for i in range(n_left) for s in rnd.sample([1, 2], rnd.choice([1, 2]))]
    right = [(1, s, i, rnd.randrange(4) * 3, rnd.randrange(3)) for i in range(n_right) for s in rnd.sample([1, 2], rnd.choice([1, 2]))]
    pairs = sorted((2 * abs(a[3] - b[3]) + 3 * abs(a[4] - b[4]), a[2], b[2]) for a in left for b in right if a[1] == b[1])
    want, used_left, used_right = set(), set(), set()
    for cost, i, j in pairs:
        if i not in used_left and j not in used_right:
            used_left.add(i)
            used_right.add(j)
            want.add((i, j, cost))
    frames = spark.createDataFrame(left, "k int, s int, a int, x long, y long"), spark.createDataFrame(right, "k int, s int, b int, x long, y long")
    axes = [Axis("y", "y", 3, 4)]
    got = greedy_l1(*frames, ["k"], ["s"], "a", "b", "x", "x", 2, axes, axes, k=2).collect()
    assert {(r.a, r.b, r.cost) for r in got} == want and len(got) == len(want)


def test_chains_are_taken_in_one_pass_or_in_rounds(spark):
    # every edge waits for the one before it: a round each, but one pass of a task
    chain = [(b, i // 2, (i + 1) // 2, i) for b in (1, 2) for i in range(60)] + [(1, None, 3, 0), (2, 3, None, 0)]
    edges = spark.createDataFrame(chain, "b int, l long, r long, c long")
    want = {(b, i, i, 2 * i) for b in (1, 2) for i in range(30)}
    got = {n: {(r.b, r.l, r.r, r.c) for r in greedy_match(edges, ["b"], "l", "r", "c", in_task=n).collect()} for n in (60, 1_000_000)}
    assert got[60] == got[1_000_000] == want
    rnd = random.Random(5)
    edges = spark.createDataFrame([(rnd.randrange(12), rnd.randrange(12), rnd.randrange(6)) for _ in range(90)], "l long, r long, c long")
    two = [sorted(tuple(r) for r in greedy_match(edges, [], "l", "r", "c", in_task=n).select("l", "r", "c").collect()) for n in (0, 1_000)]
    assert two[0] == two[1]
