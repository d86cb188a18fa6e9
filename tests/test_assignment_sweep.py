"""Blocks whose rows are near in order: the sweep gives what shortest paths give, without a search per row."""

import random

import pytest

from annolink.operators import assignment as A


def band(rnd, n, width, costs, holes=0.0):
    place = list(range(n))
    rnd.shuffle(place)  # the order of the right ids is not that of the band
    return {(i, place[j]): rnd.randrange(costs) for i in range(n) for j in range(max(0, i - width), min(n, i + width + 1)) if rnd.random() >= holes}


def solve(e):
    return A.least_cost([i for i, _ in e], [j for _, j in e], e.values())


def test_sweep_equals_shortest_paths(monkeypatch):
    rnd = random.Random(5)
    blocks = [band(rnd, rnd.randrange(1, 30), rnd.randrange(1, 4), rnd.choice([1, 3, 50]), 0.1) for _ in range(300)]
    swept = [solve(e) for e in blocks if e]
    assert any(swept) and not all(swept)
    monkeypatch.setattr(A, "_sweep", lambda cost: None)
    assert [solve(e) for e in blocks if e] == swept


@pytest.mark.parametrize("n", [2_000, 20_000])
def test_long_band_needs_no_search(monkeypatch, n):
    """Costs as in mt_11: a paths search goes on through much of the band for every row."""
    monkeypatch.setattr(A, "heappush", None)
    rnd = random.Random(n)
    left, right = [rnd.randrange(1_000_000) for _ in range(n)], sorted(rnd.randrange(1_000_000) for _ in range(n))
    e = {(i, j): abs(left[i] - right[j]) for i in range(n) for j in range(max(0, i - 2), min(n, i + 3))}
    got = solve(e)
    assert sorted(j for _, j, _ in got) == list(range(n)) and sum(c for *_, c in got) <= sum(e[i, i] for i in range(n))


def test_wide_blocks_are_left_to_paths():
    rnd = random.Random(2)
    assert A._sweep([{j: rnd.randrange(9) for j in range(40)} for _ in range(40)]) is None
    assert A._sweep([{0: 1}, {0: 1, 1: 2}, {1: 1}]) == []
