"""Least-cost assignment of one block: tie rule against all permutations, and a block too large for ranks in the costs."""

import itertools
import random

from annolink.operators.assignment import least_cost


def test_equals_all_permutations():
    rnd = random.Random(3)
    for _ in range(300):
        n = rnd.randrange(1, 6)
        e = {(i, j): rnd.randrange(rnd.choice([1, 3, 50])) for i in range(n) for j in range(n) if rnd.random() < 0.7}
        every = [(sum(e[p] for p in enumerate(q)), q) for q in itertools.permutations(range(n)) if all(p in e for p in enumerate(q))]
        sides = {i for i, _ in e}, {j for _, j in e}
        if every and len(sides[0]) == n == len(sides[1]):
            assert least_cost([i for i, _ in e], [j for _, j in e], e.values()) == [(i, j, e[i, j]) for i, j in enumerate(min(every)[1])]


def test_large_block_of_equal_costs():
    n = 20_000  # ranks below one cost unit would be numbers of (n + 1) ** n
    edges = [(i, j) for i in range(n) for j in (i - 1, i, i + 1) if 0 <= j < n]
    got = least_cost([i for i, _ in edges], [j for _, j in edges], [7] * len(edges))
    assert got == [(i, i, 7) for i in range(n)]
