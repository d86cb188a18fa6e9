"""Greedy one-to-one choice between members of two kinds of groups, from the best pair of groups down (used inside a task)."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np


class Side:
    """Members of one side by number; a member may be in several groups."""

    def __init__(self):
        self.groups, self.numbers = [], []

    def add(self, groups, numbers) -> None:
        self.groups.append(groups)
        self.numbers.append(numbers)

    def close(self) -> None:
        groups, numbers = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (self.groups, self.numbers))
        order = np.lexsort((numbers, groups))
        self.ids, start = np.unique(groups[order], return_index=True)
        self.at, self.end = start.tolist(), [*start[1:].tolist(), len(groups)]
        self.numbers, rank = np.unique(numbers[order], return_inverse=True)
        self.rank = rank.tolist()
        self.used, self.alive = bytearray(len(self.numbers)), np.ones(len(self.ids), bool)

    def head(self, i: int) -> int:
        """Rank of the first free member of a group, -1 where there is none."""
        p, end = self.at[i], self.end[i]
        while p < end and self.used[self.rank[p]]:
            p += 1
        self.at[i] = p
        if p == end:
            self.alive[i] = False
            return -1
        return self.rank[p]

    def take(self, i: int) -> int:
        """Number of the head of a group, which is used from now on."""
        rank = self.rank[self.at[i]]
        self.used[rank] = 1
        return int(self.numbers[rank])


class InOrder:
    """Pairs of members are ordered by (1 - score, left member, right member) and taken one by one.

    Members of a group have equal pairs, so only pairs of groups come in, by falling score. Where one pair of groups
    has a cost for itself, its free members are taken side by side; pairs of groups of equal cost are taken together.
    """

    def __init__(self):
        self.left, self.right, self.level, self.cost, self.out, self.open = Side(), Side(), [], None, [], True

    def pairs(self, a, b, score) -> None:
        """The next pairs of groups."""
        if self.open:
            self.open = False
            self.left.close()
            self.right.close()
        left, right = self.left, self.right
        i, j = np.searchsorted(left.ids, a), np.searchsorted(right.ids, b)
        live = np.flatnonzero(left.alive[i] & right.alive[j])
        for x, y, s, c in zip(i[live].tolist(), j[live].tolist(), score[live].tolist(), (1 - score[live]).tolist()):
            if c != self.cost:
                self.flush()
                self.cost = c
            if left.alive[x] and right.alive[y]:
                self.level.append((x, y, s))

    def flush(self) -> None:
        """Takes what the pairs of the last cost allow."""
        level, self.level = self.level, []
        left, right = self.left, self.right
        if len(level) == 1:
            x, y, s = level[0]
            while left.head(x) >= 0 and right.head(y) >= 0:
                self.keep(x, y, s)
            return
        links = {}
        for x, y, s in level:
            links.setdefault(x, []).append((y, s))
        heap = [(r, x) for x in links if (r := left.head(x)) >= 0]
        heapify(heap)
        while heap:
            rank, x = heappop(heap)
            if left.head(x) != rank:
                if left.alive[x]:
                    heappush(heap, (left.head(x), x))
                continue
            same = [x]
            while heap and heap[0][0] == rank:
                same.append(heappop(heap)[1])
            best = None
            for g in same:
                links[g] = [(y, s) for y, s in links[g] if right.head(y) >= 0]
                for y, s in links[g]:
                    best = min(best or (right.head(y), g, y, s), (right.head(y), g, y, s))
            if best:
                self.keep(*best[1:])
            for g in same:
                # a group without free members on the other side leaves the level
                if links[g] and (r := left.head(g)) >= 0:
                    heappush(heap, (r, g))

    def keep(self, x: int, y: int, score: float) -> None:
        self.out.append((int(self.left.ids[x]), int(self.right.ids[y]), score, self.left.take(x), self.right.take(y)))

    def chosen(self) -> list[tuple]:
        """(left group, right group, score, left member, right member) taken since the last call."""
        out, self.out = self.out, []
        return out
