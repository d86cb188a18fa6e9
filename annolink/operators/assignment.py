"""Least-cost perfect matching of one block (used inside a task)."""

from __future__ import annotations

from heapq import heappop, heappush


def least_cost(lefts, rights, costs):
    """Assignment by shortest augmenting paths over exact integers; [] when no perfect matching exists.

    Among equal totals the answer that gives the first left row the smallest right row wins,
    then the second, and so on: the potentials leave the edges that any optimal answer can use,
    and among these each left row in turn takes the smallest right row that the rest can spare.
    Where rows near in order share their right rows, a sweep over the rows finds the same answer in linear time.
    """
    ls, rs = sorted(set(lefts)), sorted(set(rights))
    n = len(ls)
    if n != len(rs):
        return []
    li, ri = {v: i for i, v in enumerate(ls)}, {v: i for i, v in enumerate(rs)}
    cost = [{} for _ in range(n)]
    for l, r, c in zip(lefts, rights, costs):
        cost[li[l]][ri[r]] = int(c)
    if (swept := _sweep(cost)) is not None:
        return [(ls[i], rs[j], cost[i][j]) for i, j in enumerate(swept)]
    u, v = [min(row.values()) for row in cost], [0] * n
    mate, owner = [-1] * n, [-1] * n
    for start in range(n):
        # distances from start; a column's owner goes on at the column's distance
        best, came, done, heap = {}, {}, [], []
        row, base, free = start, 0, -1
        while True:
            for j, c in cost[row].items():
                d = base + c - u[row] - v[j]
                if j not in best or d < best[j]:
                    best[j], came[j] = d, row
                    # free columns first among equals: the path ends there
                    heappush(heap, (d, owner[j] >= 0, j))
            while heap and heap[0][0] > best[heap[0][2]]:
                heappop(heap)
            if not heap:
                return []
            base, taken, j = heappop(heap)
            if not taken:
                free = j
                break
            done.append(j)
            row = owner[j]
        u[start] += base
        for j in done:
            u[owner[j]] += base - best[j]
            v[j] -= base - best[j]
        j = free
        while j >= 0:
            row = came[j]
            owner[j], mate[row], j = row, j, mate[row]
    tight = [sorted(j for j, c in row.items() if c == u[i] + v[j]) for i, row in enumerate(cost)]
    users = [[] for _ in range(n)]
    for i, row in enumerate(tight):
        for j in row:
            users[j].append(i)
    for i in range(n):
        for j in tight[i]:
            if j == mate[i]:
                break
            if owner[j] > i and (path := _swap(owner[j], mate[i], i, tight, users, mate, owner)):
                # every row on the path moves to the next column, the last one to what i leaves
                for row, col in path:
                    mate[row], owner[col] = col, row
                mate[i], owner[j] = j, i
                break
    return [(ls[i], rs[j], cost[i][j]) for i, j in enumerate(mate)]


def _sweep(cost, wide=4096, states=1_000_000):
    """Right row of each left row by the same rule, [] when no perfect matching exists, None where the sweep is too wide.

    From the last left row to the first: for each set of the right rows in reach (those with rows on both sides) that
    the later rows can take, what this costs at least. A right row leaves the sets at its first left row, taken.
    """
    n = len(cost)
    first, last = {}, {}
    for i, row in enumerate(cost):
        for j in row:
            first.setdefault(j, i)
            last[j] = i
    begin, end = [[] for _ in range(n)], [[] for _ in range(n)]
    for j in first:
        begin[first[j]].append(j)
        end[last[j]].append(j)
    bit, spare, used = {}, [], 0
    for i in range(n):
        for j in begin[i]:
            if not spare:
                spare.append(1 << used)
                used += 1
            bit[j] = spare.pop()
        spare += [bit[j] for j in end[i]]
    after, now, seen = [None] * n, {0: 0}, 0
    leave = [sum(bit[j] for j in b) for b in begin]
    for i in range(n - 1, -1, -1):
        after[i], must, before = now, leave[i], {}
        for j, c in cost[i].items():
            one = bit[j]
            for taken, least in now.items():
                if not taken & one and (taken | one) & must == must:
                    key = (taken | one) ^ must
                    if key not in before or least + c < before[key]:
                        before[key] = least + c
        now = before
        seen += len(now)
        if not now:
            return []
        if len(now) > wide or seen > states:
            return None
    taken, out = 0, []
    for i in range(n):
        have, least = taken | leave[i], now[taken]
        for j in sorted(cost[i]):
            if have & bit[j] and (rest := after[i].get(have ^ bit[j])) is not None and rest + cost[i][j] == least:
                break
        out.append(j)
        taken, now = have ^ bit[j], after[i]
    return out


def _swap(first, goal, fixed, tight, users, mate, owner):
    """(row, new column) for rows after `fixed`, from `first` to the column `goal`; None where there is no way.

    Sought from both ends in turn, so a small dead end on either side ends it.
    """
    ahead, back = {first: None}, {goal: None}

    def way(row, col):
        path, r, c = [], row, col
        while r is not None:
            path.append((r, c))
            c, r = mate[r], ahead[r]
        while col != goal:
            path.append((owner[col], back[col]))
            col = back[col]
        return path

    front, rear = [first], [goal]
    while front and rear:
        step = []
        for row in front:
            for col in tight[row]:
                if col in back and col != mate[row]:
                    return way(row, col)
                nxt = owner[col]
                if nxt > fixed and nxt not in ahead:
                    ahead[nxt] = row
                    step.append(nxt)
        front, step = step, []
        for col in rear:
            for row in users[col]:
                if row in ahead and mate[row] != col:
                    return way(row, col)
                if row > fixed and mate[row] not in back:
                    back[mate[row]] = col
                    step.append(mate[row])
        rear = step
    return None
