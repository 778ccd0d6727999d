"""Optimal assignment in numpy, exact in whole numbers, for groups that are small by nature (boxes of a frame, tracks of a
video). Every solution comes with prices that prove it and is the first of all that are as good."""

from __future__ import annotations

from collections import deque

import numpy as np

#: Shares such as IoU are weighed in billionths, so sums are exact and equal totals are equal everywhere.
UNIT = 1_000_000_000


def units(share: np.ndarray) -> np.ndarray:
    return np.rint(np.asarray(share, float) * UNIT).astype(np.int64)


def _augmented(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner of each column or -1, row prices, column prices) for no more rows than columns: rows are added one at a
    time, each along a shortest augmenting path in reduced costs."""
    n, m = w.shape
    top = w.max()
    cost = top - w
    u, v = np.zeros(n, np.int64), np.zeros(m, np.int64)
    owner, far = np.full(m, -1), np.iinfo(np.int64).max
    for row in range(n):
        dist, came, done = cost[row] - u[row] - v, np.full(m, row), np.zeros(m, bool)
        while True:
            j = int(np.where(done, far, dist).argmin())
            done[j] = True
            if owner[j] < 0:
                break
            i = owner[j]
            step = dist[j] + cost[i] - u[i] - v
            better = ~done & (step < dist)
            dist[better], came[better] = step[better], i
        end, path = j, dist[j]
        for k in np.flatnonzero(done):
            if k != end:
                u[owner[k]] += path - dist[k]
                v[k] -= path - dist[k]
        u[row] += path
        while True:
            i = came[j]
            last = np.flatnonzero(owner == i)
            owner[j] = i
            if i == row:
                break
            j = int(last[last != j][0])
    a, b = top - u, -v
    low = b.min()  # a column without an owner has price 0
    return owner, a + low, b - low


def priced_assignment(weight: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """(pairs, row prices, column prices) of the assignment of largest total for whole-number weights, none negative.

    Pairs have a positive weight; each row and column is in one at most. Prices are whole numbers, none negative:
    those of a pair add up to its weight, no weight exceeds the prices of its row and column, and what is unpaired
    costs nothing. So the prices' sum is the total, and no assignment can have more. Of several assignments with that
    total it is the one in which the first row has the first column it can have (rather one than none), then the second.
    """
    w = np.asarray(weight, np.int64)
    if not w.size:
        return [], np.zeros(w.shape[0], np.int64), np.zeros(w.shape[1], np.int64)
    if w.shape[0] > w.shape[1]:
        owner, b, a = _augmented(w.T)
        pairs = {r: int(c) for r, c in enumerate(owner) if c >= 0 and w[r, c] > 0}
    else:
        owner, a, b = _augmented(w)
        pairs = {int(r): c for c, r in enumerate(owner) if r >= 0 and w[r, c] > 0}
    tight = (w > 0) & (a[:, None] + b[None] == w)
    if tight.sum() > len(pairs):
        pairs = _first_of_equals(tight, a, b, pairs)
    return sorted(pairs.items()), a, b


def _first_of_equals(tight: np.ndarray, a: np.ndarray, b: np.ndarray, pairs: dict[int, int]) -> dict[int, int]:
    """Of the assignments that the prices allow, the first in order.

    Each row has a stand-in column, which it may have if it costs nothing, and each column a stand-in row; so every
    allowed assignment is a full one, and a row changes to a column along an alternating cycle of what isn't settled.
    """
    n, m = tight.shape
    col = np.empty(n + m, int)
    for i in range(n):
        col[i] = pairs.get(i, m + i)
    used = {j: i for i, j in pairs.items()}
    for j in range(m):
        col[n + j] = m + used[j] if j in used else j
    row = np.empty(n + m, int)
    row[col] = np.arange(n + m)
    settled = np.zeros(n + m, bool)
    stand_ins = list(range(m, m + n))

    def may(r: int) -> list[int]:
        if r < n:
            return [*np.flatnonzero(tight[r]).tolist(), *([m + r] if a[r] == 0 else [])]
        return [*([r - n] if b[r - n] == 0 else []), *stand_ins]

    for i in range(n):
        for j in np.flatnonzero(tight[i]).tolist():
            if settled[j]:
                continue
            goal = int(col[i])
            if goal == j:
                break
            came, queue = {}, deque([int(row[j])])
            seen = settled.copy()
            seen[j] = True
            while queue and goal not in came:
                r = queue.popleft()
                for c in may(r):
                    if not seen[c]:
                        seen[c] = True
                        came[c] = r
                        queue.append(int(row[c]))
            if goal in came:
                c = goal
                while True:
                    r = came[c]
                    before, col[r], row[c] = int(col[r]), c, r
                    if before == j:
                        break
                    c = before
                col[i], row[j] = j, i
                break
        settled[col[i]] = True
    return {i: int(col[i]) for i in range(n) if col[i] < m}


def max_assignment(share: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of :func:`priced_assignment` for shares, weighed in billionths."""
    return priced_assignment(units(share))[0]
