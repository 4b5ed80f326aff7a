"""Searches from many vertices inside tasks that each hold the links of a graph of bounded size.

Sources are dealt to the tasks, so nothing of a search is shuffled or stored but its sums. `graph_search`
uses these up to LINKS links and VERTICES vertices; larger graphs are searched level by level with shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

# Links and vertices of a graph that a task may hold, and values (64 bits) of a search in one array.
LINKS, VERTICES, VALUES = 1 << 24, 1 << 20, 1 << 22
# Rows of a column below which the rest of long lists is merged list by list.
LEAST_ROWS = 64
# A product over chosen lists costs about so much more for each link than one over all of them.
CHOSEN = 6


class Lists:
    """The values of every key; `columns` holds the first value of all keys, then the second, longest lists first."""

    def __init__(self, n: int, key: np.ndarray, value: np.ndarray):
        self.n, self.values = n, value[np.argsort(key, kind="stable")]
        self.count = np.bincount(key, minlength=n)
        self.start = np.r_[0, np.cumsum(self.count)]
        self.order = np.argsort(-self.count, kind="stable")
        most = self.count[self.order]
        self.columns = []
        rows = int(np.count_nonzero(most))
        while rows >= LEAST_ROWS:
            self.columns.append(self.values[self.start[self.order[:rows]] + len(self.columns)])
            rows = int(np.searchsorted(-most, -len(self.columns)))
        self.long = self.order[:rows]

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position among the keys, value) of all values of the keys."""
        k = self.count[keys]
        at = np.repeat(np.arange(len(keys)), k)
        return at, self.values[np.arange(len(at)) + np.repeat(self.start[keys] - np.r_[0, np.cumsum(k)[:-1]], k)]

    def merged(self, x: np.ndarray, merge: np.ufunc) -> np.ndarray:
        """For every key the rows of x named by its values, merged."""
        y, got = np.zeros_like(x), np.empty_like(x)
        for ends in self.columns:
            part = got[: len(ends)]
            np.take(x, ends, axis=0, out=part, mode="clip")
            merge(y[: len(ends)], part, out=y[: len(ends)])
        for i, key in enumerate(self.long):
            tail = self.values[self.start[key] + len(self.columns) : self.start[key + 1]]
            for a in range(0, len(tail), self.n):
                y[i] = merge(y[i], merge.reduce(x[tail[a : a + self.n]], axis=0))
        got[self.order] = y
        return got


def product(send: Lists, take: Lists, rows: np.ndarray, x: np.ndarray, wanted: np.ndarray, merge: np.ufunc) -> tuple[np.ndarray | slice, np.ndarray]:
    """(vertices, what they get) when `rows` send their rows of x along their links.

    Vertices outside `wanted` may be left out. `take` holds the same links as `send` by their ends.
    """
    out, into = send.count[rows].sum(), take.count[wanted].sum()
    if min(out, into) * CHOSEN >= len(take.values):
        full = np.zeros((take.n, x.shape[1]), x.dtype)
        full[rows] = x
        return slice(None), take.merged(full, merge)
    if out <= into:
        at, to = send.of(rows)
        order = np.argsort(to, kind="stable")
        at, to = at[order], to[order]
    else:
        place = np.full(take.n, -1)
        place[rows] = np.arange(len(rows))
        at, came = take.of(wanted)
        to, at = wanted[at], place[came]
        to, at = to[at >= 0], at[at >= 0]
    if not len(to):
        return np.zeros(0, np.int64), np.zeros((0, x.shape[1]), x.dtype)
    first = np.diff(to, prepend=-1) != 0
    found, group = to[first], np.cumsum(first) - 1
    y = np.zeros((len(found), x.shape[1]), x.dtype)
    step = max(1, VALUES // x.shape[1])
    for a in range(0, len(to), step):
        g = group[a : a + step]
        starts = np.flatnonzero(np.diff(g, prepend=-1) != 0)
        y[g[starts]] = merge(y[g[starts]], merge.reduceat(x[at[a : a + step]], starts, axis=0))
    return found, y


def width(n: int, k: int, tasks: int) -> int:
    """Values a vertex holds in a search from k sources by so many tasks."""
    return max(1, min(VALUES // max(n, 1), 256, -(-k // tasks)))


def distances(out: Lists, into: Lists, v: np.ndarray, slot: np.ndarray, wide: int, sums: np.ndarray) -> None:
    """Add (reached, total, far) of a search from vertices v, each with its own bit, to the rows of `sums`."""
    new = np.zeros((out.n, wide), np.uint64)
    np.bitwise_or.at(new, (v, slot // 64), np.uint64(1) << (slot % 64).astype(np.uint64))
    seen, every = new.copy(), np.bitwise_or.reduce(new, axis=0)
    rows = np.unique(v)
    x, depth = new[rows], 0
    wanted = np.flatnonzero((seen != every).any(1))
    while len(rows) and len(wanted):
        depth += 1
        t, y = product(out, into, rows, x, wanted, np.bitwise_or)
        y &= ~seen[t]
        seen[t] |= y
        gained = np.bitwise_count(y).sum(1, dtype=np.int64)
        sums[0][t] += gained
        sums[1][t] += depth * gained
        some = np.flatnonzero(gained)
        rows, x = (some if isinstance(t, slice) else t[some]), y[some]
        sums[2][rows] = np.maximum(sums[2][rows], depth)
        wanted = wanted[(seen[wanted] != every).any(1)]


def paths(out: Lists, into: Lists, v: np.ndarray, slot: np.ndarray, wide: int, sums: np.ndarray) -> None:
    """As `distances`, one value a source: path counts go out, pair dependencies (Brandes 2001) come back."""
    n = out.n
    dist, sigma = np.full((n, wide), -1, np.int32), np.zeros((n, wide))
    dist[v, slot], sigma[v, slot] = 0, 1
    rows = np.unique(v)
    left, levels, x = (dist < 0).sum(1), [rows], sigma[rows]
    while len(rows):
        wanted = np.flatnonzero(left)
        if not len(wanted):
            break
        t, y = product(out, into, rows, x, wanted, np.add)
        was = dist[t]
        y[was >= 0] = 0
        new = y > 0
        was[new] = len(levels)
        dist[t] = was
        sigma[t] += y
        gained = new.sum(1)
        left[t] -= gained
        some = np.flatnonzero(gained)
        rows, x = (some if isinstance(t, slice) else t[some]), y[some]
        sums[0][t] += gained
        sums[1][t] += len(levels) * gained
        sums[2][rows] = np.maximum(sums[2][rows], len(levels))
        if len(rows):
            levels.append(rows)
    delta = np.zeros((n, wide))
    for d in range(len(levels) - 1, 1, -1):
        rows, wanted = levels[d], levels[d - 1]
        here = dist[rows] == d
        x = np.where(here, (1 + delta[rows]) / np.where(here, sigma[rows], 1), 0)
        t, y = product(into, out, rows, x, wanted, np.add)
        delta[t] += np.where(dist[t] == d - 1, sigma[t] * y, 0)
    sums[3] += np.where(dist > 0, delta, 0).sum(1)


def search(kind: Callable, n: int, a: np.ndarray, b: np.ndarray, directed: bool, v: np.ndarray, at: np.ndarray, wide: int, batches: range) -> list[np.ndarray]:
    """Sums for each vertex over batches of sources v, numbered `at`, along links from a to b."""
    out = Lists(n, a, b)
    into = Lists(n, b, a) if directed else out
    sums = [np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)]
    batch = wide * 64 if kind is distances else wide
    for i in batches:
        mine = (at >= i * batch) & (at < (i + 1) * batch)
        kind(out, into, v[mine], at[mine] - i * batch, wide, sums)
    return sums
