"""Best paths through the tables of many pairs of sequences at once.

Cells of one antidiagonal depend only on earlier ones. Those of many pairs, whatever their lengths, go on side by side in flat
arrays, so a step of Python serves thousands of cells, however short the sequences are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Cells times states of the pairs that go together; a larger pair goes alone.
TOGETHER = 3 << 20


class Beside:
    """Places of many pairs: a row for each number of symbols read of x, with `before` empty rows ahead of each pair's."""

    def __init__(self, nx: np.ndarray, ny: np.ndarray, before: int):
        self.nx, self.ny = np.asarray(nx, np.int64), np.asarray(ny, np.int64)
        size = self.nx + 1 + before
        self.base = np.cumsum(size) - size + before
        self.of = np.repeat(np.arange(len(size)), size)
        self.u = np.arange(len(self.of)) - self.base[self.of]
        self.y_last = np.where(self.u < 0, -1, self.ny[self.of])
        self.y_base = np.cumsum(self.ny + 1) - (self.ny + 1)
        cells = (self.nx + 1) * (self.ny + 1)
        self.cells, self.cell_base = int(cells.sum()), np.cumsum(cells) - cells
        self.before = before

    def along_x(self, values: list[np.ndarray], none) -> np.ndarray:
        """By row: the values of each pair, one more than x has symbols."""
        gap = np.full(self.before, none)
        return np.concatenate([part for v in values for part in (gap, v)])

    def cell(self, pair: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return self.cell_base[pair] + u * (self.ny[pair] + 1) + v


def batches(sizes: np.ndarray, most: int = TOGETHER) -> Iterator[np.ndarray]:
    """Indices in order of size, together `most` in all, or one."""
    order = np.argsort(sizes, kind="stable")
    total, at = np.cumsum(np.asarray(sizes, np.int64)[order]), 0
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield order[at:end]
        at = end


def sweep(b: Beside, steps, start: np.ndarray, moves: np.ndarray, said: Callable, kinds: Callable | None, low, begin: np.ndarray, keep: bool):
    """Scores of all states at each pair's last cell, and: all back pointers if keep, else where each path first reached the middle.

    start (n), moves (classes, n, n): logarithms, `low` where there is none. said(state, rows, pairs, u, v): a state's emissions at cells;
    kinds(rows, pairs, u, v): for each state the class of its moves into the cells. begin: each pair's state before its first cell, or -1.
    """
    n, last, dtype = len(steps), b.nx + b.ny, moves.dtype
    reach = max(dx + dy for dx, dy in steps)
    ways = [[r for r in range(n) if (moves[:, r, s] > low).any()] or [0] for s in range(n)]
    order = np.argsort(last, kind="stable")
    ends, middle = last[order], last // 2
    small = np.int8 if n < 128 else np.int16
    scores = {0: np.full((n, len(b.u)), low, dtype)}
    inside = np.flatnonzero(begin >= 0)
    scores[0][begin[inside], b.base[inside]] = 0
    cross = {} if keep else {0: np.full((n, len(b.u)), -1, np.int64)}
    back = np.full((n, b.cells), -1, small) if keep else None
    final, where = np.full((len(last), n), low, dtype), np.full((len(last), n), -1, np.int64)

    def ended(t):
        done = order[np.searchsorted(ends, t, "left") : np.searchsorted(ends, t, "right")]
        final[done] = scores[t][:, b.base[done] + b.nx[done]].T
        if not keep:
            where[done] = cross[t][:, b.base[done] + b.nx[done]].T

    ended(0)
    for t in range(1, int(last.max(initial=0)) + 1):
        every = t - b.u
        rows = np.flatnonzero((every >= 0) & (every <= b.y_last))
        pair, u, v = b.of[rows], b.u[rows], every[rows]
        place = u * (b.ny[pair] + 1) + v
        at, half = b.cell_base[pair] + place, middle[pair]
        scores[t] = np.full((n, len(b.u)), low, dtype)
        if not keep:
            cross[t] = np.full((n, len(b.u)), -1, np.int64)
        classes = None if kinds is None else kinds(rows, pair, u, v)
        for s, (dx, dy) in enumerate(steps):
            d, source = dx + dy, rows - dx
            if d > t:
                continue
            # Cells that the table does not have are in rows that hold `low`.
            value = come = None
            for r in ways[s]:
                way = scores[t - d][r][source] + (moves[0, r, s] if classes is None else moves[:, r, s][classes[r]])
                if value is None:
                    value, come = way, np.full(len(rows), r, small)
                else:
                    come[way > value] = r
                    value = np.maximum(value, way)
            if t == d:
                # The only cell before is the beginning, which no state has reached.
                first = np.flatnonzero((begin < 0) & (b.nx >= dx) & (b.ny >= dy))
                first = np.searchsorted(rows, b.base[first] + dx)
                value[first], come[first] = start[s], -1
            scores[t][s][rows] = np.maximum(np.maximum(value, low) + said(s, rows, pair, u, v), low)
            if keep:
                back[s][at] = come
            else:
                crossing = (half <= t) & (half > t - d)
                cross[t][s][rows] = np.where(crossing, place * n + s, cross[t - d][come, source])
        ended(t)
        scores.pop(t - reach, None)
        cross.pop(t - reach, None)
    return final, back if keep else where


def traced(b: Beside, steps, back: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Each pair's states from its first cell to its last, where it ends in state `end`; none for -1."""
    dx, dy = (np.array([s[k] for s in steps], np.int64) for k in (0, 1))
    u, v, s = b.nx.copy(), b.ny.copy(), np.asarray(end, np.int64).copy()
    live = np.flatnonzero((s >= 0) & (u + v > 0))
    who, said = [live[:0]], [live[:0]]
    while len(live):
        now = s[live]
        who.append(live)
        said.append(now)
        s[live] = back[now, b.cell(live, u[live], v[live])]
        u[live] -= dx[now]
        v[live] -= dy[now]
        live = live[u[live] + v[live] > 0]
    who, said = np.concatenate(who)[::-1], np.concatenate(said)[::-1]
    return np.split(said[np.argsort(who, kind="stable")], np.cumsum(np.bincount(who, minlength=len(u)))[:-1])
