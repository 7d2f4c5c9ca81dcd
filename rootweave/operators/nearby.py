"""Work on the points of one key inside a task: nearest segments, greedy matches.  Plain
functions over NumPy arrays; ``match`` deals keys out to tasks.  Neither lists all pairs."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np

from rootweave.functions.geometry import SHORTEST

#: Points of a tile.
TILE = 64
#: Pairs that a greedy match looks at together.
PAIRS = 500_000


def tiles(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of points by strips along y, and where each tile of it begins."""
    per = TILE * max(1, int(np.ceil(np.sqrt(len(x) / TILE))))
    order = np.argsort(x, kind="stable")
    return order[np.lexsort((y[order], np.arange(len(x)) // per))], np.arange(0, len(x), TILE)


def nearest(x, y, x0, y0, x1, y1):
    """``(k, d, px, py, t)`` of every point: the nearest segment, of equally near ones that
    of the smallest index, its distance, the nearest place and where that lies on it.

    Points and segments lie in tiles, segments by size.  A tile of points looks at tiles
    of segments from the nearest on, until what is left is farther than what it has."""
    places, which = np.unique(np.column_stack([x, y]), axis=0, return_inverse=True)
    which = which.ravel()
    px, py = places[:, 0], places[:, 1]
    size = np.maximum(np.hypot(x1 - x0, y1 - y0), SHORTEST)
    kind = np.ceil(np.log2(size) / 2)
    order, begins, n = [], [], 0
    for level in np.unique(kind):
        rows = np.flatnonzero(kind == level)
        o, b = tiles((x0[rows] + x1[rows]) / 2, (y0[rows] + y1[rows]) / 2)
        order.append(rows[o])
        begins.append(b + n)
        n += len(rows)
    order, begins = np.concatenate(order), np.concatenate(begins)
    ends = np.append(begins[1:], n)
    low = lambda a, b: np.minimum.reduceat(np.minimum(a, b)[order], begins)
    high = lambda a, b: np.maximum.reduceat(np.maximum(a, b)[order], begins)
    bx0, by0, bx1, by1 = low(x0, x1), low(y0, y1), high(x0, x1), high(y0, y1)
    best = np.full(len(px), np.inf)
    found = np.zeros(len(px), np.int64)
    at = np.zeros((3, len(px)))
    own, starts = tiles(px, py)
    for start in starts:
        rows = own[start : start + TILE]
        ux, uy = px[rows], py[rows]
        far = np.hypot(np.maximum(np.maximum(bx0 - ux.max(), ux.min() - bx1), 0), np.maximum(np.maximum(by0 - uy.max(), uy.min() - by1), 0))
        far *= 1 - 1e-9
        asked, took, many = np.argsort(far, kind="stable"), 0, 2
        while took < len(asked):
            some = asked[took : took + many]
            some = some[far[some] <= best[rows].max()]
            if not len(some):
                break
            took, many = took + many, min(2 * many, 64)
            s = np.sort(np.concatenate([order[begins[k] : ends[k]] for k in some]))
            dx, dy = x1[s] - x0[s], y1[s] - y0[s]
            t = np.clip(((ux[:, None] - x0[s]) * dx + (uy[:, None] - y0[s]) * dy) / (size[s] * size[s]), 0, 1)
            qx, qy = x0[s] + t * dx, y0[s] + t * dy
            d = np.hypot(ux[:, None] - qx, uy[:, None] - qy)
            k = d.argmin(axis=1)
            line = np.arange(len(rows))
            d, new = d[line, k], s[k]
            up = (d < best[rows]) | ((d == best[rows]) & (new < found[rows]))
            to = rows[up]
            best[to], found[to] = d[up], new[up]
            at[:, to] = qx[line, k][up], qy[line, k][up], t[line, k][up]
    return found[which], best[which], at[0][which], at[1][which], at[2][which]


def rounded(d: np.ndarray, digits: int | None) -> np.ndarray:
    return d if digits is None else np.floor(d * 10.0**digits + 0.5) / 10.0**digits


class Grid:
    """Points by cells of a width, to find those around others."""

    def __init__(self, x, y, width: float):
        self.x0, self.y0, self.width = x.min(), y.min(), width
        cx, cy = self.cell(x, y)
        self.wide, self.high = cx.max(), cy.max() + 1
        code = cx * self.high + cy
        self.order = np.argsort(code, kind="stable")
        self.code = code[self.order]

    def cell(self, x, y):
        return np.floor((x - self.x0) / self.width).astype(np.int64), np.floor((y - self.y0) / self.width).astype(np.int64)

    def ranges(self, x, y):
        """Begin and end in ``order`` of what lies in the three columns of cells around."""
        cx, cy = self.cell(x, y)
        lo, hi = np.clip(cy - 1, 0, self.high), np.clip(cy + 1, -1, self.high - 1)
        begin, end = [], []
        for k in (-1, 0, 1):
            none = (cx + k < 0) | (cx + k > self.wide) | (lo > hi)
            begin.append(np.searchsorted(self.code, np.where(none, -1, (cx + k) * self.high + lo), "left"))
            end.append(np.searchsorted(self.code, np.where(none, -1, (cx + k) * self.high + hi), "right"))
        return np.column_stack(begin), np.column_stack(end)


def close(ax, ay, bx, by, r: float, most: float, squared: bool, digits: int | None, cut: float):
    """``(rank, p, q, cut)``: pairs at most ``r`` and ``most`` apart and of a rank of ``cut`` at
    most.  Where there are many ``cut`` is lowered and only the first ranks are kept."""
    grid = Grid(bx, by, r * (1 + 1e-9))
    begin, end = grid.ranges(ax, ay)
    count = (end - begin).sum(axis=1)
    part = np.cumsum(count) // (4 * PAIRS)
    held = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for n in np.unique(part):
        rows = np.flatnonzero((part == n) & (count > 0))
        b, e = begin[rows].ravel(), end[rows].ravel()
        p = np.repeat(np.repeat(rows, 3), e - b)
        q = grid.order[np.arange((e - b).sum()) - np.repeat(np.cumsum(e - b) - (e - b), e - b) + np.repeat(b, e - b)]
        dx, dy = ax[p] - bx[q], ay[p] - by[q]
        d = np.hypot(dx, dy)
        rank = rounded(dx * dx + dy * dy if squared else d, digits)
        near = (d <= r) & (d <= most) & (rank <= cut)
        held.append((rank[near], p[near], q[near]))
        if sum(len(h[0]) for h in held) > 4 * PAIRS:
            rank, p, q = (np.concatenate(c) for c in zip(*held))
            cut = float(np.partition(rank, PAIRS)[PAIRS])
            near = rank <= cut
            held = [(rank[near], p[near], q[near])]
    return (*(np.concatenate(c) for c in zip(*held)), cut)


def greedy(i, ax, ay, j, bx, by, most: float = np.inf, squared: bool = False, digits: int | None = None):
    """``(i, j, d)``: repeatedly the nearest pair whose sides are both free, by (d, i, j).

    Ids are numbers in the order of ties.  Points at one place are alike, so those of
    smaller ids go first; pairs are looked at from the nearest on, in steps of a radius
    within which there are not too many, so all pairs are never held."""
    groups = []
    for ids, x, y in ((i, ax, ay), (j, bx, by)):
        places, which = np.unique(np.column_stack([x, y]), axis=0, return_inverse=True)
        order = np.lexsort((ids, which.ravel()))
        parts = np.split(ids[order], np.cumsum(np.bincount(which.ravel()))[:-1])
        groups.append((places, [p.tolist()[::-1] for p in parts]))
    (pa, ma), (pb, mb) = groups
    used_i, used_j, out = set(), set(), []

    def head(members: list, used: set):
        while members and members[-1] in used:
            members.pop()
        return members[-1] if members else None

    live_a, live_b = np.arange(len(pa)), np.arange(len(pb))
    both = np.concatenate([pa, pb])
    # all places lie on the cells of a grid this wide; at least so much that no number of a cell is too large
    whole = max(float(np.hypot(*(both.max(axis=0) - both.min(axis=0)))) * 1.001, 1e-300)
    last, done = min(whole, most), 0.0
    while len(live_a) and len(live_b):
        x, y, u, v = pa[live_a, 0], pa[live_a, 1], pb[live_b, 0], pb[live_b, 1]
        r = last
        while r / 2 > done and r / 2 > whole * 2.0**-30 and len(x) * len(u) > PAIRS:
            begin, end = Grid(u, v, r * (1 + 1e-9)).ranges(x, y)
            if (end - begin).sum() <= PAIRS:
                break
            r /= 2
        final = r == last
        # ranks that a pair farther off than r may also have wait for it
        bound = np.inf if final else float(rounded(np.array([r * r if squared else r]), digits)[0]) * (1 - 1e-12) - (0 if digits is None else 10.0**-digits)
        rank, p, q, cut = close(x, y, u, v, max(r, whole * 2.0**-30), most, squared, digits, bound)
        order = np.argsort(rank, kind="stable")
        rank, p, q = rank[order], live_a[p[order]].tolist(), live_b[q[order]].tolist()
        begins = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])).tolist() if len(rank) else []
        for b, e in zip(begins, [*begins[1:], len(rank)]):
            heap = []
            for k in range(b, e):
                s, t = head(ma[p[k]], used_i), head(mb[q[k]], used_j)
                if s is not None and t is not None:
                    heap.append((s, t, p[k], q[k]))
            heapify(heap)
            while heap:
                s, t, a, c = heappop(heap)
                now = head(ma[a], used_i), head(mb[c], used_j)
                if None in now:
                    continue
                if now == (s, t):
                    out.append((s, t, rank[b]))
                    used_i.add(s)
                    used_j.add(t)
                    now = head(ma[a], used_i), head(mb[c], used_j)
                if None not in now:
                    heappush(heap, (*now, a, c))
        if final and cut == bound:
            break
        if cut == bound:
            done = r
        live_a = live_a[[head(ma[k], used_i) is not None for k in live_a]]
        live_b = live_b[[head(mb[k], used_j) is not None for k in live_b]]
    return tuple(np.array(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
