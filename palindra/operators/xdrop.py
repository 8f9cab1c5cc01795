"""Greedy gapped extension with an X-drop rule, for many pairs of flanks at once."""

from __future__ import annotations

from collections import deque

import numpy as np


def batch(u: np.ndarray, v: np.ndarray, size: np.ndarray, x: int = 5, half: int = 1, unit: int = 4, edges: tuple[int, int, int] = (1, 1, 1)) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the best extension for each row of the code matrices ``u`` and ``v`` (0 .. 3, others
    special), both flanks of a row ``size`` long. All rows go through a generation together.

    Generation d holds, per diagonal k = i - j, the furthest row i reached at a total distance of d, where
    a replaced base, a base of ``v`` alone and a base of ``u`` alone are as far as ``edges`` says. The score of (i, j) is
    ``half`` * (i + j) less ``unit`` per distance. As many generations are held as the longest edge
    looks back: they bound the diagonals of the next one, and a row ends after that many without a cell.
    """
    n_rows, back = len(u), (x + half) // unit + 1
    replaced, inserted, deleted = edges
    longest, first = max(edges), min(edges)
    best_i, best_j, best = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64)
    width = u.shape[1]
    if not n_rows or not width:
        return best_i, best_j
    flat_u, flat_v = u.reshape(-1), v.reshape(-1)

    def run(row: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal bases from (i, j) on; rows where either is at its end get 0."""
        reached, limit = i.copy(), size[row]
        going = np.flatnonzero((i < limit) & (j < limit) & (i >= 0) & (j >= 0))
        at, bt, left = row[going] * width + i[going], row[going] * width + j[going], np.minimum(limit[going] - i[going], limit[going] - j[going])
        while len(going):
            a = flat_u[at]
            on = (a == flat_v[bt]) & (a < 4)
            going, at, bt, left = going[on], at[on] + 1, bt[on] + 1, left[on] - 1
            reached[going] += 1
            on = left > 0
            going, at, bt, left = going[on], at[on], bt[on], left[on]
        return reached - i

    rows = np.flatnonzero(size > 0)
    reach = run(rows, np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64))
    best_i[rows], best_j[rows], best[rows] = reach, reach, 2 * half * reach
    rows = rows[reach < size[rows]]
    least = -size - 2  # still below 0 a step further
    edge = 4  # diagonal k is column k + edge
    front = np.repeat(least[rows][:, None], 2 * edge + 1, axis=1)
    front[:, edge] = best_i[rows]
    #: The last generations, the newest first.
    ring: deque[np.ndarray] = deque([front], maxlen=longest)
    empty = np.zeros(len(rows), np.int64)
    tops = [best[rows].copy()]
    low, high = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    d = 0
    while len(rows):
        d += 1
        if d + 2 > edge:
            grow = edge
            pad = np.repeat(least[rows][:, None], grow, axis=1)
            ring, edge = deque((np.concatenate([pad, f, pad], axis=1) for f in ring), maxlen=longest), edge + grow
        n, mine = size[rows], least[rows]
        k0, k1 = int(low.min()) - 1, int(high.max()) + 1
        k = np.arange(k0, k1 + 1)
        here = slice(k0 + edge, k1 + edge + 1)
        inside = (k >= low[:, None] - 1) & (k <= high[:, None] + 1)
        none = np.iinfo(np.int64).min // 4
        nothing = np.full((len(rows), len(k)), none)
        past = lambda by, shift: ring[by - 1][:, k0 + edge + shift : k1 + edge + 1 + shift]
        delete = np.where((k > low[:, None]) & (abs(k - 1) <= d - deleted), past(deleted, -1) + 1, none) if d >= deleted else nothing
        replace = np.where((k >= low[:, None]) & (k <= high[:, None]) & (abs(k) <= d - replaced), past(replaced, 0) + 1, none) if d >= replaced else nothing
        insert = np.where((k < high[:, None]) & (abs(k + 1) <= d - inserted), past(inserted, 1), none) if d >= inserted else nothing
        i = np.maximum(np.maximum(delete, replace), insert)
        i = np.where(i == none, mine[:, None], i)
        j = i - k
        alive = inside & (i >= 0)
        if d > back:
            alive &= half * (i + j) - unit * d >= tops[d - back][:, None] - x
        old = ring[0][:, here]
        fresh = alive & ((k <= -d) | (k >= d) | ((old < i) & (i <= np.minimum(n[:, None], n[:, None] + k))))
        now = np.where(alive, old, mine[:, None])
        r, c = np.nonzero(fresh)
        if len(r):
            fi = i[r, c]
            fi = fi + run(rows[r], fi, j[r, c])
            now[r, c] = fi
            gain = np.full(now.shape, none)
            gain[r, c] = half * (2 * fi - k[c]) - unit * d
            top = gain.max(axis=1)
            better = np.flatnonzero(top > best[rows])
            col = gain[better].argmax(axis=1)  # the first diagonal of the best
            best[rows[better]] = top[better]
            best_i[rows[better]] = now[better, col]
            best_j[rows[better]] = now[better, col] - k[col]
        after = np.repeat(mine[:, None], ring[0].shape[1], axis=1)
        after[:, here] = np.where(inside, now, mine[:, None])
        tops.append(best[rows].copy())
        # a generation that no edge reaches yet is no empty one
        empty = np.where(alive.any(axis=1) | (d < first) | ((d == first) & (inserted > first)), 0, empty + 1)
        done = (empty >= longest) | ((0 >= low - 1) & (0 <= high + 1) & (after[:, edge] == n))
        # new bounds: cells reached that an edge may still start from; then, from the main diagonal outwards, ends of either flank
        whole = np.arange(-edge, edge + 1)
        ring.appendleft(after)
        reached = ring[0] > mine[:, None]
        for f in list(ring)[1:]:
            reached |= f > mine[:, None]
        some = reached.any(axis=1)
        low = np.where(some, whole[reached.argmax(axis=1)], low)
        high = np.where(some, whole[len(whole) - 1 - reached[:, ::-1].argmax(axis=1)], high)
        at_end = (after == n[:, None] + whole) & (whole <= 0) & (whole >= low[:, None])
        low = np.where(at_end.any(axis=1), whole[len(whole) - 1 - at_end[:, ::-1].argmax(axis=1)], low)
        at_end = (after == n[:, None]) & (whole >= 0) & (whole <= high[:, None])
        high = np.where(at_end.any(axis=1), whole[at_end.argmax(axis=1)], high)
        keep = np.flatnonzero(~done & (low <= high))
        rows, empty, low, high = rows[keep], empty[keep], low[keep], high[keep]
        ring = deque((f[keep] for f in ring), maxlen=longest)
        tops = [t[keep] if g >= d - back else t for g, t in enumerate(tops)]
    return best_i, best_j
