"""X-drop extension of one pair in plain loops, to test the batch against."""

def extend(u: str, v: str, x: int = 5, half: int = 1, unit: int = 4, edges: tuple[int, int, int] = (1, 1, 1)) -> tuple[int, int, int]:
    """(i, j, score) of the best extension of ``u`` against ``v``, one pair in plain loops.

    Generation d holds, per diagonal k = i - j, the furthest row i reached at distance d; ``edges`` has how far
    a replacement, an insertion and a deletion are. The score of (i, j) is half * (i + j) less ``unit`` per distance.
    """
    n, m = len(u), len(v)
    if not n or not m:
        return 0, 0, 0
    least, back = -max(n, m) - 2, (x + half) // unit + 1
    replaced, inserted, deleted = edges

    def run(i: int, j: int) -> int:
        s = i
        while i < n and j < m and u[i] == v[j] and u[i] in "ACGT":
            i, j = i + 1, j + 1
        return i - s

    score = lambda i, j, d: half * (i + j) - unit * d
    reach = run(0, 0)
    fronts, best, tops, low, high, d, empty, seen = [{0: reach}], (reach, reach, score(reach, reach, 0)), [score(reach, reach, 0)], 0, 0, 0, 0, False
    if reach >= n or reach >= m:
        return best
    while low <= high:
        d, now, alive = d + 1, {}, False
        for k in range(low - 1, high + 2):
            before = lambda by: fronts[d - by] if d >= by else {}
            options = [before(deleted)[k - 1] + 1] if low < k and k - 1 in before(deleted) else []
            options += [before(replaced)[k] + 1] if low <= k <= high and k in before(replaced) else []
            options += [before(inserted)[k + 1]] if k < high and k + 1 in before(inserted) else []
            seen = seen or bool(options)
            i = max(options, default=least)
            if i < 0:
                alive = alive or not seen
                now[k] = least
                continue
            j = i - k
            if d > back and score(i, j, d) < tops[d - back] - x:
                now[k] = least
                continue
            alive = True
            if k <= -d or k >= d or (fronts[d - 1].get(k, least) < i and i <= min(n, m + k)):
                i += run(i, j)
                now[k] = i
                if score(i, i - k, d) > best[2]:
                    best = i, i - k, score(i, i - k, d)
            else:
                now[k] = fronts[d - 1].get(k, least)
        empty = 0 if alive else empty + 1
        if empty >= max(edges):
            break
        tops.append(best[2])
        if now.get(n - m) == n:
            break
        held = [k for f in [now, *fronts[::-1][: max(edges) - 1]] for k, i in f.items() if i > least]
        low, high = (min(held), max(held)) if held else (low, high)
        low = next((k for k in range(0, low - 1, -1) if now.get(k, least) == m + k), low)
        high = next((k for k in range(0, high + 1) if now.get(k, least) == n), high)
        fronts.append({k: now.get(k, least) for k in range(-d, d + 1)})
    return best
