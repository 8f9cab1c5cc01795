"""Edit distance of many pairs at once, two ways: furthest-reaching diagonals within a band, and bit-parallel columns.

Letters compare as they are: two special bases of one letter are equal, as the similarity of arms has it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

#: Cells of a batch's arrays, about.
_TOGETHER = 1 << 20
_WORD = np.uint64(63)


def _matrix(strings: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in strings], np.int64)
    out = np.full((len(strings), int(size.max(initial=0)) + 1), pad, np.uint8)
    raw = np.frombuffer("".join(strings).encode("latin-1", "replace"), np.uint8)
    out[np.arange(out.shape[1]) < size[:, None]] = raw
    return out, size


def furthest(us: list[str], vs: list[str], band: np.ndarray) -> np.ndarray:
    """The distance of each pair, or ``band`` + 1 where it is above its ``band``.

    Per distance e and diagonal k the furthest row reached; a pair is over when its last
    corner is, or its band is: the work grows with the distance, not with the product of lengths.
    """
    u, n = _matrix(us, 0)
    v, m = _matrix(vs, 1)
    out = np.asarray(band, np.int64) + 1
    most = int(min(out.max(initial=1) - 1, max(n.max(initial=0), m.max(initial=0))))
    rows = np.arange(len(us))
    k = np.arange(-most - 1, most + 2)
    none = -(1 << 30)
    front = np.full((len(us), len(k)), none, np.int64)
    front[:, most + 1] = 0
    for e in range(most + 1):
        if e:
            moved = front + 1  # a base of each replaced
            moved[:, 1:] = np.maximum(moved[:, 1:], front[:, :-1] + 1)  # a base of u alone
            moved[:, :-1] = np.maximum(moved[:, :-1], front[:, 1:])  # a base of v alone
            front = moved
        limit = np.minimum(n[rows, None], m[rows, None] + k)
        front = np.where((front < 0) | (limit < 0), none, np.minimum(front, limit))
        r, c = np.nonzero((front >= 0) & (front < limit) & (front - k >= 0))
        i = front[r, c]
        going = np.arange(len(r))
        while len(going):
            a = rows[r[going]]
            on = u[a, i[going]] == v[a, i[going] - k[c[going]]]
            going = going[on]
            i[going] += 1
            going = going[i[going] < limit[r[going], c[going]]]
        front[r, c] = i
        corner = n[rows] - m[rows] + most + 1
        inside = (corner >= 0) & (corner < len(k))
        done = inside & (front[np.arange(len(rows)), np.clip(corner, 0, len(k) - 1)] == n[rows])
        done &= e < out[rows]
        out[rows[done]] = e
        keep = ~done & (e + 1 < out[rows])
        rows, front = rows[keep], front[keep]
        if not len(rows):
            break
    return out


def bit_parallel(us: list[str], vs: list[str]) -> np.ndarray:
    """The distance of each pair: 64 rows of a column of the table in a word, and columns of all pairs in step."""
    u, n = _matrix(us, 0)
    v, m = _matrix(vs, 1)
    blocks = max(1, -(-int(n.max(initial=0)) // 64))
    letters = np.unique(np.concatenate([u[u > 1], v[v > 1]]))
    # per letter, block and pair: where the letter stands in u
    equal = np.zeros((len(letters) + 1, blocks, len(us)), np.uint64)
    place = np.zeros(256, np.int64)
    for k, letter in enumerate(letters.tolist(), 1):
        place[letter] = k
        bits = np.zeros((len(us), blocks * 64), np.uint8)
        bits[:, : min(u.shape[1], blocks * 64)] = (u == letter)[:, : blocks * 64]
        equal[k] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(len(us), blocks).T
    last, row_bit = np.maximum(n - 1, 0) // 64, (np.maximum(n - 1, 0) & 63).astype(np.uint64)
    up, down = np.full((blocks, len(us)), ~np.uint64(0)), np.zeros((blocks, len(us)), np.uint64)
    out, one = n.copy(), np.uint64(1)
    for j in range(int(m.max(initial=0))):
        on = np.flatnonzero(m > j)
        code = place[v[on, j]]
        plus, minus = np.ones(len(on), np.uint64), np.zeros(len(on), np.uint64)  # along the first row, each column is one more
        for b in range(blocks):
            eq, pv, mv = equal[code, b, on], up[b, on], down[b, on]
            xv = eq | mv
            eq = eq | minus
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            here = last[on] == b
            bit = np.where(here, row_bit[on], _WORD)
            more, less = ph >> bit & one, mh >> bit & one
            out[on[here]] += more[here].astype(np.int64) - less[here].astype(np.int64)
            ph, mh, plus, minus = ph << one | plus, mh << one | minus, more, less
            up[b, on], down[b, on] = mh | ~(xv | ph), ph & xv
    return np.where(n == 0, m, out)


def _batched(work, left: pd.Series, right: pd.Series, *more: pd.Series) -> pd.Series:
    """``work`` on pairs of about the same length together; null where a string is."""
    out = pd.Series([None] * len(left), index=left.index, dtype="object")
    ok = np.flatnonzero((left.notna() & right.notna()).to_numpy())
    size = np.maximum(left.iloc[ok].str.len().to_numpy(np.int64), right.iloc[ok].str.len().to_numpy(np.int64)) if len(ok) else np.zeros(0, np.int64)
    order = ok[np.argsort(size, kind="stable")]
    size = np.sort(size)
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * (int(size[end]) + 64) <= _TOGETHER:
            end += 1
        part = order[at:end]
        out.iloc[part] = work(left.iloc[part].tolist(), right.iloc[part].tolist(), *(x.iloc[part].to_numpy(np.int64) for x in more)).tolist()
        at = end
    return out.astype("Int64")


def _furthest(left: pd.Series, right: pd.Series, band: pd.Series) -> pd.Series:
    return _batched(furthest, left, right, band)


def _bit_parallel(left: pd.Series, right: pd.Series) -> pd.Series:
    return _batched(bit_parallel, left, right)


def furthest_distance(left: Column, right: Column, band: Column) -> Column:
    """The edit distance of two strings if it is ``band`` or less, else ``band`` + 1."""
    return pandas_udf(_furthest, LongType())(left, right, band)


def bit_distance(left: Column, right: Column) -> Column:
    """The edit distance of two strings."""
    return pandas_udf(_bit_parallel, LongType())(left, right)
