"""SentencePiece encoding and decoding, with segmentations sampled without replacement.

A text's segmentations are the paths of a lattice of vocabulary pieces; a path's probability is
the product of its pieces' weights over the sum of all paths. Gumbel top-k: every path's
log-probability is perturbed by its own Gumbel variate, and the k largest are k draws without
replacement. Perturbed A-star search finds them without listing paths: the bound of a set of
paths is the maximum of their perturbed values, drawn top down. The best path of a set is drawn
edge by edge; at each edge the paths that part there form a new set, whose maximum is a Gumbel
at the log of their exact mass (backward sums over the lattice), truncated at the set it came
from. The next sample is the best of all sets left.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palindra.llm.common import pieces, read, small_batches

#: The model file; every executor gets its pieces with the code.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Marks a space in pieces.
SPACE = "▁"
#: Stands for the mark itself in a text; no text can hold it.
_LITERAL = "\ud800"
_CHUNK = 2 << 20
#: Characters that have a column in the table of a trie's steps; the others are searched for.
_COLUMNS = 64
#: Samples, and about as many ids, of a batch of the result.
_OUT, _OUT_IDS = 256, 1 << 18


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as a trie in sorted arrays, their log-weights, and their bytes."""

    edge_key: np.ndarray
    edge_to: np.ndarray
    #: The node of each first character; 0 where there is none. The last entry stands for all beyond.
    root: np.ndarray
    piece: np.ndarray
    weight: np.ndarray
    byte_id: np.ndarray
    byte_weight: float
    spelled: np.ndarray
    spelled_at: np.ndarray
    longest: int


def load(path: str = MODEL, power: float = 1.0) -> Vocabulary:
    """The vocabulary of a model file.

    A merge-ranked model scores a piece by its rank only: its log-weight is -``power`` *
    log(rank + 2). A model with log-probabilities keeps them times ``power``. Bytes weigh less
    than any piece.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    names, score = [model.id_to_piece(i) for i in range(n)], np.array([model.get_score(i) for i in range(n)])
    special = np.array([model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)])
    byte = np.array([model.is_byte(i) for i in range(n)])
    usual = ~special & ~byte
    ranked = bool(usual.any()) and float(score[usual].min()) < -1000
    order = np.empty(n)
    order[np.argsort(-np.where(usual, score, -np.inf), kind="stable")] = np.arange(n)
    weight = -power * np.log(order + 2) if ranked else power * score
    byte_weight = float(weight[usual].min()) - 1.0 if usual.any() else -1.0
    byte_id = np.full(256, -1, np.int32)
    for i in np.flatnonzero(byte).tolist():
        byte_id[int(names[i][3:5], 16)] = i
    if (byte_id < 0).any():
        raise ValueError("the model has no byte fallback, so not every text has a segmentation")
    trie: dict[tuple[int, int], int] = {}
    ends: dict[int, int] = {}
    for i in np.flatnonzero(usual).tolist():
        at = 0
        for c in names[i]:
            at = trie.setdefault((at, ord(c)), len(trie) + 1)
        ends[at] = i
        if SPACE in names[i].lstrip(SPACE) or "\n" in names[i]:
            raise ValueError("a piece crosses the end of a word")
    key = np.array([a << 21 | c for a, c in trie], np.int64)
    to = np.array(list(trie.values()), np.int64)
    piece = np.full(len(trie) + 1, -1, np.int64)
    piece[list(ends)] = list(ends.values())
    order = np.argsort(key)
    spelled = [b"" if special[i] else bytes([int(names[i][3:5], 16)]) if byte[i] else names[i].replace(SPACE, " ").encode() for i in range(n)]
    at = np.concatenate([[0], np.cumsum([len(b) for b in spelled])])
    root = np.zeros(0x3001, np.int64)
    for (a, c), node in trie.items():
        if a == 0 and c < len(root) - 1:
            root[c] = node
    longest = max((len(names[i]) for i in np.flatnonzero(usual)), default=1)
    return Vocabulary(key[order], to[order], root, piece, weight, byte_id, byte_weight, np.frombuffer(b"".join(spelled), np.uint8), at, longest)


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The concatenated ranges start .. start + size."""
    total = int(size.sum())
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)


def decode_bytes(ids: np.ndarray, v: Vocabulary) -> np.ndarray:
    """What ``ids`` spell, the leading space of each text included."""
    return v.spelled[spread(v.spelled_at[ids], v.spelled_at[ids + 1] - v.spelled_at[ids])]


class Spelling:
    """``decode_bytes`` for many ids, by Arrow."""

    def __init__(self, v: Vocabulary):
        self.names = pa.Array.from_buffers(pa.binary(), len(v.spelled_at) - 1, [None, pa.py_buffer(v.spelled_at.astype(np.int32)), pa.py_buffer(v.spelled)])

    def __call__(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """What ``ids`` spell, and where each begins and the last one ends."""
        if not len(ids):
            return b"", np.zeros(1, np.int32)
        parts = self.names.take(pa.array(ids))
        at = np.frombuffer(parts.buffers()[1], np.int32, len(parts) + 1)
        return parts.buffers()[2].slice(0, int(at[-1])).to_pybytes(), at


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    return _text(decode_bytes(np.asarray(ids, np.int64), v).tobytes())


def _text(out: bytes) -> str:
    return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


def _sums(value: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Log of the summed exponentials of each slice that begins at ``start``."""
    top = np.maximum.reduceat(value, start)
    size = np.diff(np.concatenate([start, [len(value)]]))
    return top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, size)), start))


class Steps:
    """The steps of a vocabulary's trie, by table for its most frequent characters."""

    def __init__(self, v: Vocabulary):
        self.v = v
        state, char = v.edge_key >> 21, v.edge_key & ((1 << 21) - 1)
        usual, often = np.unique(char[char < len(v.root)], return_counts=True)
        usual = usual[np.argsort(-often, kind="stable")[: _COLUMNS - 1]]
        self.column = np.zeros(len(v.root), np.int32)  # 0: none
        self.column[usual] = np.arange(1, len(usual) + 1)
        self.table = np.zeros((len(v.piece), _COLUMNS), np.int32)
        here = np.flatnonzero((char < len(v.root)) & (self.column[np.minimum(char, len(v.root) - 1)] > 0))
        self.table[state[here], self.column[char[here]]] = v.edge_to[here]
        self.flat = self.table.ravel()
        #: Nodes that lead on; a walk ends at the others.
        self.inner = np.zeros(len(v.piece), bool)
        self.inner[state] = True

    def columns(self, char: np.ndarray) -> np.ndarray:
        return self.column.take(np.minimum(char, len(self.column) - 1))

    def search(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) << 21 | char
        k = np.minimum(np.searchsorted(self.v.edge_key, key), len(self.v.edge_key) - 1)
        return np.where(self.v.edge_key[k] == key, self.v.edge_to[k], 0).astype(np.int32)

    def __call__(self, state: np.ndarray, char: np.ndarray, column: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The next node of each over the character at ``at``, 0 for none."""
        column = column.take(at)
        to = self.flat.take(state * _COLUMNS + column)
        rare = np.flatnonzero(column == 0)
        if len(rare):
            to[rare] = self.search(state[rare], char[at[rare]])
        return to


class Lattice:
    """The lattices of distinct units of text (words with the spaces before them, line feeds)."""

    #: The unit instances of the texts, those of the same unit together (``Units.of``).
    by_unit: np.ndarray

    def __init__(self, code: np.ndarray, size: np.ndarray, v: Vocabulary, steps: Steps):
        """``code`` has the characters of all units, ``size`` how many each has."""
        self.end = np.cumsum(size)
        self.start = self.end - size
        n = len(code)
        code = code.astype(np.int32)
        left = (np.repeat(self.end, size) - np.arange(n)).astype(np.int32)
        column, piece_of = steps.columns(code), v.piece.astype(np.int32)
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for length in range(1, v.longest + 1):
            if length == 1:
                state = v.root.take(np.minimum(code, len(v.root) - 1)).astype(np.int32)
                far = np.flatnonzero(code >= len(v.root) - 1)
                state[far] = steps.search(np.zeros(len(far), np.int32), code[far])
                at = np.flatnonzero(state)
                state = state.take(at)
            else:
                state = steps(state, code, column, at + (length - 1))
                hit = np.flatnonzero(state)
                at, state = at.take(hit), state.take(hit)
            piece = piece_of.take(state)
            ends = np.flatnonzero(piece >= 0)
            if length == 1:
                lone = np.ones(n, bool)
                lone[at[ends]] = False
                self.fallback = np.flatnonzero(lone)
                # a character without a piece of its own is spelled in bytes
                found.append((1, self.fallback, -1 - code[self.fallback]))
            found.append((length, at.take(ends), piece.take(ends)))
            more = np.flatnonzero((left.take(at) > length) & steps.inner.take(state))
            at, state = at.take(more), state.take(more)
        self.count = np.bincount(np.concatenate([x for _, x, _ in found]), minlength=n).astype(np.int32)
        # edges go by what is left after their start, then by start, the longest first
        by_left = np.argsort(left.astype(np.int16) if n and left.max() < 1 << 15 else left, kind="stable")
        self.first, per = np.empty(n, np.int32), self.count.take(by_left)
        first = np.cumsum(per, dtype=np.int64) - per
        self.first[by_left] = first
        slot, total_edges = self.first + self.count, len(by_left) and int(first[-1] + per[-1])
        self.length, self.piece = np.empty(total_edges, np.int32), np.empty(total_edges, np.int32)
        for length, x, piece in found:
            to = slot.take(x) - 1
            slot[x], self.length[to], self.piece[to] = to, length, piece
        del found
        self.edge_at = at = np.repeat(by_left.astype(np.int32), per)
        self.tokens, weight = np.ones(total_edges, np.int8), v.weight.take(np.maximum(self.piece, 0))
        spelled = np.flatnonzero(self.piece < 0)
        c = -1 - self.piece[spelled]
        n_bytes = np.where(c == ord(_LITERAL), 3, 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))
        self.tokens[spelled], weight[spelled] = n_bytes, v.byte_weight * n_bytes
        # backward sums, all positions with as much left at a time: as they are while they are within
        # a double's range, as logarithms beyond
        mass, weight_p = np.ones(n + 1), np.exp(weight)
        into = at + self.length
        levels, log_mass, hi, e = np.unique(left, return_counts=True), None, 0, 0
        self.p = np.empty(total_edges)
        for r, positions in zip(*(x.tolist() for x in levels), strict=True):
            lo, hi, s = hi, hi + positions, e
            e = int(first[hi]) if hi < n else total_edges
            own, begin, size_ = by_left[lo:hi], first[lo:hi] - s, per[lo:hi]
            inner = self.length[s:e] < r
            if r <= _LINEAR:
                part = weight_p[s:e] * np.where(inner, mass.take(into[s:e]), 1.0)
                total = np.add.reduceat(part, begin)
                mass[own], self.p[s:e] = total, part / np.repeat(total, size_)
            else:
                if log_mass is None:
                    log_mass = np.log(mass)
                part = weight[s:e] + np.where(inner, log_mass.take(into[s:e]), 0.0)
                total = _sums(part, begin)
                log_mass[own], self.p[s:e] = total, np.exp(part - np.repeat(total, size_))
        with np.errstate(divide="ignore"):
            self.log_p = np.log(self.p)
        # the chance of an edge or one before it at its position; the last one is always taken
        self.upto = self.p.copy()
        several = np.flatnonzero(per > 1)
        edge, more, k = first.take(several) + 1, per.take(several), 2
        while len(edge):
            self.upto[edge] += self.upto.take(edge - 1)
            on = np.flatnonzero(more > k)
            edge, more, k = edge.take(on) + 1, more.take(on), k + 1
        self.upto[first + per - 1] = np.inf


_BASE = np.uint64(0x9E3779B97F4A7C15)


class Units:
    """Cuts texts to units: words with the spaces before them, lone spaces and line feeds."""

    def __init__(self, v: Vocabulary):
        self.v, self.steps = v, Steps(v)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Lattice | None]:
        """(unit numbers in order of text, which texts are not empty, how many units each of these has,
        the lattices of the distinct units)."""
        rows = np.array([i for i, t in enumerate(texts) if t], np.int64)
        if not len(rows):
            return np.zeros(0, np.int64), rows, np.zeros(0, np.int64), None
        code = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le"), np.uint32).copy()
        code[code == ord(SPACE)] = ord(_LITERAL)
        space = code == ord(" ")
        code[space] = ord(SPACE)
        feed = code == ord("\n")
        begins = feed.copy()
        begins[1:] |= feed[:-1] | (space[1:] & ~space[:-1])
        text_at = np.cumsum([0] + [len(texts[i]) + 1 for i in rows.tolist()])
        begins[text_at[:-1]] = True
        start = np.flatnonzero(begins)
        size = np.diff(np.append(start, len(code)))
        place = np.arange(len(code)) - np.repeat(start, size)
        power = np.cumprod(np.full(int(size.max()), _BASE))
        hashed = power.take(place)
        hashed *= code + np.uint64(1)
        hashed = np.add.reduceat(hashed, start)
        del power, feed, begins, space
        hashed ^= (hashed >> np.uint64(32)) * _BASE
        order = np.argsort(hashed, kind="stable")
        hashed = hashed.take(order)
        fresh = np.concatenate([[True], hashed[1:] != hashed[:-1]])
        first, number = order[fresh], np.empty(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1
        like = first.take(number)
        place += np.repeat(start.take(like), size)
        if not (size.take(like) == size).all() or not (code == code.take(place)).all():  # two units share a hash
            known: dict[bytes, int] = {}
            number = np.array([known.setdefault(code[s : s + n].tobytes(), len(known)) for s, n in zip(start.tolist(), size.tolist(), strict=True)])
            first, order = np.unique(number, return_index=True)[1], np.argsort(number)
        del place
        counts = np.diff(np.searchsorted(start, text_at))
        lattice = Lattice(code[spread(start[first], size[first])], size[first], self.v, self.steps)
        lattice.by_unit = order
        return number, rows, counts, lattice


def _uniform(seed: np.ndarray, salt: int, place: np.ndarray) -> np.ndarray:
    """In (0, 1), from the row's seed, the sample and the place in the text alone."""
    x = place.astype(np.uint64)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x += seed + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    x >>= np.uint64(11)
    out = x.astype(float)
    out += 0.5
    out *= 1 / float(1 << 53)
    return out


def _row_seed(key: int, seed: int) -> int:
    x = (key * 0x9E3779B97F4A7C15 + seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 32)


class Walk:
    """Paths drawn through the units of many rows in step."""

    def __init__(self, lattice: Lattice, unit: np.ndarray, seeds: np.ndarray, place: np.ndarray):
        self.lattice, self.unit, self.seeds, self.place = lattice, unit, seeds, place

    def draw(self, instances: np.ndarray, at: np.ndarray, salt: int, lead: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(instance, edge) in order of text, from position ``at`` of each instance to its end, and
        where each unit instance begins in them.

        ``instances`` come in any order: by unit, so that neighbours read the same part of the
        lattice. ``lead`` leaves as many places free before each.
        """
        l = self.lattice
        got: list[tuple[np.ndarray, np.ndarray]] = []
        unit = self.unit.take(instances)
        end = l.end.take(unit)
        shift, seeds = self.place.take(instances) - l.start.take(unit), self.seeds.take(instances)
        steps = np.zeros(len(self.unit), np.int32)
        mine, open_ = instances, np.flatnonzero(at < end)
        while len(open_):
            if len(open_) < len(mine):
                mine, at, end, shift, seeds = mine.take(open_), at.take(open_), end.take(open_), shift.take(open_), seeds.take(open_)
            steps[mine] += 1
            chance, edge = _uniform(seeds, salt, shift + at), l.first.take(at)
            going = np.flatnonzero(chance >= l.upto.take(edge))
            chance, to = chance.take(going), edge.take(going)
            while len(going):
                to += 1
                edge[going] = to
                more = np.flatnonzero(chance >= l.upto.take(to))
                going, chance, to = going.take(more), chance.take(more), to.take(more)
            got.append((mine, edge))
            at = at + l.length.take(edge)
            open_ = np.flatnonzero(at < end)
        size = steps if lead is None else steps + lead
        begin = np.cumsum(size, dtype=np.int64) - size
        edges = np.empty(int(size.sum()), np.int32)
        to = begin if lead is None else begin + lead
        for k, (mine, edge) in enumerate(got):
            edges[to.take(mine) + k] = edge
        return np.repeat(np.arange(len(size), dtype=np.int32), size), edges, begin


#: Sets of less mass than exp(_NEAR) have bounds below _FAR: no draw of _uniform lifts one by more than 38.
_NEAR, _FAR = -41.0, -3.0
#: Characters up to which a unit's masses stay within a double's range: each costs exp(-12) at most.
_LINEAR = 48


def _parting(other: np.ndarray, before: np.ndarray, value, chance: np.ndarray) -> np.ndarray:
    """Maxima of the sets that part at each edge: Gumbels at log(``other``) + ``before``, below ``value``."""
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-value, np.log(-np.log(chance)) - np.where(other > 0, np.log(np.maximum(other, 1e-300)), -np.inf) - before)


class Paths:
    """The paths drawn for the rows of a chunk, one after another in flat arrays.

    Of each path: its edges, the unit instance of each, the log-probability before each, and the
    bounds of the sets that part at its edges from ``skip`` on. What parts before belongs to the
    path it came from.
    """

    def __init__(self, lattice: Lattice, seeds: np.ndarray):
        self.lattice, self.seeds = lattice, seeds
        self.edge, self.who, self.before = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0)
        self.start, self.size, self.row, self.log_p, self.value, self.origin, self.skip, self.bound, self.top = ([] for _ in range(9))
        self.of: list[list[int]] = [[] for _ in seeds]
        self.taken: dict[tuple[int, int], set[int]] = {}

    def append(self, rows: np.ndarray, sizes: np.ndarray, edge: np.ndarray, who: np.ndarray, before: np.ndarray, log_p: list[float], value: np.ndarray, skip: np.ndarray, origin: int) -> None:
        """One path each for ``rows``, with the bounds as far as the mass stays above ``_NEAR``."""
        first, number = len(self.edge), len(self.start)
        start = np.cumsum(sizes) - sizes
        hits = np.flatnonzero(before >= _NEAR)
        near = np.searchsorted(hits, start + sizes) - np.searchsorted(hits, start)
        span = np.maximum(near - skip, 0)
        at = spread(start + skip, span)
        bound = self._bounds(edge[at], before[at], np.repeat(value, span), np.repeat(self.seeds[rows], span), origin, at - np.repeat(start, span))
        self.edge, self.who, self.before = np.concatenate([self.edge, edge.astype(np.int32)]), np.concatenate([self.who, who.astype(np.int32)]), np.concatenate([self.before, before])
        self.start += (start + first).tolist()
        self.size += sizes.tolist()
        self.row += rows.tolist()
        self.log_p += log_p
        self.value += value.tolist()
        self.origin += [origin] * len(rows)
        self.skip += skip.tolist()
        end = np.cumsum(span)
        self.bound += [bound[e - n : e] for e, n in zip(end.tolist(), span.tolist(), strict=True)]
        self.top += [None] * len(rows)
        for k, r in enumerate(rows.tolist(), number):
            self.of[r].append(k)

    def _bounds(self, edge, before, value, seed, origin, place) -> np.ndarray:
        l = self.lattice
        out, some = np.full(len(edge), -np.inf), np.flatnonzero(l.count[l.edge_at[edge]] > 1)
        pick = lambda x: x[some] if isinstance(x, np.ndarray) else x
        out[some] = _parting(1 - l.p[edge[some]], before[some], pick(value), _uniform(seed[some], origin, place[some]))
        return out

    def whole(self, q: int) -> bool:
        return self.skip[q] + len(self.bound[q]) >= self.size[q]

    def extend(self, q: int) -> None:
        """The bounds at all edges of a path."""
        known, n, s = self.skip[q] + len(self.bound[q]), self.size[q], self.start[q]
        at = np.arange(s + known, s + n)
        fresh = self._bounds(self.edge[at], self.before[at], self.value[q], np.full(n - known, self.seeds[self.row[q]]), self.origin[q], np.arange(known, n))
        self.bound[q], self.top[q] = np.concatenate([self.bound[q], fresh]), None

    def best(self, r: int) -> tuple[int, int, float]:
        """The path and place of the best set left of a row, and its bound."""
        found = (-1, 0, -np.inf)
        for far in (False, True):
            for q in self.of[r]:
                if far and not self.whole(q):
                    self.extend(q)
                if self.top[q] is None:
                    at = int(self.bound[q].argmax()) if len(self.bound[q]) else 0
                    self.top[q] = (float(self.bound[q][at]) if len(self.bound[q]) else -np.inf, self.skip[q] + at)
                if self.top[q][0] > found[2]:
                    found = (q, self.top[q][1], self.top[q][0])
            if found[2] > _FAR or all(map(self.whole, self.of[r])):
                break
        return found


def sample_paths(keys: list[int], texts: list[str], k: int, seed: int, units: Units) -> tuple[Paths, np.ndarray] | None:
    """Up to ``k`` paths of each text that is not empty, by falling perturbed value, and the numbers
    of these texts."""
    unit, rows, counts, l = units.of(texts)
    if l is None:
        return None
    first_of = np.cumsum(counts) - counts
    size = (l.end - l.start)[unit]
    text_start = (np.cumsum(size) - size)[first_of]
    offset = np.cumsum(size) - size - np.repeat(text_start, counts)
    seeds = np.array([_row_seed(int(keys[i]), seed) for i in rows.tolist()], np.uint64)
    walk, paths = Walk(l, unit, np.repeat(seeds, counts), offset), Paths(l, seeds)

    def sums(before: np.ndarray, begin: np.ndarray, edge: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> list[float]:
        """Fills in the log-probability before each edge of runs of ``edge`` that begin with
        ``begin``; returns those at their ends. Each run by itself."""
        ends = []
        log_p = l.log_p.take(edge)
        for s, n, b in zip(start.tolist(), sizes.tolist(), begin.tolist(), strict=True):
            if n:
                before[s] = b
                run = np.cumsum(log_p[s : s + n - 1], out=before[s + 1 : s + n])
                last = (float(run[-1]) if n > 1 else 0.0) + float(log_p[s + n - 1])
                if b:
                    run += b
                b += last
            ends.append(b)
        return ends

    everyone = np.arange(len(rows))
    root = -np.log(-np.log(_uniform(seeds, 1, np.full(len(rows), -1))))
    by_unit, unit_at = l.by_unit, l.start.take(unit)
    who, edge, begin = walk.draw(by_unit, unit_at.take(by_unit), 2)
    starts, before = begin[first_of], np.empty(len(edge))
    sizes = np.diff(np.append(starts, len(edge)))
    log_p = sums(before, np.zeros(len(rows)), edge, starts, sizes)
    paths.append(everyone, sizes, edge, who, before, log_p, root, np.zeros(len(rows), np.int64), 3)
    for j in range(1, k):
        found = [(r, *paths.best(r)) for r in everyone.tolist() if len(paths.of[r]) == j]
        found = [x for x in found if np.isfinite(x[3])]
        if not found:
            break
        r_of, q_of, t_of = (np.array([x[c] for x in found], np.int64) for c in range(3))
        value = np.array([x[3] for x in found])
        p_start = np.array([paths.start[q] for q in q_of.tolist()], np.int64)
        parting = paths.edge[p_start + t_of]
        at = l.edge_at[parting].astype(np.int64)
        chance = _uniform(seeds[r_of], 16 * j + 4, t_of).tolist()
        pick, rest = [], []
        for q, t, e, u, first, n in zip(q_of.tolist(), t_of.tolist(), parting.tolist(), chance, l.first[at].tolist(), l.count[at].tolist(), strict=True):
            taken = paths.taken.setdefault((q, t), {e})
            others = [(first + x, p) for x, p in enumerate(l.p[first : first + n].tolist()) if first + x not in taken]
            u *= sum(p for _, p in others)
            for chosen, p in others:
                u -= p
                if u < 0:
                    break
            taken.add(chosen)
            pick.append(chosen)
            rest.append(sum(p for e, p in others if e != chosen))
        left = _parting(np.array(rest), paths.before[p_start + t_of], value, _uniform(seeds[r_of], 16 * j + 5, t_of))
        for q, t, x in zip(q_of.tolist(), t_of.tolist(), left.tolist(), strict=True):
            if paths.bound[q].base is not None:
                paths.bound[q] = paths.bound[q].copy()
            paths.bound[q][t - paths.skip[q]], paths.top[q] = x, None
        # the new paths go on in step from the edge that parted
        pick = np.array(pick, np.int64)
        who0 = paths.who[p_start + t_of].astype(np.int64)
        # instances behind those that parted, and these
        begin_at, on, lead = unit_at.copy(), np.zeros(len(unit), bool), np.zeros(len(unit), np.int64)
        on[spread(who0, first_of[r_of] + counts[r_of] - who0)] = True
        begin_at[who0], lead[who0] = at + l.length[pick], t_of + 1
        instances = by_unit[on[by_unit]]
        who, edge, begin = walk.draw(instances, begin_at.take(instances), 16 * j + 2, lead)
        start = begin[who0]
        sizes = np.diff(np.append(start, len(edge)))
        to, old, before = spread(start, t_of + 1), spread(p_start, t_of + 1), np.empty(len(edge))
        edge[to], who[to], before[to] = paths.edge[old], paths.who[old], paths.before[old]
        edge[start + t_of] = pick
        log_p = sums(before, before[start + t_of] + l.log_p[pick], edge, start + t_of + 1, sizes - t_of - 1)
        paths.append(r_of, sizes, edge, who, before, log_p, value, t_of + 1, 16 * j + 3)
    return paths, rows


def _inclusion(paths: Paths, r: int, k: int) -> list[float]:
    """The log of the inclusion probability of each path of a row."""
    bar, out = paths.best(r)[2] if len(paths.of[r]) == k else -np.inf, []
    for q in paths.of[r]:
        x = paths.log_p[q] - bar
        sure = 0.0 if x > 3.5 else float(np.log(-np.expm1(-np.exp(x)))) if x > -30 else x
        out.append(min(0.0, sure))
    return out


Sample = tuple[np.ndarray, float, float, float]


def sample_chunk(keys: list[int], texts: list[str], v: Vocabulary, k: int, seed: int, units: Units | None = None) -> list[list[Sample]]:
    """For each text its samples by falling perturbed value: (ids, log-probability, value, log of
    the inclusion probability)."""
    results: list[list[Sample]] = [[(np.zeros(0, np.int32), 0.0, 0.0, 0.0)] for _ in texts]
    if (drawn := sample_paths(keys, texts, k, seed, units or Units(v))) is None:
        return results
    paths, rows = drawn
    ids, token = _ids(paths.lattice, paths.edge, v)
    start = np.array(paths.start, np.int64)
    ends = list(zip(token(start).tolist(), token(start + np.array(paths.size, np.int64)).tolist(), strict=True))
    for r, i in enumerate(rows.tolist()):
        results[i] = [(ids[slice(*ends[q])], paths.log_p[q], paths.value[q], sure) for q, sure in zip(paths.of[r], _inclusion(paths, r, k), strict=True)]
    return results


def _ids(l: Lattice, edge: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """The piece ids of edges, and where those of an edge begin."""
    ids = l.piece.take(edge)
    low = np.flatnonzero(ids < 0)
    piece, n = ids[low], l.tokens[edge[low]]
    more = np.concatenate([[0], np.cumsum(n.astype(np.int64) - 1)])
    if more[-1]:
        per_edge = np.ones(len(edge), np.int8)
        per_edge[low] = n
        ids = np.repeat(ids, per_edge)
    first = low + more[:-1]
    ids[first] = v.byte_id[np.minimum(-1 - piece, 255)]
    several = np.flatnonzero(n > 1)
    for c in np.unique(piece[several]).tolist():
        spelled = SPACE.encode() if -1 - c == ord(_LITERAL) else chr(-1 - c).encode()
        at = first[several[piece[several] == c]]
        ids[at[:, None] + np.arange(len(spelled))] = v.byte_id[list(spelled)]
    return ids, lambda at: at + more[np.searchsorted(low, at)]


def _parts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of samples for one batch of the result each."""
    start, total = 0, 0
    for k, n in enumerate(sizes):
        if k > start and (k - start == _OUT or total + n > _OUT_IDS):
            yield start, k
            start, total = k, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


def _encode(v: Vocabulary, k: int, seed: int):
    names = ["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "log_inclusion", "ids_crc32", "round_trip", "ids", "text"]

    def out(part: list[tuple[int | None, int, Sample, bytes]], spell: Spelling) -> pa.RecordBatch:
        ids = [s[0] for _, _, s, _ in part]
        size = np.array([len(x) for x in ids])
        flat, end = np.concatenate(ids).astype(np.int32, copy=False), np.cumsum(size)
        data, at = spell(flat)
        at = at[np.concatenate([[0], end])].astype(np.int64)
        same = [data[s + 1 : e] == x[3] if x[3] else s == e for s, e, x in zip(at[:-1].tolist(), at[1:].tolist(), part, strict=True)]
        if all(same):  # each text is what is spelled without its first space
            begin = at[:-1][at[1:] > at[:-1]]
            length = np.maximum(np.diff(at) - 1, 0)
            text = pa.Array.from_buffers(pa.string(), len(part), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.py_buffer(np.delete(np.frombuffer(data, np.uint8), begin).tobytes())])
        else:
            text = pa.array([_text(data[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())
        return pa.record_batch([
            pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int32()), pa.array(size, pa.int64()),
            *(pa.array([x[2][c] for x in part], pa.float64()) for c in (1, 2, 3)),
            pa.array([zlib.crc32(x.astype("<i4", copy=False)) for x in ids], pa.int64()), pa.array(same),
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]), pa.int32()), pa.array(flat)), text,
        ], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, spell = Units(v), Spelling(v)
        for whole in batches:
            for batch in pieces(whole, "text", _CHUNK):
                keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
                found = sample_chunk([x or 0 for x in keys], texts, v, k, seed, units)
                flat = [(key, j, s, raw) for key, raw, samples in zip(keys, map(str.encode, texts), found, strict=True) for j, s in enumerate(samples)]
                del texts, found
                for a, b in _parts([len(x[2][0]) for x in flat]):
                    yield out(flat[a:b], spell)

    return run


def encode_documents(docs: DataFrame, k: int = 3, seed: int = 11, model: str = MODEL, power: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Up to ``k`` distinct sampled segmentations of each text, by falling perturbed value.

    Each row of the result is one sample (from 0): its piece ids, their number and checksum, the
    log of its probability among all segmentations of the text, its perturbed value, the log of
    its inclusion probability given the (k+1)-th perturbed value (0 where all segmentations are
    returned), whether decoding gives the text back, and the decoded text. The draws depend on the row's key,
    ``seed`` and the text alone, so reruns and other partitionings agree.

    Texts begin with a space that decoding drops; spaces are kept as they are, characters without
    a piece are spelled in bytes, and so is the space mark itself. Null and empty texts have one
    segmentation without pieces. Texts with fewer than ``k`` segmentations return all of them.
    Whole texts are sampled, of any length. Repeated rows return as often. Empty: empty.
    """
    small_batches(docs.sparkSession, 2500)
    v = load(model, power)
    schema = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, ids_crc32 long, round_trip boolean, ids array<int>, text string"
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_encode(v, k, seed), schema)


def decode_documents(encoded: DataFrame, model: str = MODEL, ids: str = "ids") -> DataFrame:
    """``encoded`` with the text that its ids spell, in column ``text``."""
    v = load(model)
    names = [c for c in encoded.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            column = batch.column(at)
            bounds, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            texts = [decode(flat[s:e], v) if here else None for s, e, here in zip(bounds[:-1].tolist(), bounds[1:].tolist(), column.is_valid().to_pylist(), strict=True)]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    frame = encoded.select(*names)
    return frame.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema) + ", text string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of every document with their ids, and the text that the ids decode to."""
    return encode_documents(read(spark, sf_dir, "documents"))
