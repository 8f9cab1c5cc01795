"""Removal of long substrings that an earlier document holds, by run-length indexes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palindra.llm.common import byte_views, cut, n_partitions, read, small_batches
from palindra.llm.run_index import RunIndex

#: Bytes of an anchor. With windows of 50, every window holds an anchor at one of 31 offsets.
ANCHOR = 20
#: Text bytes of a pack, the unit that is computed and answered together.
PACK = 1 << 19
#: Symbols of one index.
INDEX = 1 << 19
#: An anchor with more occurrences is looked up window by window instead of by its context.
HOT = 1 << 14
#: Anchors, and bytes of contexts, of neighbouring packs that are sent together, so that a bucket gets few messages.
ANCHORS_SENT, CONTEXTS_SENT = 1 << 19, 1 << 23
#: Stands for a null key: behind every other.
LAST = (1 << 63) - 2
_BITS = np.uint64(48)
_LOW = np.uint64((1 << 48) - 1)
_MULTIPLIER = 0x9E3779B97F4A7C15


def _rolled(b: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` bytes from each position on."""
    power = lambda e: np.uint64(pow(_MULTIPLIER, e, 1 << 64))
    by = {1: b.astype(np.uint64) + np.uint64(1)}
    size = 1
    while 2 * size <= k:
        by[2 * size] = by[size][:-size] * power(size) + by[size][size:]
        size *= 2
    out, have = by[size], size
    for step in sorted(by, reverse=True)[1:]:
        if have + step <= k:
            n = len(b) - have - step + 1
            out = out[:n] * power(step) + by[step][have : have + n]
            have += step
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def _spread(key: np.ndarray) -> np.ndarray:
    """48-bit keys mapped one to one: minimizers crowd at small hashes, what comes out does not."""
    key = (key * np.uint64(_MULTIPLIER)) & _LOW
    key ^= key >> np.uint64(24)
    key = (key * np.uint64(0xD6E8FEB86659FD93)) & _LOW
    return key ^ (key >> np.uint64(24))


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    size, out = 1, x
    while 2 * size <= width:
        out = f(out[:-size], out[size:])
        size *= 2
    n = len(x) - width + 1
    return f(out[:n], out[width - size : width - size + n]) if size < width else out


def anchors(b: np.ndarray, start: np.ndarray, window: int, k: int = ANCHOR, block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """(position, 48-bit key) of the minimizers: each window of ``window`` bytes inside a document
    holds one at least, chosen by the window's content alone. Blocks of positions stay in cache."""
    n, span, none = len(b) - k + 1, window - k + 1, np.uint64(1 << 63)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    edge = np.zeros(span - 1, np.uint64)
    for s in range(0, max(0, n), block):
        e = min(n, s + block)
        lo, hi = max(0, s - span + 1), min(n, e + span - 1)
        x = _rolled(b[lo : hi + k - 1], k) >> (np.uint64(64) - _BITS)
        for end in start[np.searchsorted(start, lo, side="right") : np.searchsorted(start, hi + k - 1)].tolist():  # grams across two documents
            x[max(0, end - k + 1 - lo) : max(0, end - lo)] = none
        if len(x) < span:
            x = np.concatenate([x, np.full(span - len(x), none)])
        low = _sliding(x, span, np.minimum)
        high = _sliding(np.concatenate([edge, low, edge]), span, np.maximum)
        x, high = x[s - lo : e - lo], high[s - lo : e - lo]
        at = np.flatnonzero((x == high) & (x != none))
        found.append((at + s, x[at]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([x for x, _ in found]), _spread(np.concatenate([x for _, x in found]))


def _hashed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes as words, and a hash of each."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    words = wide.view(np.uint64)
    hashed = np.zeros(len(rows), np.uint64)
    for k in range(words.shape[1]):
        hashed = (hashed ^ words[:, k]) * np.uint64(_MULTIPLIER)
        hashed ^= hashed >> np.uint64(29)
    return words, hashed


def _same_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each distinct row, number of the distinct row of each)."""
    words, hashed = _hashed(rows)
    _, first, number = np.unique(hashed, return_index=True, return_inverse=True)
    if not (words == words[first[number]]).all():  # two rows share a hash
        _, first, number = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return first, number.reshape(-1)


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal rank together, which compress better."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes()


def _unplaned(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


class _Pack:
    """The documents of a pack: ids, where each starts, all bytes."""

    def __init__(self, ids: bytes, sizes: bytes, data: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.start = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))])
        self.bytes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, int(self.start[-1]))), np.uint8)

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        return anchors(self.bytes, self.start, window)


def _cells(batch: pa.RecordBatch, *names: str) -> Iterator[list]:
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    for k in range(batch.num_rows):
        yield [c[k].as_py() for c in columns]


def _pack(limit: int):
    """Rows (order, text, rest...) to packs; ``rest`` keeps all further columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        squeeze = zstandard.ZstdCompressor(level=1)

        def out():
            nonlocal number, held, size
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            raw, at = byte_views(table.column(1))
            rest, sink = table.select(list(range(2, table.num_columns))), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema) as writer:
                writer.write_batch(rest)
            ids = table.column(0).to_numpy()
            row = [number, ids.tobytes(), np.diff(at).tobytes(), squeeze.compress(raw[at[0] : at[-1]].tobytes()), squeeze.compress(sink.getvalue().to_pybytes())]
            number, held, size = number + 1, [], 0
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, [pa.int64(), *[pa.binary()] * 4], strict=True)], ["pack", "ids", "sizes", "data", "rest"])

        for batch in batches:
            if not batch.num_rows:
                continue
            _, at = byte_views(batch.column(1))
            s, n = 0, batch.num_rows
            while s < n:
                e = min(n, max(s + 1, int(np.searchsorted(at, at[s] + limit - size, side="right")) - 1))
                held.append(batch.slice(s, e - s))
                size += int(at[e] - at[s])
                s = e
                if size >= limit or s < n:
                    yield out()
        if held:
            yield out()

    return run


def _dealt(keys: list[np.ndarray], buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of the 48-bit keys of several packs, sorted in each: (bucket, which ones of all, (pack, first, count) rows).

    Buckets are ranges of equal width. What a bucket gets stands by pack; ``first`` is its place among the pack's keys.
    """
    size = np.array([len(k) for k in keys], np.int64)
    key = np.concatenate(keys)
    bucket = ((key * np.uint64(buckets)) >> _BITS if buckets < 1 << 16 else key >> np.uint64(16)).astype(np.int64)
    of, place = np.repeat(np.arange(len(keys)), size), np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
    order = np.argsort(bucket, kind="stable")
    bucket, of, place = bucket[order], of[order], place[order]
    new = np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]) if len(key) else np.ones(1, bool)
    edges = np.flatnonzero(new)
    head = np.flatnonzero(new[:-1] | np.concatenate([[True], of[1:] != of[:-1]])) if len(key) else edges[:0]
    parts = np.stack([of[head], place[head], np.diff(np.append(head, len(key)))], axis=1)
    at = np.searchsorted(head, edges)
    for k in range(len(edges) - 1):
        yield int(bucket[edges[k]]), order[edges[k] : edges[k + 1]], parts[at[k] : at[k + 1]]


def _by_pack(pack: np.ndarray, values: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Each pack that occurs, and the bytes of its ``values`` (rows) in their order."""
    order = np.argsort(pack, kind="stable")
    pack, values = pack[order], np.ascontiguousarray(values[order])
    first = np.flatnonzero(np.concatenate([[True], pack[1:] != pack[:-1]]))
    offsets = np.append(first, len(pack)) * (values.nbytes // len(values))
    # 2 GB of answers to a bucket would be some 100 times what it gets
    data = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])
    return pa.array(pack[first], pa.int64()), data


def _seen(window: int, buckets: int):
    """(bucket, parts, keys, counts): the distinct anchors of a few packs, ``parts`` whose they are; odd counts are in several documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        numbers, keys, codes = [], [], []

        def out() -> pa.RecordBatch:
            key, code, rows = np.concatenate(keys), np.concatenate(codes), []
            for b, at, parts in _dealt(keys, buckets):
                parts[:, 0] = np.array(numbers, np.int64)[parts[:, 0]]
                rows.append((b, squeeze.compress(_planes(parts)), squeeze.compress(_planes(key[at].astype("<u8"))), squeeze.compress(_planes(code[at]))))
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64(), *[pa.binary()] * 3], strict=True)], ["bucket", "parts", "keys", "counts"])

        for batch in batches:
            for number, *cells in _cells(batch, "pack", "ids", "sizes", "data"):
                pack = _Pack(*cells)
                at, key = pack.anchors(window)
                if not len(key):
                    continue
                order = np.argsort(key, kind="stable")
                key, doc = key[order], pack.ids[np.searchsorted(pack.start, at[order], side="right") - 1]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                count = np.diff(np.concatenate([first, [len(key)]]))
                several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
                numbers.append(number)
                keys.append(key[first])
                codes.append((np.minimum(count, (1 << 15) - 1) * 2 + several).astype("<u2"))
                if sum(map(len, keys)) >= ANCHORS_SENT:
                    yield out()
                    numbers, keys, codes = [], [], []
        if keys:
            yield out()

    return run


def _shared(hot: int):
    """(pack, keys): each pack's anchors that some other document holds; the top bit marks hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs, keys, counts = [], [], []
        unsqueeze = zstandard.ZstdDecompressor()
        for batch in batches:
            for p, k, c in _cells(batch, "parts", "keys", "counts"):
                parts = _unplaned(unsqueeze.decompress(p), "<i8").reshape(-1, 3)
                packs.append(np.repeat(parts[:, 0], parts[:, 2]))
                keys.append(_unplaned(unsqueeze.decompress(k), "<u8"))
                counts.append(_unplaned(unsqueeze.decompress(c), "<u2"))
        if not packs:
            return
        pack, key, count = np.concatenate(packs), np.concatenate(keys), np.concatenate(counts)
        del packs, keys, counts
        order = np.argsort(key)
        first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        n = np.diff(np.concatenate([first, [len(key)]]))
        total = np.add.reduceat((count[order] >> 1).astype(np.int64), first)
        several = (n > 1) | (np.maximum.reduceat(count[order] & 1, first) > 0)
        keep, is_hot = np.empty(len(key), bool), np.empty(len(key), bool)
        keep[order], is_hot[order] = np.repeat(several, n), np.repeat(several & (total > hot), n)
        marked = (key | (is_hot.astype(np.uint64) << np.uint64(63)))[keep]
        if len(marked):
            yield pa.record_batch([*_by_pack(pack[keep], marked)], ["pack", "keys"])

    return run


_CONTEXTS = ["kind", "bucket", "pack", "blob", "keys", "parts"]


def _contexts(window: int, buckets: int):
    """The distinct contexts of the shared anchors of a few packs, by bucket (kind 0: symbols, key and smallest
    document, whose they are), and where each occurs in its pack (kind 1, in any bucket)."""
    side, width = window - ANCHOR, 2 * window - ANCHOR

    types = [pa.int32(), *[pa.int64()] * 2, *[pa.binary()] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        numbers, keys, docs, held = [], [], [], []

        def out() -> pa.RecordBatch:
            key, doc, symbols, rows = np.concatenate(keys), np.concatenate(docs), np.concatenate(held), []
            for b, at, parts in _dealt(keys, buckets):
                parts[:, 0] = np.array(numbers, np.int64)[parts[:, 0]]
                heads = np.concatenate([key[at].astype("<i8"), doc[at].astype("<i8")])
                rows.append((0, b, None, squeeze.compress(symbols[at].tobytes()), squeeze.compress(_planes(heads)), squeeze.compress(_planes(parts))))
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], _CONTEXTS)

        for batch in batches:
            for number, ids, sizes, data, replies in _cells(batch, "pack", "ids", "sizes", "data", "replies"):
                pack = _Pack(ids, sizes, data)
                shared = np.sort(np.frombuffer(b"".join(replies), np.uint64) & np.uint64((1 << 48) - 1))
                hot = np.frombuffer(b"".join(replies), np.uint64)
                hot = np.sort(hot[hot >> np.uint64(63) > 0] & np.uint64((1 << 48) - 1))
                at, key = pack.anchors(window)
                within = lambda a, b: (a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b) if len(a) else np.zeros(len(b), bool)
                keep = within(shared, key)
                at, key = at[keep], key[keep]
                if not len(at):
                    continue
                of = np.searchsorted(pack.start, at, side="right") - 1
                base = at - side
                symbols = np.zeros(len(pack.bytes) + 2 * side, np.uint8)
                np.add(pack.bytes, np.uint8(1), out=symbols[side : side + len(pack.bytes)])
                rows = np.lib.stride_tricks.sliding_window_view(symbols, width)[at]
                edge = np.flatnonzero((base < pack.start[of]) | (base + width > pack.start[of + 1]))
                place = base[edge, None] + np.arange(width)
                rows[edge] = np.where((place >= pack.start[of[edge]][:, None]) & (place < pack.start[of[edge] + 1][:, None]), rows[edge], np.uint8(0))
                first, name = _same_rows(rows)
                doc, key, rows = pack.ids[of], key[first], rows[first]
                least = np.full(len(first), np.iinfo(np.int64).max)
                np.minimum.at(least, name, doc)
                later = doc != least[name]
                # each window of a hot anchor's contexts goes by itself: equal ones meet, others part
                is_hot = within(hot, key)
                h, c = np.flatnonzero(is_hot), np.flatnonzero(~is_hot)
                views = np.lib.stride_tricks.sliding_window_view(rows[h], window, axis=1)
                of_hot, shift = np.nonzero(views.all(axis=2))
                alone = np.zeros((len(of_hot), width), np.uint8)
                alone[:, :window] = views[of_hot, shift]
                once, window_of = _same_rows(alone) if len(alone) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                window_least = np.full(len(once), np.iinfo(np.int64).max)
                np.minimum.at(window_least, window_of, least[h[of_hot]])
                known, windows = np.zeros(len(h), np.uint32), np.full((len(h), side + 1), -1, np.int32)
                np.bitwise_or.at(known, of_hot, (window_least[window_of] < least[h[of_hot]]).astype(np.uint32) << shift.astype(np.uint32))
                alone = alone[once]
                rows, least = np.concatenate([rows[c], alone]), np.concatenate([least[c], window_least])
                key = np.concatenate([key[c], _hashed(alone)[1] >> (np.uint64(64) - _BITS)])
                order = np.argsort(key, kind="stable")
                number_of = np.empty(len(order), np.int32)
                number_of[order] = np.arange(len(order))
                windows[of_hot, shift] = number_of[len(c) + window_of]
                renamed = np.empty(len(first), np.int32)
                renamed[c], renamed[h] = number_of[: len(c)], len(order) + np.arange(len(h))
                sorted_key, least, rows = key[order], least[order], rows[order]
                head = np.array([len(at), len(order), len(h)], "<i4")
                places = squeeze.compress(b"".join([head.tobytes(), renamed[name].astype("<i4").tobytes(), base.astype("<i4").tobytes(), later.astype("<i4").tobytes(), known.astype("<u4").tobytes(), windows.astype("<i4").tobytes()]))
                yield pa.record_batch([pa.array([x], t) for x, t in zip([1, (number + (number >> 32)) % buckets, number, places, None, None], types, strict=True)], _CONTEXTS)
                if not len(order):
                    continue
                numbers.append(number)
                keys.append(sorted_key)
                docs.append(least)
                held.append(rows)
                if sum(x.nbytes for x in held) >= CONTEXTS_SENT:
                    yield out()
                    numbers, keys, docs, held = [], [], [], []
        if keys:
            yield out()

    return run


def _mark(window: int, limit: int):
    """(pack, marks, places): of each context, the windows that a smaller document holds, as bits.

    The places of the contexts in the packs pass through."""
    width = 2 * window - ANCHOR
    bits = window - ANCHOR + 1

    def indexed(rows: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The smallest document that holds each window of each row; the largest number for none."""
        index = RunIndex(rows, window)
        least = index.groups(docs)
        out = np.full((len(rows), bits), np.iinfo(np.int64).max)
        for column, length, row in index.statistics(rows):
            if column < bits:
                long = np.flatnonzero(length >= window)
                out[long, column] = least[index.group_of.upto(row[long]) - 1]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs, rows, keys, docs, numbers = [], [], [], [], []
        unsqueeze = zstandard.ZstdDecompressor()
        for batch in batches:
            for kind, pack, blob, head, parts in _cells(batch, "kind", "pack", "blob", "keys", "parts"):
                if kind:
                    yield pa.record_batch([pa.array([pack], pa.int64()), pa.array([None], pa.binary()), pa.array([blob], pa.binary())], ["pack", "marks", "places"])
                    continue
                both = _unplaned(unsqueeze.decompress(head), "<i8")
                n = len(both) // 2
                of, start, size = _unplaned(unsqueeze.decompress(parts), "<i8").reshape(-1, 3).T
                packs.append(np.repeat(of, size))
                rows.append(np.frombuffer(unsqueeze.decompress(blob, max_output_size=n * width), np.uint8).reshape(-1, width))
                keys.append(both[:n])
                docs.append(both[n:])
                numbers.append((np.arange(n) + np.repeat(start - (np.cumsum(size) - size), size)).astype("<u4"))
        if not packs:
            return
        rows, key, doc, number = np.concatenate(rows), np.concatenate(keys), np.concatenate(docs), np.concatenate(numbers)
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1], [True]]))
        marks = np.zeros(len(key), np.uint32)
        power = np.uint32(1) << np.arange(bits, dtype=np.uint32)
        group = 0
        while group < len(edges) - 1:
            # whole anchors, as many as an index holds
            stop = max(group + 1, int(np.searchsorted(edges, edges[group] + limit // width, side="right")) - 1)
            at = order[edges[group] : edges[stop]]
            group = stop
            first, name = _same_rows(rows[at])
            if len(first) == len(at) == 1:
                continue
            least = np.full(len(first), np.iinfo(np.int64).max)
            np.minimum.at(least, name, doc[at])
            held = indexed(rows[at[first]], least)
            marks[at] = ((held[name] < doc[at][:, None]) * power).sum(axis=1, dtype=np.uint32)
        some = np.flatnonzero(marks)
        if len(some):
            pack, told = _by_pack(np.concatenate(packs)[some], np.stack([number[some], marks[some]], axis=1).astype("<u4"))
            yield pa.record_batch([pack, told, pa.nulls(len(pack), pa.binary())], ["pack", "marks", "places"])

    return run


def _cover(window: int, keep: str | None):
    """The documents of a pack and what is left of them, as bytes, as text or only in figures."""
    bits = window - ANCHOR + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unsqueeze = zstandard.ZstdDecompressor()
        for batch in batches:
            for ids, sizes, data, rest, places, marks in _cells(batch, "ids", "sizes", "data", "rest", "places", "marks"):
                pack = _Pack(ids, sizes, data)
                n = len(pack.bytes)
                begins = np.zeros(n + 1, bool)
                if places:
                    told = np.frombuffer(unsqueeze.decompress(places), "<i4")
                    (n_places, n_rows, n_hot), told = told[:3].tolist(), told[3:]
                    name, base, later = told[: 3 * n_places].reshape(3, -1)
                    known, windows = told[3 * n_places :][:n_hot].view("<u4"), told[3 * n_places + n_hot :].reshape(n_hot, bits)
                    mark = np.zeros(n_rows, np.uint32)
                    for m in marks or ():
                        which, bit = np.frombuffer(m, "<u4").reshape(-1, 2).T
                        mark[which] = bit
                    # the contexts of hot anchors put their windows' answers together
                    each = np.append(mark & np.uint32(1), np.uint32(0))[windows] << np.arange(bits, dtype=np.uint32)
                    mark = np.concatenate([mark, known | np.bitwise_or.reduce(each, axis=1)])
                    # a later copy in the pack has it all
                    here = np.where(later > 0, np.uint32((1 << bits) - 1), mark[name])
                    for k in range(bits):
                        at = base[(here >> np.uint32(k)) & np.uint32(1) > 0] + k
                        begins[at[(at >= 0) & (at < n)]] = True
                # windows across the end of a document are none
                room = np.zeros(n + 1, bool)
                for s, e in zip(pack.start[:-1].tolist(), pack.start[1:].tolist(), strict=True):
                    room[s : max(s, e - window + 1)] = True
                count = np.cumsum(np.concatenate([[0], (begins & room)[:n]]))
                reach = np.maximum(np.arange(1, n + 1) - window, 0)
                gone = count[1:] > count[reach]
                kept, removed, spans, digests = [], [], [], []
                for s, e in zip(pack.start[:-1].tolist(), pack.start[1:].tolist(), strict=True):
                    part = gone[s:e]
                    left = pack.bytes[s:e][~part].tobytes() if part.any() else pack.bytes[s:e].tobytes()
                    if keep:
                        kept.append(left if keep == "bytes" else left.decode("utf-8", "ignore"))
                    removed.append(int(part.sum()))
                    spans.append(int((part[1:] & ~part[:-1]).sum() + part[0]) if len(part) else 0)
                    digests.append(hashlib.sha256(left).hexdigest())
                with pa.ipc.open_stream(unsqueeze.decompress(rest)) as reader:
                    table = reader.read_all().combine_chunks()
                columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns]
                names = table.schema.names + ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * bool(keep)
                more = [pa.array(np.diff(pack.start)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests), *([pa.array(kept, pa.binary() if keep == "bytes" else pa.string())] if keep else [])]
                yield pa.record_batch([*columns, *more], names)

    return run


def remove_repeats(docs: DataFrame, window: int = 50, carry: tuple[str, ...] = (), keep: str | None = "bytes", key: str = "doc_id", text: str = "text", hot: int = HOT, pack: int = PACK, index: int = INDEX) -> DataFrame:
    """Each document without the bytes that an earlier one holds in a run of ``window`` or more.

    A byte goes if it is covered by a ``window``-byte string that also starts in a document with a
    smaller key; strings are judged on the input. How: documents are packed by about ``pack``
    bytes. Minimizers anchor every window by its content, so that equal windows meet under an
    equal anchor; anchors of one document alone are dropped. The distinct contexts of the shared
    anchors (``window`` bytes around, once per pack) meet by anchor, where a run-compressed
    Burrows-Wheeler index with samples at the run ends is built over at most about ``index``
    symbols; the contexts stream through it for matching statistics, and where a match reaches
    ``window``, the group of its row tells the smallest document that holds it. An anchor with
    more than ``hot`` occurrences is split by its windows: equal ones collapse within a pack,
    others part, so no index grows with it. Anchor hashes only bring candidates together; what is
    removed was compared byte by byte. Nothing is capped.

    Null and short texts lose nothing. Rows with equal keys are no earlier documents of each
    other. A null key is behind every other. ``carry`` names columns to return as they are.
    Empty: empty. Returns doc_id, the carried columns, n_bytes, n_removed, n_spans, kept_sha256
    and, unless ``keep`` is None, what was kept: "bytes", or "text" without the bytes of
    characters that a removed passage splits.
    """
    if keep not in (None, "bytes", "text"):
        raise ValueError("keep is None, bytes or text")
    if not 32 + 8 <= window <= 63:
        raise ValueError("window must be within 40 .. 63")
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("_order"), F.col(text).alias("_text"), F.col(key).cast("long").alias("doc_id"), *carry)
    # dealt by pack before they are kept, so no join moves the texts again
    packs = cut(rows.mapInArrow(_pack(pack), "pack long, ids binary, sizes binary, data binary, rest binary").repartition(n_partitions(spark), "pack"), dealt=True)
    n_packs = packs.count()
    buckets = max(2 * n_partitions(spark), n_packs // 16)
    seen = packs.select("pack", "ids", "sizes", "data").mapInArrow(_seen(window, buckets), "bucket long, parts binary, keys binary, counts binary")
    shared = seen.repartition(buckets, "bucket").mapInArrow(_shared(hot), "pack long, keys binary").groupBy("pack").agg(F.collect_list("keys").alias("replies"))
    shared = cut(shared)  # the anchors have done their part: keeping the answers frees what moved them
    asking = packs.drop("rest").join(shared, "pack")
    found = asking.mapInArrow(_contexts(window, buckets), "kind int, bucket long, pack long, blob binary, keys binary, parts binary")
    told = found.repartition(buckets, "bucket").mapInArrow(_mark(window, index), "pack long, marks binary, places binary")
    told = told.groupBy("pack").agg(F.collect_list("marks").alias("marks"), F.first("places", ignorenulls=True).alias("places"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return packs.join(told, "pack", "left").mapInArrow(_cover(window, keep), f"{head}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + {None: "", "bytes": ", kept binary", "text": ", kept string"}[keep])


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"), keep=None)
