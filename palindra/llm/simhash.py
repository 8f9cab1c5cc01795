"""SimHash near-duplicates through deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palindra.llm.common import byte_views, cut, n_partitions, pieces, read, small_batches, unnamed
from palindra.llm.graph import components, local_components

SEGMENTS, WIDTH = 2, 32
#: Buckets up to this size are compared pair by pair; larger ones by looking up each neighbour.
PAIRWISE = 512
#: Index rows that a task holds as arrays at a time, and those of a partition, about.
TOGETHER, PART = 1 << 18, 1 << 21


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of the word shingles of ``text`` (A-Z lowered), repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[s:e], seed) for s, e in zip((end - size)[: len(words) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)])
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 17):
        part = np.frombuffer(hashes, np.uint8, min(1 << 17, len(hashes) - at), at)
        bits += np.unpackbits(part.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes) // 8).tobytes(), "big")


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                raw, at = byte_views(batch.column(1))
                prints = np.array([fingerprint(raw[s:e].tobytes(), shingle, seed) for s, e in zip(at[:-1], at[1:], strict=True)], np.uint64)
                yield pa.record_batch([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    return run


def _near(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of ``prints`` (distinct, of one bucket) under ``distance`` bits."""
    n, a, b = len(prints), [], []
    if n <= PAIRWISE:
        i, j = np.nonzero(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= distance, 1))
        a, b = [i], [j]
    else:  # the varying bits are few: a bucket fixes all but one of its segment's
        order = np.argsort(prints)
        ranked = prints[order]
        free = [np.uint64(1 << k) for k in range(64) if int(np.bitwise_or.reduce(prints ^ prints[0])) >> k & 1]

        def look(mask: np.uint64, start: int, left: int) -> None:
            for k in range(start, len(free)):
                m = mask | free[k]
                at = np.minimum(np.searchsorted(ranked, ranked ^ m), n - 1)
                hit = np.flatnonzero((ranked[at] == (ranked ^ m)) & (at > np.arange(n)))
                a.append(order[hit])
                b.append(order[at[hit]])
                if left > 1:
                    look(m, k + 1, left - 1)

        masks = sum(len(free) ** k for k in range(1, distance + 1))
        if masks < n * 20:
            look(np.uint64(0), 0, distance)
        else:
            for s in range(0, n, 256):
                i, j = np.nonzero(np.bitwise_count(prints[s : s + 256, None] ^ prints[None, :]) <= distance)
                keep = i + s < j
                a.append(i[keep] + s)
                b.append(j[keep])
    i, j = np.concatenate(a or [np.zeros(0, int)]), np.concatenate(b or [np.zeros(0, int)])
    label = local_components(n, i, j)
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def _links(distance: int):
    """Forests of the links in each run of equal keys of a sorted partition, about ``TOGETHER`` rows at a time and a key at least."""

    def of(key: np.ndarray, prints: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([first, [len(key)]]))
        a, b = [], []
        small = size <= 8
        # small buckets all at once, by the distance of two members in the order
        end = np.repeat(first + size, size)
        in_small = np.repeat(small, size)
        for gap in range(1, 8):
            i = np.flatnonzero(in_small & (np.arange(len(key)) + gap < end))
            i = i[np.bitwise_count(prints[i] ^ prints[i + gap]) <= distance]
            a.append(ids[i])
            b.append(ids[i + gap])
        for s, n in zip(first[~small].tolist(), size[~small].tolist(), strict=True):
            child, root = _near(prints[s : s + n], distance)
            a.append(ids[s + child])
            b.append(ids[s + root])
        a, b = np.concatenate(a), np.concatenate(b)
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = local_components(len(nodes), at[: len(a)], at[len(a) :])
        child = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.record_batch([pa.array(nodes[child]), pa.array(nodes[label[child]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < TOGETHER:
                continue
            key, prints, ids = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(3))
            whole = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if whole:
                yield of(key[:whole], prints[:whole].view(np.uint64), ids[:whole])
            held = [pa.record_batch([pa.array(v[whole:]) for v in (key, prints, ids)], ["key", "print", "id"])]
            rows = len(key) - whole
        if held:
            key, prints, ids = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(3))
            yield of(key, prints.view(np.uint64), ids)

    return run


def _variants(no: int, segment: Column, width: int = WIDTH) -> Column:
    """Keys of a segment with each of its bits cleared in turn, told apart by segment and bit."""

    def key(bit: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit).bitwiseXOR(F.lit((1 << width) - 1))
        return F.shiftleft((F.lit(no * width) + bit).cast("long"), WIDTH).bitwiseOR(segment.bitwiseAND(mask))

    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), key)


def simhash_groups(docs: DataFrame, distance: int = 3, shingle: int = 3, seed: int = 42, key: str = "doc_id", text: str = "text", segments: int = SEGMENTS) -> DataFrame:
    """Each row's fingerprint and component (the smallest key reachable over links).

    Two fingerprints link at ``distance`` (1 to 3, or to 7 with 4 ``segments``) or fewer differing
    bits. A fingerprint is cut into two segments of 32 bits (four of 16), so that one segment of a
    linked pair differs by at most one bit. Each distinct fingerprint is indexed under the
    one-wildcard variants of every segment, 64 in all; an equality on the variant makes the candidates, which are verified on all bits.
    Copies collapse to one fingerprint before, so a group of copies costs one entry. A bucket's
    links leave as a spanning forest, never as all pairs; large buckets are looked up by neighbour
    masks. Nothing is capped, no link between different fingerprints is lost.

    Null, empty and blank texts have fingerprint 0 and link like any other. Texts of fewer words
    than a shingle hash as a whole. Repeated rows return as often as they come. Rows without a key
    link like any other; the component of a group without any key is null. Empty: empty.
    """
    if segments not in (2, 4):
        raise ValueError("segments is 2 or 4")
    if not 1 <= distance <= 2 * segments - 1:
        raise ValueError("n segments with one wildcard cover at most 2 n - 1 differing bits")
    width = 64 // segments
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    prints = cut(rows.mapInArrow(_fingerprints(shingle, seed), "doc_id long, print long"))
    distinct = prints.groupBy("print").agg(F.min("doc_id").alias("id")).select("print", F.coalesce("id", unnamed("print")).alias("id"), F.col("id").isNull().alias("unnamed"))
    parts = [F.shiftrightunsigned("print", no * width).bitwiseAND(F.lit((1 << width) - 1)) for no in range(segments)]
    variants = F.flatten(F.array(*[_variants(no, segment, width) for no, segment in enumerate(parts)]))
    p = max(n_partitions(spark), -(-distinct.count() * 64 // PART))  # by the size of the index
    index = distinct.select(F.explode(variants).alias("key"), "print", "id").repartition(p, "key").sortWithinPartitions("key")
    links = index.mapInArrow(_links(distance), "a long, b long")
    found = components(links)
    member = distinct.join(found, "id", "left").select("print", "unnamed", F.coalesce("component", "id").alias("component_id"))
    # a component whose smallest id is a stand-in has no key
    stand_in = distinct.where("unnamed").select(F.col("id").alias("component_id"), F.lit(True).alias("nameless"))
    member = member.join(stand_in, "component_id", "left").select("print", F.when(F.col("nameless").isNull(), F.col("component_id")).alias("component_id"))
    return prints.join(member, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read(spark, sf_dir, "documents"))
