"""Embedding near-duplicates by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palindra.llm.common import cut, n_partitions, read, unnamed
from palindra.llm.graph import components, local_components
from palindra.llm.vectors import finite, matrix, packed, unit

#: Leading principal dimensions that make the grid, and those that bound a block's box.
GRID, BOX = 6, 16
#: Vectors in a block; rows that fit the principal dimensions; intervals that make one above them.
BLOCK, SAMPLE, FAN = 2048, 4096, 8
#: Blocks on either side of a tile of block pairs: a task gets each of its blocks once.
TILE = 8


def _order(bases: dict[int, np.ndarray], eps: float):
    """(dim, cell, id, n, v): the grid cell of each unit vector on the leading dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = unit(matrix(part.column(3), dim))
                cells = np.floor(x @ bases[dim][:, :GRID] / eps).astype(np.int32) if dim in bases else np.zeros((len(x), 1), np.int32)
                yield pa.record_batch([part.column(0), pa.array(cells.tolist(), pa.list_(pa.int32())), part.column(1), part.column(2), part.column(3)], ["dim", "cell", "id", "n", "v"])

    return run


def _blocks(bases: dict[int, np.ndarray], rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, dim, table in packed(batches, rows):
            x = matrix(table.column(4).combine_chunks() if isinstance(table.column(4), pa.ChunkedArray) else table.column(4), dim)
            u = unit(x)
            y = u @ bases[dim][:, :BOX] if dim in bases else np.zeros((len(u), 1))
            yield pa.record_batch([
                pa.array([number], pa.int64()), pa.array([dim], pa.int32()), pa.array([y.min(axis=0).tolist()]), pa.array([y.max(axis=0).tolist()]),
                pa.array([table.column(2).to_numpy().tobytes()], pa.binary()), pa.array([table.column(3).to_numpy().tobytes()], pa.binary()), pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()),
            ], ["block", "dim", "low", "high", "ids", "ns", "vs"])

    return run


def _apart(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """A lower bound of the squared distance between points of two boxes."""
    gap = F.zip_with(F.zip_with(low_a, high_b, lambda x, y: x - y), F.zip_with(low_b, high_a, lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(gap, F.lit(0.0), lambda total, g: total + g * g)


def _join(cosine: float, eps: float, bases: dict[int, np.ndarray], dtype: str, leaf: int = 512):
    """Of each pair of blocks of a tile: the links of each vector, counted (kind 0), and a spanning forest (kind 1).

    A tile's left blocks come first and are held; its right ones stream by, each with its partners."""

    def close(y: np.ndarray, a: slice, z: np.ndarray, b: slice) -> bool:
        p, q = y[a], z[b]
        gap = np.maximum(0, np.maximum(p.min(axis=0) - q.max(axis=0), q.min(axis=0) - p.max(axis=0)))
        return float(gap @ gap) <= eps * eps

    def intervals(y, a, z, b, same):
        """Leaves of the recursion over two sequence intervals that may hold links."""
        if (same and a.start > b.start) or not close(y, a, z, b):
            return
        n, m = a.stop - a.start, b.stop - b.start
        if n <= leaf and m <= leaf:
            yield a, b
            return
        halves = lambda s: [s] if s.stop - s.start <= leaf else [slice(s.start, (s.start + s.stop) // 2), slice((s.start + s.stop) // 2, s.stop)]
        for p in halves(a):
            for q in halves(b):
                yield from intervals(y, p, z, q, same)

    def links(dim: int, same: bool, sides: list[tuple[bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        ids, ns = [np.frombuffer(x[0], np.int64) for x in sides], [np.frombuffer(x[1], np.int64) for x in sides]
        u = [unit(np.frombuffer(x[2], dtype).reshape(-1, dim)) for x in sides]
        y = [x @ bases[dim][:, :BOX] if dim in bases else x for x in u]
        counts, n = [np.zeros(len(x), np.int64) for x in u], len(ids[0])
        child, root = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a, b in intervals(y[0], slice(0, len(u[0])), y[1], slice(0, len(u[1])), same):
            i, j = np.nonzero(u[0][a] @ u[1][b].T >= cosine)
            i, j = i + a.start, j + b.start
            if same:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            counts[0] += np.bincount(i, ns[1][j], len(counts[0])).astype(np.int64)
            counts[1] += np.bincount(j, ns[0][i], len(counts[1])).astype(np.int64)
            j = j if same else j + n
            label = local_components(n + (0 if same else len(ids[1])), np.concatenate([child, i]), np.concatenate([root, j]))
            child = np.flatnonzero(label != np.arange(len(label)))
            root = label[child]
        name = ids[0] if same else np.concatenate(ids)
        total = counts[0] + counts[1] if same else np.concatenate(counts)
        some = np.flatnonzero(total)
        if len(some):
            kind = np.repeat(np.array([0, 1], np.int32), [len(some), len(child)])
            yield pa.record_batch([pa.array(kind), pa.array(np.concatenate([name[some], name[child]])), pa.array(np.concatenate([total[some], name[root]]))], ["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                p, q, block, dim, partners, *data = (batch.column(batch.schema.get_field_index(c))[k].as_py() for c in ("p", "q", "block", "dim", "partners", "ids", "ns", "vs"))
                if (p, q) != here:
                    here, held = (p, q), {}
                if partners is None:
                    held[block] = data
                for a in partners or ():
                    yield from links(dim, a == block, [held[a], data])

    return run


def _interval_pairs(blocks: DataFrame, count: int, eps: float) -> DataFrame:
    """(a, b), a <= b: block numbers that the recursion over sequence intervals leaves.

    Level by level, the pairs of intervals that may hold links are joined with their parts on the
    interval's number, and the parts whose boxes are provably further apart than ``eps`` go.
    """
    parts = blocks.select("block", "dim", "low", "high")
    levels, width = [parts], 1
    while width < count:
        width *= FAN
        below = levels[-1]
        flat = below.select(F.floor(F.col("block") / FAN).alias("block"), "dim", F.posexplode(F.arrays_zip("low", "high")).alias("k", "x"))
        boxes = flat.groupBy("block", "dim", "k").agg(F.min("x.low").alias("l"), F.max("x.high").alias("h")).groupBy("block", "dim").agg(F.sort_array(F.collect_list(F.struct("k", "l", "h"))).alias("x"))
        levels.append(boxes.select("block", "dim", F.col("x.l").alias("low"), F.col("x.h").alias("high")))
    top = levels[-1]
    pairs = top.select(F.col("block").alias("a"), F.col("block").alias("b"), "dim")
    for below in reversed(levels[:-1]):
        a = below.select(F.floor(F.col("block") / FAN).alias("a"), "dim", F.col("block").alias("pa"), F.col("low").alias("la"), F.col("high").alias("ha"))
        b = below.select(F.floor(F.col("block") / FAN).alias("b"), "dim", F.col("block").alias("pb"), F.col("low").alias("lb"), F.col("high").alias("hb"))
        pairs = pairs.join(a, ["a", "dim"]).join(b, ["b", "dim"]).where((F.col("pa") <= F.col("pb")) & (_apart(F.col("la"), F.col("ha"), F.col("lb"), F.col("hb")) <= eps * eps)).select(F.col("pa").alias("a"), F.col("pb").alias("b"), "dim")
    return pairs


def near_vectors(rows: DataFrame, cosine: float = 0.95, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Each vector's number of direct links, its component (smallest key reachable) and whether it stays.

    Links join vectors of the same dimension with cosine >= ``cosine`` in double precision. Equal
    vectors collapse to one first and count with their multiplicity. Unit vectors within the
    cosine are within ``eps`` of each other, so they are sorted by the grid cells (side ``eps``)
    of their leading principal dimensions, cut into blocks, and the sequence is joined with
    itself recursively, in the plan down to blocks and within a task down to leaves, leaving out
    intervals whose boxes are further apart than ``eps``. The principal dimensions come from at
    most ``SAMPLE`` vectors; they only steer the order, and every bound holds for any of them.
    A task sends back counts and a spanning forest, never pairs.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing.
    Repeated rows are other vectors. Rows with a null key link like any other; a component without
    a key is null, and so is ``kept`` of rows without one. Empty: empty.
    """
    spark, eps = rows.sparkSession, float(np.sqrt(max(0.0, 2 - 2 * cosine))) * (1 + 1e-9) + 1e-9
    kind = "float" if dict(rows.dtypes)[vector] == "array<float>" else "double"
    rows = rows.select(F.col(key).alias("vec_id"), F.col(vector).cast(f"array<{kind}>").alias("v"))
    linking = finite(F.col("v")) & F.exists("v", lambda x: x != 0)
    distinct = cut(rows.where(linking).groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).select(F.size("v").alias("dim"), F.coalesce("id", unnamed("v")).alias("id"), F.col("id").isNull().alias("unnamed"), "n", "v"))
    sample: dict[int, list] = {}
    for dim, v in distinct.select("dim", "v").orderBy(F.xxhash64("id")).limit(SAMPLE).collect():
        sample.setdefault(dim, []).append(v)
    bases = {}
    for dim, vs in sample.items():
        x = unit(np.array(vs, float))
        bases[dim] = np.linalg.svd(x - x.mean(axis=0), full_matrices=True)[2].T if len(x) > 1 else np.eye(dim)
    p = n_partitions(spark)
    ordered = distinct.drop("unnamed").mapInArrow(_order(bases, eps), f"dim int, cell array<int>, id long, n long, v array<{kind}>")
    ordered = ordered.repartitionByRange(p, "dim", "cell", "id").sortWithinPartitions("dim", "cell", "id")
    packs = cut(ordered.mapInArrow(_blocks(bases, block), "block long, dim int, low array<double>, high array<double>, ids binary, ns binary, vs binary"))
    # consecutive numbers: partitions are as many as the session has, blocks in them are counted
    where = F.shiftright("block", 32)
    starts, total = [], 0
    for part, n in sorted(packs.groupBy(where.alias("p")).agg((F.max(F.col("block")) - F.shiftleft(F.max(where), 32) + 1).alias("n")).collect()):
        starts.append((part, total))
        total += n
    start = spark.createDataFrame(starts, "p long, start long")
    packs = packs.withColumn("p", where).join(F.broadcast(start), "p").withColumn("block", F.col("block") - F.shiftleft("p", 32) + F.col("start")).drop("p", "start")
    pairs = cut(_interval_pairs(packs, total, eps))
    # tiles of block pairs: what several pairs share moves once
    tiles = pairs.select(F.floor(F.col("a") / TILE).alias("p"), F.floor(F.col("b") / TILE).alias("q"), "a", "b")
    content = packs.select("block", "dim", "ids", "ns", "vs")
    left = tiles.select("p", "q", F.col("a").alias("block")).distinct().join(content, "block").withColumn("partners", F.lit(None).cast("array<long>"))
    right = tiles.groupBy("p", "q", F.col("b").alias("block")).agg(F.sort_array(F.collect_list("a")).alias("partners")).join(content, "block")
    joined = left.unionByName(right).repartition(max(p, pairs.count() // TILE), "p", "q").sortWithinPartitions("p", "q", F.col("partners").isNotNull(), "block")
    dtype = "<f4" if kind == "float" else "<f8"
    out = cut(joined.mapInArrow(_join(cosine, eps, bases, dtype), "kind int, a long, b long"))
    links = out.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("links"))
    groups = components(out.where("kind = 1").select("a", "b"))
    classes = distinct.join(links, "id", "left").join(groups, "id", "left").select("v", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component_id"))
    # a component whose smallest id is a stand-in has no key
    stand_in = distinct.where("unnamed").select(F.col("id").alias("component_id"), "unnamed")
    classes = classes.join(stand_in, "component_id", "left").select("v", "n", "links", F.when(F.col("unnamed").isNull(), F.col("component_id")).alias("component_id"))
    rest = rows.where(~F.coalesce(linking, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = rows.where(linking).join(classes, "v").select("vec_id", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    return found.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op4_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


#: Every pair of usable vectors, and what is reachable over the links.
ORACLE = """
WITH RECURSIVE u AS (
  SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS norm FROM (SELECT vec_id, list_transform(embedding, lambda c: c::DOUBLE) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0) WHERE list_dot_product(x, x) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.95
), r(id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.other FROM r JOIN l ON l.a = r.id
), c AS (SELECT id, min(other) AS component_id FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON id = vec_id LEFT JOIN n ON n.a = vec_id
"""
