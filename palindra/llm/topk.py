"""Exact top-k inner products over vectors sorted by length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palindra.llm.common import cut, n_partitions, read
from palindra.llm.vectors import finite, matrix, packed

#: Rotated dimensions of the first partial sum; rows of a candidate block and of a query block.
HEAD, BLOCK, QUERIES = 24, 1024, 512
#: Rows that fit the rotation, and candidate blocks that one task streams at most, about.
SAMPLE, STREAM = 4096, 64
#: Components saturate here, scores at the ends of their type. A null key counts as the largest.
MOST, LAST = 1 << 53, (1 << 63) - 1


def _blocks(rows: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, dim, table in packed(batches, rows):
            v = table.column(3).combine_chunks() if isinstance(table.column(3), pa.ChunkedArray) else table.column(3)
            yield pa.record_batch([
                pa.array([number], pa.int64()), pa.array([dim], pa.int32()), pa.array([table.column(1)[0].as_py()], pa.float64()),
                pa.array([table.column(2).to_numpy().tobytes()], pa.binary()), pa.array([np.ascontiguousarray(matrix(v, dim)).astype(kind).tobytes()], pa.binary()),
            ], ["block", "dim", "square", "ids", "vs"])

    return run


class _Best:
    """The ``k`` highest (score, then smallest id) of each query so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rotation: np.ndarray, k: int, bar: np.ndarray | None = None):
        self.ids, self.x, self.k = ids, x, k
        y = x @ rotation
        self.head, self.length = y[:, :HEAD], np.sqrt((x.astype(float) ** 2).sum(axis=1))
        self.tail = np.sqrt((y[:, HEAD:] ** 2).sum(axis=1))
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        #: What a score must reach: that of the list's last, or of ``k`` rows seen before.
        self.bar = np.full(len(ids), -np.inf) if bar is None else bar.copy()

    def take(self, ids: np.ndarray, x: np.ndarray, rotation: np.ndarray) -> bool:
        """Goes through a block; False if no vector as long or shorter can enter any list."""
        length = np.sqrt((x.astype(float) ** 2).sum(axis=1))
        slack = 1e-9 * (1 + self.length * (length.max() if len(length) else 0))
        bar = self.bar - slack  # equal scores still compete by id
        if (self.length * length.max() < bar).all():
            return False
        z = x @ rotation
        tail = np.sqrt((z[:, HEAD:] ** 2).sum(axis=1))
        open_ = np.flatnonzero(self.length * length.max() >= bar)
        bound = self.head[open_] @ z[:, :HEAD].T + np.outer(self.tail[open_], tail)
        fits = bound >= bar[open_][:, None]
        for q, row in zip(open_.tolist(), fits, strict=True):
            at = np.flatnonzero(row)
            at = at[ids[at] != self.ids[q]]
            if not len(at):
                continue
            wide = object if self.length[q] * length.max() >= 1 << 62 else np.int64
            score = x[at].astype(wide) @ self.x[q].astype(wide)
            score, name = np.concatenate([self.best[q][0], score]), np.concatenate([self.best[q][1], ids[at]])
            order = np.lexsort((name, -score)) if score.dtype != object else np.array(sorted(range(len(score)), key=lambda k: (-score[k], name[k])))
            order = order[: self.k]
            self.best[q] = score[order], name[order]
            if len(order) == self.k:
                self.bar[q] = max(self.bar[q], float(score[order[-1]]))
        return True


def _search(rotations: dict[int, np.ndarray], k: int, type_: str):
    """Streams (block of queries, then candidate blocks by descending length) of one stripe after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, best, live = None, None, False

        def out():
            for at, (q, (score, name)) in enumerate(zip(best.ids.tolist(), best.best, strict=True)):
                if len(name):
                    same = lambda v, n=len(name): pa.array([v] * n, pa.int64())
                    yield pa.record_batch([same(here[0]), same(at), same(q), pa.array(name), pa.array(["%d" % s for s in score.tolist()], pa.string())], ["q", "at", "query_id", "vec_id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                q, stripe, dim, kind, ids, vs, bars = (batch.column(batch.schema.get_field_index(c))[row].as_py() for c in ("q", "stripe", "dim", "kind", "ids", "vs", "bars"))
                ids, x = np.frombuffer(ids, np.int64), np.frombuffer(vs, type_).reshape(-1, dim)
                if (q, stripe) != here:
                    if best is not None:
                        yield from out()
                    here, best, live = (q, stripe), None, True
                if kind == 0:
                    best = _Best(ids, x, rotations[dim], k, np.frombuffer(bars) if bars else None)
                elif live and best is not None:
                    live = best.take(ids, x, rotations[dim])
        if best is not None:
            yield from out()

    return run


def _meet(pairs: DataFrame, candidates: DataFrame, queries: DataFrame, bars: DataFrame | None, rotations: dict[int, np.ndarray], k: int, kind: str, p: int) -> DataFrame:
    """(q, at, query_id, vec_id, score): the best of each query among the blocks of ``pairs`` (q, block), dealt to stripes."""
    n_blocks, n_queries = candidates.count(), queries.count()
    stripes = max(1, min(p, n_blocks), -(-n_blocks // STREAM))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bar = np.full(len(row["ids"]) // 8, -np.inf)
                for x in row["told"] or ():
                    bar[x["at"]] = x["bar"]
                yield pa.record_batch([pa.array([row["q"]], pa.int64()), pa.array([bar.tobytes()], pa.binary())], ["q", "bars"])

    left = queries.select(F.col("block").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), "dim", F.lit(0).alias("kind"), F.lit(0.0).alias("square"), "block", "ids", "vs")
    if bars is None:
        left = left.withColumn("bars", F.lit(None).cast("binary"))
    else:
        told = queries.select(F.col("block").alias("q"), "ids").join(bars.groupBy("q").agg(F.collect_list(F.struct("at", "bar")).alias("told")), "q", "left")
        left = left.join(told.mapInArrow(held, "q long, bars binary"), "q")
    right = pairs.join(candidates, "block").select("q", F.pmod(F.xxhash64("block"), F.lit(stripes)).cast("int").alias("stripe"), "dim", F.lit(1).alias("kind"), "square", "block", "ids", "vs", F.lit(None).cast("binary").alias("bars"))
    streams = left.unionByName(right).repartition(max(p, n_queries * stripes // 4), "q", "stripe").sortWithinPartitions("q", "stripe", "kind", F.desc("square"), "block")
    return streams.mapInArrow(_search(rotations, k, kind), "q long, at long, query_id long, vec_id long, score string")


def top_products(rows: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products.

    Components become floor(``scale`` * x); candidates are all rows of the query's dimension but
    the query's own key; ties go to the smaller key. Candidates are sorted by descending length
    and packed into blocks. Queries first meet the block of the longest vectors; its scores are bars, and of the others only
    the blocks that may reach the bar of some query of a block by their length are sent to it, dealt to stripes; a task holds one block
    of queries and streams a stripe. A list's lowest score is the bar: a stripe ends where the product of the
    lengths is below every bar, a candidate is dropped where the partial sum over ``HEAD``
    SVD-rotated dimensions plus the product of the remaining lengths is below it. What stays is
    scored in integers. The stripes' lists, ``k`` rows each, are merged by query. The rotation is
    fit on at most ``SAMPLE`` rows and affects only how much is pruned.

    Vectors that are null, empty or hold null or non-finite components take no part. Zero vectors
    do. Fewer than ``k`` candidates: all of them. Repeated rows are candidates each. A row without
    a key ranks behind others of its score and is returned without one. Components beyond
    +-2**53 saturate there; scores are compared exactly and returned within long. Empty: empty.
    """
    spark = rows.sparkSession
    ints = rows.where(finite(F.col(vector))).select(
        F.coalesce(F.col(key), F.lit(LAST)).alias("vec_id"), F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("long")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query")
    ).select(F.size("v").alias("dim"), F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")).alias("square"), "vec_id", "v", "query")
    sample: dict[int, list] = {}
    for dim, v in ints.select("dim", "v").orderBy(F.xxhash64("vec_id")).limit(SAMPLE).collect():
        sample.setdefault(dim, []).append(v)
    dims = [r[0] for r in ints.where("query").select("dim").distinct().collect()]
    rotations = {dim: np.linalg.svd(np.array(sample.get(dim, [[0] * dim]), float), full_matrices=True)[2].T for dim in dims}
    p, schema = n_partitions(spark), "block long, dim int, square double, ids binary, vs binary"
    order = [F.col("dim"), F.desc("square"), F.col("vec_id")]
    widest = ints.agg(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda t, x: F.greatest(t, F.abs(x)))), F.count("*"), F.sum(F.col("query").cast("long"))).first()
    kind = next(t for t, top in (("<i2", 2**15), ("<i4", 2**31), ("<i8", np.inf)) if (widest[0] or 0) < top)

    def pack(df: DataFrame, size: int, rows: int) -> DataFrame:
        parts = max(1, min(p, -(-rows // size)))  # no more than there are blocks
        ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).coalesce(parts)
        return cut(ranged.select("dim", "square", "vec_id", "v").mapInArrow(_blocks(size, kind), schema))

    candidates, queries = pack(ints.drop("query"), BLOCK, widest[1]), pack(ints.where("query").drop("query"), QUERIES, widest[2] or 0)
    # first the block of the longest vectors of each dimension: its scores are bars that others must reach
    heads = queries.select(F.col("block").alias("q"), "dim")
    longest = candidates.groupBy("dim").agg(F.max_by("block", F.struct("square", -F.col("block"))).alias("block"))
    blocks = candidates.select("block", "dim", "square")
    found = cut(_meet(heads.join(longest, "dim").select("q", "block"), candidates, queries, None, rotations, k, kind, p))
    bars = found.groupBy("q", "at").agg(F.count("*").alias("n"), F.min(F.col("score").cast("decimal(38,0)")).cast("double").alias("bar")).where(F.col("n") >= k).select("q", "at", "bar")
    # then those whose length allows what some query of a block still wants
    size = queries.select(F.col("block").alias("q"), "dim", F.sqrt("square").alias("length"), (F.length("ids") / 8).cast("long").alias("n"))
    wanted = size.join(bars.groupBy("q").agg(F.min("bar").alias("bar"), F.count("*").alias("full")), "q", "left")
    least = F.when(F.col("full") == F.col("n"), F.col("bar")).otherwise(F.lit(float("-inf")))
    rest = wanted.select("q", "dim", "length", least.alias("bar")).join(blocks, "dim").where(F.col("length") * F.sqrt("square") * (1 + 1e-9) >= F.col("bar")).select("q", "block", "dim")
    rest = rest.join(longest, ["dim", "block"], "left_anti").select("q", "block")
    found = found.unionByName(_meet(rest, candidates, queries, bars, rotations, k, kind, p)).withColumn("exact", F.col("score").cast("decimal(38,0)"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("exact"), "vec_id"))
    named = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias(c)
    score = F.greatest(F.least("exact", F.lit(LAST)), F.lit(-LAST)).cast("long").alias("score")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(named("query_id"), "rank", named("vec_id"), score)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


#: Brute force in SQL; queries are the stated subset, candidates all rows.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
