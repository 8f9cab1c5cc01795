"""Approximate nearest neighbours by vantage-point trees, one per shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palindra.llm.common import cut, read
from palindra.llm.metric import LAST, Cells, Group, Lists, assign, blocks, fit, groups, home_places, meet, served, within
from palindra.llm.vectors import finite

#: Vectors in a shard and in a leaf of its tree; queries in a group.
SHARD, LEAF, GROUP = 4096, 64, 1024
#: How much shorter than proven the searched distance is. 1 is exact.
RELAX = 5.0


def _halves(s: int, e: int) -> int:
    """Where the outer half of the node s .. e begins; its vantage point stands at s."""
    return s + 1 + (e - s - 1) // 2


def _inner(n: int) -> int:
    """Nodes of a tree of ``n`` vectors that are no leaves."""
    return 0 if n <= LEAF else 1 + _inner((n - 1) // 2) + _inner(n - 1 - (n - 1) // 2)


def build(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds): rows in the order of the tree, and of each inner node, in preorder, the least
    and most distance to its vantage point of its inner and of its outer half."""
    order, bounds = [], []

    def split(rows: np.ndarray) -> None:
        if len(rows) <= LEAF:
            order.append(rows)
            return
        # from the far end of the node: its spheres cut the rest into flatter shells than a central one's
        point = int(np.linalg.norm(z[rows] - z[rows].mean(axis=0), axis=1).argmax())
        order.append(rows[point : point + 1])
        rest = np.delete(rows, point)
        far = np.linalg.norm(z[rest] - z[rows[point]], axis=1)
        by = np.argsort(far, kind="stable")
        m = len(rest) // 2
        bounds.append((far[by[0]], far[by[m - 1]], far[by[m]], far[by[-1]]))
        split(rest[by[:m]])
        split(rest[by[m:]])

    split(np.arange(len(z)))
    return np.concatenate(order), np.array(bounds, float).reshape(-1, 4)


class _Search:
    """The nearest so far of each query of a group; all queries walk a shard's tree together."""

    def __init__(self, g: int, q: Group, known: list[dict], k: int, cells: Cells, relax: float):
        self.g, self.q, self.cells, self.relax = g, q, cells, relax
        self.z, self.lists = cells.asked(q.x), Lists(len(q.ids), k, float)
        self.x = q.x.astype(float)
        self.slack = 1e-12 * (1 + np.sqrt((self.x * self.x).sum(axis=1) * cells.most[q.dim]))
        for x in known:
            self.lists.bar[x["at"]], self.lists.last[x["at"]] = x["bar"], x["last"]
        self.reach = cells.reach(q.x, self.lists.bar)

    def _score(self, at: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        about = self.x[at] @ x.T
        i, j = np.nonzero((about >= (self.lists.bar - self.slack)[at][:, None]) & (ids != self.q.ids[at][:, None]))
        if not len(i):
            return
        i, score = at[i], np.zeros(len(i))
        for k in range(x.shape[1]):  # one order of summing for every pair: equal vectors have equal scores
            score += self.x[i, k] * x[j, k]
        self.lists.add(i, score, ids[j])
        self.reach[at] = self.cells.reach(self.x[at], self.lists.bar[at])

    def take(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, more: bytes) -> None:
        z, x, bounds = self.cells.lifted(x), x.astype(float), np.frombuffer(more).reshape(-1, 4)
        every = np.arange(len(self.q.ids))

        def halves(node: int, s: int, e: int) -> list[tuple[int, int, int]]:
            m = _halves(s, e)
            return [(node + 1, s + 1, m), (node + 1 + _inner(m - s - 1), m, e)]

        # first every query goes down to the leaf that it lies in, so that its list has an end to go by
        todo, leaf = [(0, 0, len(ids), every)], np.zeros(len(every), np.int64)
        while todo:
            node, s, e, at = todo.pop()
            if e - s <= LEAF:
                self._score(at, ids[s:e], x[s:e])
                leaf[at] = s
                continue
            inside = np.linalg.norm(self.z[at] - z[s], axis=1) <= bounds[node, 1:3].mean()
            todo += [(*half, at[mine]) for half, mine in zip(halves(node, s, e), (inside, ~inside), strict=True) if mine.any()]
        # then to all other nodes that its reach meets
        todo = [(0, 0, len(ids), every, np.zeros(len(every)))]
        while todo:
            node, s, e, at, gap = todo.pop()
            at = at[gap * self.relax <= self.reach[at]]
            if e - s <= LEAF:
                at = at[leaf[at] != s]
            if not len(at):
                continue
            if e - s <= LEAF:
                self._score(at, ids[s:e], x[s:e])
                continue
            self._score(at, ids[s : s + 1], x[s : s + 1])
            far = np.linalg.norm(self.z[at] - z[s], axis=1)
            a, b, c, d = bounds[node]
            gaps = np.maximum(0, np.maximum(a - far, far - b)), np.maximum(0, np.maximum(c - far, far - d))
            todo += [(*half, at, gap) for half, gap in zip(halves(node, s, e), gaps, strict=True)]

    def out(self) -> Iterator[pa.RecordBatch]:
        at = self.lists.at
        yield pa.record_batch([pa.array([self.g] * len(at), pa.int64()), pa.array(at), pa.array(self.q.ids[at]), pa.array(self.lists.name), pa.array(self.lists.score)], ["g", "at", "query_id", "vec_id", "score"])


def nearest(rows: DataFrame, is_query: Column, k: int = 20, relax: float = RELAX, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): ``k`` rows of about the largest inner product with each query.

    Vectors are lifted into a metric in which larger products are nearer. They are sharded by the
    cell of their nearest pivot and the distance to it, ``shard`` at most in one; a shard carries the vantage-point tree of its vectors.
    A group of queries first searches the shards of its own cells. What it found bounds which others may hold more,
    and only these are sent to it. In a shard, a half of a node is left out where the triangle
    inequality puts it further away than the last of the query's list; all such distances are shortened by ``relax``,
    which leaves out more and may miss some. At 1 the result is exact. Scores are summed in double precision on the
    vectors as they are; ties go to the smaller key.

    Vectors that are null, empty, zero or hold null or non-finite components take no part. Candidates are
    all other rows of the query's dimension but those of its key; repeated rows are candidates each, and a repeated query has its
    rows again. A row without a key is no query, ranks behind others of its score and is returned without one.
    Fewer than ``k`` candidates: all that are found. Empty: empty.
    """
    if relax < 1:
        raise ValueError("relax is 1 or more")
    kind = "float" if dict(rows.dtypes)[vector] == "array<float>" else "double"
    rows = rows.select(F.coalesce(F.col(key), F.lit(LAST)).alias("vec_id"), F.col(vector).cast(f"array<{kind}>").alias("v"), F.coalesce(is_query & F.col(key).isNotNull(), F.lit(False)).alias("query"))
    rows = rows.where(finite(F.col("v")) & F.exists("v", lambda x: x != 0))
    rows = rows.select(F.size("v").alias("dim"), F.lit(0).alias("class"), "vec_id", F.lit(0).cast("long").alias("label"), "v", "query")
    cells, n, n_queries = fit(rows, "<f4" if kind == "float" else "<f8")
    assigned = cut(assign(rows, cells))

    def arrange(x: np.ndarray) -> tuple[np.ndarray, bytes]:
        order, bounds = build(cells.lifted(x))
        return order, bounds.tobytes()

    content, asking = blocks(assigned, cells, n, shard, arrange), groups(assigned, cells, n_queries, GROUP)
    first = Window.partitionBy("g", "at").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    search = lambda g, q, known: _Search(g, q, known, k, cells, relax)
    schema = "g long, at long, query_id long, vec_id long, score double"
    home = home_places(asking)
    near = cut(ranked(meet(home.join(content.select("place", "block"), "place").select("g", "block"), content, asking, cells, search, schema)))
    full = near.where(F.col("rank") == k).select("g", "at", F.col("score").alias("bar"), F.col("vec_id").alias("last"))
    reach = served(asking, full.select("g", "at", "bar"), cells, relax=relax).join(home.withColumnRenamed("place", "part"), ["g", "part"], "left_anti")
    far = meet(within(reach, content), content, asking, cells, search, schema, full)
    found = ranked(near.drop("rank").unionByName(far))
    return found.select("query_id", "rank", F.when(F.col("vec_id") != LAST, F.col("vec_id")).alias("vec_id"), "score")


def op13_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
