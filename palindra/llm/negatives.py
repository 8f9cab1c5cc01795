"""Hard negatives by a Voronoi-partitioned exact neighbour join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palindra.llm.common import cut, read
from palindra.llm.metric import LAST, Group, Lists, assign, blocks, fit, groups, home_places, meet, served, within
from palindra.llm.vectors import finite

#: Candidates in a block, anchors in a group, classes that labels are dealt to, scores held at a time.
BLOCK, GROUP, CLASSES, AT_ONCE = 1024, 1024, 64, 1 << 20
#: Components saturate here, scores at the ends of long.
MOST = 1 << 53


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of ``x`` and ``y``, exact within long."""
    top = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(y.astype(float)).max(initial=0)) * x.shape[1]
    if top < 2**53:
        return (x.astype(float) @ y.astype(float).T).astype(np.int64)
    if top < 2**62:
        return x.astype(np.int64) @ y.astype(np.int64).T
    return np.clip(x.astype(object) @ y.astype(object).T, -LAST, LAST).astype(np.int64)


class _Positives:
    """Each anchor's first rows of its own label. ``known`` has what full lists end with so far."""

    def __init__(self, g: int, q: Group, known: list[dict], k: int):
        self.g, self.q, self.lists = g, q, Lists(len(q.ids), k, np.int64)
        for x in known:
            self.lists.bar[x["at"]], self.lists.last[x["at"]] = x["bar"], x["last"]

    def take(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, more: bytes) -> None:
        for label in np.unique(labels).tolist():
            here, mine = np.flatnonzero(labels == label), np.flatnonzero(self.q.labels == label)
            step = max(1, AT_ONCE // max(1, len(here)))
            for s in range(0, len(mine), step):
                at = mine[s : s + step]
                score = products(self.q.x[at], x[here])
                i, j = np.nonzero((score >= self.lists.bar[at][:, None]) & (ids[here] != self.q.ids[at][:, None]))
                self.lists.add(at[i], score[i, j], ids[here[j]])

    def out(self) -> Iterator[pa.RecordBatch]:
        at = self.lists.at
        yield pa.record_batch([pa.array([self.g] * len(at), pa.int64()), pa.array(at), pa.array(self.q.ids[at]), pa.array(self.lists.name), pa.array(self.lists.score)], ["g", "at", "anchor_id", "positive_id", "positive_score"])


class _Negatives:
    """Of each anchor and positive, the first rows of another label in the positive's window of scores."""

    def __init__(self, g: int, q: Group, known: list[dict], k: int, low: int, high: int):
        self.g, self.q, self.known = g, q, known
        at = np.array([x["at"] for x in known], np.int64)
        # ceil(low / 100 * score) to floor(high / 100 * score)
        self.least = np.array([-(-low * x["positive_score"] // 100) for x in known], np.int64)
        self.most = np.array([min(high * x["positive_score"] // 100, LAST) for x in known], np.int64)
        #: Windows of each anchor, and the least and most that any of them takes.
        self.lists, self.asks = Lists(len(known), k, np.int64), np.unique(at[self.least <= self.most])
        self.from_, self.to = np.full(len(q.ids), LAST), np.full(len(q.ids), -LAST)
        open_ = self.least <= self.most
        np.minimum.at(self.from_, at[open_], self.least[open_])
        np.maximum.at(self.to, at[open_], self.most[open_])
        order = np.argsort(at, kind="stable")
        self.first, self.count = np.searchsorted(at[order], np.arange(len(q.ids))), np.bincount(at, minlength=len(q.ids))
        self.window = order

    def take(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, more: bytes) -> None:
        step = max(1, AT_ONCE // max(1, len(ids)))
        for s in range(0, len(self.asks), step):
            at = self.asks[s : s + step]
            score = products(self.q.x[at], x)
            i, j = np.nonzero((score >= self.from_[at][:, None]) & (score <= self.to[at][:, None]) & (labels != self.q.labels[at][:, None]))
            value, name, of = score[i, j], ids[j], at[i]
            for r in range(int(self.count.max(initial=0))):
                w = self.window[np.minimum(self.first[of] + r, len(self.window) - 1)]
                ok = np.flatnonzero((r < self.count[of]) & (value >= self.least[w]) & (value <= self.most[w]))
                self.lists.add(w[ok], value[ok], name[ok])

    def out(self) -> Iterator[pa.RecordBatch]:
        w = self.lists.at
        told = [self.known[k] for k in w.tolist()]
        longs = [[self.g] * len(w), *([x[c] for x in told] for c in ("at", "place", "anchor_id", "positive_id", "positive_score"))]
        yield pa.record_batch([*(pa.array(v, pa.int64()) for v in longs), pa.array(self.lists.name), pa.array(self.lists.score)], ["g", "at", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor's
    first ``positives`` rows of its label, the first ``negatives`` of another label whose score is
    ``low`` to ``high`` percent of the positive's.

    Components become floor(``scale`` * x); a score is the integer inner product with the anchor,
    higher ones are first, ties by smaller key. Vectors are lifted so that larger products are
    nearer, and assigned to the nearest of the pivots. Candidates are packed by label, cell and
    distance to the pivot, anchors in groups of neighbouring cells. Each group first meets its own
    cells of its own labels; what its anchors have then bounds the cells and distances that may still
    serve it (``served``), and only such blocks are sent to it. The positives' windows bound those
    for the negatives in the same way. What meets is joined exactly.

    Rows with a null label, or vectors that are null, empty or hold null or non-finite components,
    take no part; zero vectors do. Vectors of other dimensions than the anchor's are no candidates.
    Rows of the anchor's key are the anchor and no positive; repeated rows are candidates each, and a repeated anchor has its rows again. A row
    without a key is no anchor, ranks behind others of its score and is returned without one.
    Components beyond +-2**53 saturate there, scores at the ends of long. Fewer rows than asked for:
    all of them; a negative positive has no window. Empty: empty.
    """
    x = F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("long"))
    rows = rows.where(finite(F.col(vector)) & F.col(label).isNotNull()).select(F.coalesce(F.col(key), F.lit(LAST)).alias("vec_id"), F.col(label).cast("long").alias("label"), x.alias("v"), F.coalesce(is_anchor & F.col(key).isNotNull(), F.lit(False)).alias("query"))
    rows = rows.select(F.size("v").alias("dim"), F.pmod("label", F.lit(CLASSES)).cast("int").alias("class"), "vec_id", "label", "v", "query")
    cells, n, n_anchors = fit(rows)
    assigned = cut(assign(rows, cells))
    content, asking = blocks(assigned, cells, n, BLOCK), groups(assigned, cells, n_anchors, GROUP)

    best = Window.partitionBy("g", "at").orderBy(F.desc("positive_score"), "positive_id")
    ranked = lambda df: df.withColumn("place", F.row_number().over(best).cast("long")).where(F.col("place") <= positives)
    kind = "g long, at long, anchor_id long, positive_id long, positive_score long"
    positive = lambda g, q, known: _Positives(g, q, known, positives)
    home = home_places(asking)
    near = cut(ranked(meet(home.join(content.select("place", "block"), "place").select("g", "block"), content, asking, cells, positive, kind)))
    full = near.where(F.col("place") == positives).select("g", "at", F.col("positive_score").alias("bar"), F.col("positive_id").alias("last"))
    reach = served(asking, full.select("g", "at", F.col("bar").cast("double").alias("bar")), cells).join(home.withColumnRenamed("place", "part"), ["g", "part"], "left_anti")
    far = meet(within(reach, content), content, asking, cells, positive, kind, full)
    found = cut(ranked(near.drop("place").unionByName(far)))

    bars = found.where("positive_score >= 0").groupBy("g", "at").agg((F.min("positive_score").cast("double") * low / 100 - 1).alias("bar"))
    reach = served(asking, bars, cells, own_class=False, default=np.inf)
    kind = "g long, at long, place long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    mined = meet(within(reach, content, own_class=False), content, asking, cells, lambda g, q, known: _Negatives(g, q, known, negatives, low, high), kind, found)
    rank = F.row_number().over(Window.partitionBy("g", "at", "place").orderBy(F.desc("negative_score"), "negative_id"))
    named = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias(c)
    return mined.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", named("positive_id"), "rank", named("negative_id"), "positive_score", "negative_score")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


#: Every anchor against every row.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_sum(list_transform(list_zip(a.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND (c.vec_id <> a.vec_id OR c.label <> a.label) AND len(c.x) = len(a.x)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
