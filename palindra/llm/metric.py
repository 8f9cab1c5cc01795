"""Largest inner products as nearest neighbours: lifted vectors, Voronoi cells, blocks, and who may serve whom.

With a component sqrt(most - |x|^2) more for candidates and 0 for queries, the squared distance is
|q|^2 + most - 2 q x: the nearest candidate is the one of the largest inner product, in a metric.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palindra.llm.common import cut, n_partitions
from palindra.llm.vectors import matrix, packed

#: Rows that fit the pivots; pivots of a dimension at most; candidate blocks that a task streams, about.
SAMPLE, CELLS, STREAM = 4096, 256, 64
#: Stands for a null key: behind all others of its score.
LAST = (1 << 63) - 1
#: place = dim << 16 | class << 10 | cell
_CLASS, _CELL = 6, 10


class Cells:
    """Of each dimension: the largest square of a vector and the pivots, which are few; tasks get a copy."""

    def __init__(self, most: dict[int, float], pivots: dict[int, np.ndarray], kind: str):
        self.most, self.pivots, self.kind = most, pivots, kind

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Candidates in the metric."""
        x = x.astype(float)
        return np.concatenate([x, np.sqrt(np.maximum(0, self.most[x.shape[1]] - (x * x).sum(axis=1)))[:, None]], axis=1)

    def asked(self, x: np.ndarray) -> np.ndarray:
        """Queries in the metric."""
        return np.concatenate([x.astype(float), np.zeros((len(x), 1))], axis=1)

    def slack(self, dim: int) -> float:
        """More than the rounding of any distance here."""
        return 1e-6 * (1 + np.sqrt(self.most[dim]))

    def reach(self, x: np.ndarray, bar: np.ndarray) -> np.ndarray:
        """How far from each query a candidate may be whose inner product reaches ``bar``."""
        x = x.astype(float)
        with np.errstate(over="ignore"):
            return np.sqrt(np.maximum(0, (x * x).sum(axis=1) + self.most[x.shape[1]] - 2 * bar)) + self.slack(x.shape[1])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T))


def _pivots(z: np.ndarray, count: int) -> np.ndarray:
    """Centres of ``count`` cells at most, neighbours near each other in their order."""
    p = np.unique(z, axis=0)
    p = p[np.random.default_rng(7).permutation(len(p))[:count]]
    for _ in range(4):
        cell = distances(z, p).argmin(axis=1)
        p = np.array([z[cell == k].mean(axis=0) for k in np.unique(cell)])
    centred = p - p.mean(axis=0)
    return p[np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")]


def fit(rows: DataFrame, kind: str | None = None) -> tuple[Cells, int, int]:
    """(cells, rows, queries) of (dim, vec_id, v, query); ``kind`` is the type that holds a component, found if None.

    Dimensions are taken to be few. The pivots come from at most ``SAMPLE`` rows and steer only how
    much is left out: every bound holds for any of them.
    """
    size = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    widest = F.max(F.aggregate("v", F.lit(0.0), lambda t, x: F.greatest(t, F.abs(x.cast("double")))))
    told = rows.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("query").cast("long")).alias("queries"), F.max(size).alias("most"), widest.alias("widest")).collect()
    kind = kind or next(k for k, top in (("<i2", 2**15 - 1), ("<i4", 2**31 - 1), ("<i8", np.inf)) if max([0.0, *(r.widest for r in told)]) <= top)
    cells = Cells({r.dim: r.most * (1 + 1e-12) for r in told}, {}, kind)
    sample: dict[int, list] = {}
    for r in rows.select("dim", "v").orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).collect():
        sample.setdefault(r.dim, []).append(r.v)
    for r in told:
        z = cells.lifted(np.array(sample.get(r.dim, [[0] * r.dim]), float))
        cells.pivots[r.dim] = _pivots(z, min(CELLS, max(4, round(r.n**0.5 / 8))))
    return cells, sum(r.n for r in told), sum(r.queries for r in told)


def assign(rows: DataFrame, cells: Cells) -> DataFrame:
    """(dim, place, dist, vec_id, label, query, v) of (dim, class, vec_id, label, query, v): the cell of each row and
    the distance to its pivot; the components as bytes. A query has its own cell where it is told apart, as ``home``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = matrix(part.column(5), dim)
                far, home = distances(cells.lifted(x), cells.pivots[dim]), distances(cells.asked(x), cells.pivots[dim]).argmin(axis=1)
                cell = far.argmin(axis=1)
                group = (dim << 16) + (part.column(1).to_numpy().astype(np.int64) << _CELL)
                raw = np.ascontiguousarray(x).astype(cells.kind)
                yield pa.record_batch([part.column(0), pa.array(group + cell), pa.array(group + home), pa.array(far[np.arange(len(x)), cell]), *part.columns[2:5], pa.array([v.tobytes() for v in raw], pa.binary())], ["dim", "place", "home", "dist", "vec_id", "label", "query", "v"])

    return rows.select("dim", "class", "vec_id", "label", "query", "v").mapInArrow(run, "dim int, place long, home long, dist double, vec_id long, label long, query boolean, v binary")


def _packing(rows: int, arrange: Callable[[np.ndarray], tuple[np.ndarray, bytes]] | None, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, place, table in packed(batches, rows):
            ids, labels, dist = (table.column(k).to_numpy() for k in (1, 2, 3))
            x = np.frombuffer(b"".join(table.column(4).to_pylist()), kind).reshape(len(ids), -1)
            order, more = arrange(x) if arrange else (np.arange(len(ids)), b"")
            yield pa.record_batch([pa.array([number], pa.int64()), pa.array([place], pa.int64()), pa.array([dist.min()]), pa.array([dist.max()]), *(pa.array([v[order].tobytes()], pa.binary()) for v in (ids, labels)), pa.array([x[order].tobytes()], pa.binary()), pa.array([more], pa.binary())], _BLOCK)

    return run


_BLOCK = ["block", "place", "low", "high", "ids", "labels", "vs", "more"]


def blocks(assigned: DataFrame, cells: Cells, n: int, rows: int, arrange=None) -> DataFrame:
    """Candidates by cell and distance to its pivot, up to ``rows`` of one cell in a block, written once.

    ``arrange`` may order the rows of a block and add bytes, such as an index.
    """
    p = max(1, min(n_partitions(assigned.sparkSession), -(-n // rows)))
    ordered = assigned.repartitionByRange(p, "place", "dist", "vec_id").sortWithinPartitions("place", "dist", "vec_id").coalesce(p)
    out = ordered.select("place", "vec_id", "label", "dist", "v").mapInArrow(_packing(rows, arrange, cells.kind), "block long, place long, low double, high double, ids binary, labels binary, vs binary, more binary")
    return cut(out)


def groups(assigned: DataFrame, cells: Cells, n: int, rows: int) -> DataFrame:
    """Queries (g, dim, homes, ids, labels, vs), neighbouring cells together, ``rows`` in a group at most, written once."""
    p = max(1, -(-n // rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, dim, table in packed(batches, rows):
            yield pa.record_batch([pa.array([number], pa.int64()), pa.array([dim], pa.int32()), *(pa.array([table.column(k).to_numpy().tobytes()], pa.binary()) for k in (1, 2, 3)), pa.array([b"".join(table.column(4).to_pylist())], pa.binary())], ["g", "dim", "homes", "ids", "labels", "vs"])

    ordered = assigned.where("query").repartitionByRange(p, "dim", "home", "vec_id").sortWithinPartitions("dim", "home", "vec_id").coalesce(p)
    return cut(ordered.select("dim", "home", "vec_id", "label", "v").mapInArrow(run, "g long, dim int, homes binary, ids binary, labels binary, vs binary"))


class Group:
    """A group of queries in a task."""

    def __init__(self, kind: str, dim: int, homes: bytes, ids: bytes, labels: bytes, vs: bytes, bars: dict[int, float] | None = None, default: float = -np.inf):
        self.dim, self.homes, self.ids, self.labels = dim, np.frombuffer(homes, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.x = np.frombuffer(vs, kind).reshape(-1, dim)
        self.bar = np.full(len(self.ids), default)
        for at, bar in (bars or {}).items():
            self.bar[at] = bar


def home_places(asking: DataFrame) -> DataFrame:
    """(g, place): the places of each group's queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, homes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = np.unique(np.frombuffer(homes, np.int64))
                yield pa.record_batch([pa.array([g] * len(place), pa.int64()), pa.array(place)], ["g", "place"])

    return asking.select("g", "homes").mapInArrow(run, "g long, place long")


def served(asking: DataFrame, bars: DataFrame, cells: Cells, own_class: bool = True, relax: float = 1.0, default: float = -np.inf) -> DataFrame:
    """(g, part, low, high): which cells, at which distances to their pivots, may hold what a group still wants.

    ``bars`` (g, at, bar) has the least inner product that counts, per query, ``default`` if it has
    none: at -infinity nothing is excluded, at infinity nothing is asked for. ``part`` is a place, or with ``own_class`` false
    a place without its class. By the triangle inequality a candidate within reach R of query q has a distance to its
    pivot within R of q's; and a cell is out where the half space nearer its pivot than q's is
    further than R. With ``relax`` above 1, reaches are that much shorter, and some are missed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q = Group(cells.kind, row["dim"], row["homes"], row["ids"], row["labels"], row["vs"], {x["at"]: x["bar"] for x in row["bars"] or ()}, default)
                pivots = cells.pivots[q.dim]
                wants = q.bar < np.inf
                reach = np.full(len(q.ids), np.inf)
                known = wants & (q.bar > -np.inf)
                reach[known] = cells.reach(q.x[known], q.bar[known]) / relax
                far = distances(cells.asked(q.x), pivots)
                own = far.argmin(axis=1)
                between = np.maximum(distances(pivots, pivots)[own], 1e-300)
                near = far[np.arange(len(far)), own][:, None]
                beyond = np.where(np.arange(len(pivots)) == own[:, None], -np.inf, (far * far - near * near) / (2 * between) - cells.slack(q.dim))
                open_ = wants[:, None] & (beyond <= reach[:, None])
                low, high = np.where(open_, far - reach[:, None], np.inf), np.where(open_, far + reach[:, None], -np.inf)
                kinds = q.homes >> _CELL if own_class else np.full(len(q.ids), q.dim << _CLASS)
                for kind in np.unique(kinds).tolist():
                    mine = kinds == kind
                    l, h = low[mine].min(axis=0), high[mine].max(axis=0)
                    cell = np.flatnonzero(l <= h)
                    yield pa.record_batch([pa.array([row["g"]] * len(cell), pa.int64()), pa.array((kind << _CELL) + cell), pa.array(l[cell]), pa.array(h[cell])], ["g", "part", "low", "high"])

    told = bars.groupBy("g").agg(F.collect_list(F.struct("at", "bar")).alias("bars"))
    return asking.join(told, "g", "left").select("g", "dim", "homes", "ids", "labels", "vs", "bars").mapInArrow(run, "g long, part long, low double, high double")


def without_class(place):
    """A place without its class."""
    return F.shiftleft(F.shiftright(place, 16), 16).bitwiseOR(place.bitwiseAND(F.lit((1 << _CELL) - 1)))


def within(reach: DataFrame, content: DataFrame, own_class: bool = True) -> DataFrame:
    """(g, block): the blocks that ``reach``, as ``served`` has it, meets."""
    part = F.col("place") if own_class else without_class(F.col("place"))
    spans = content.select("block", part.alias("part"), F.col("low").alias("from"), F.col("high").alias("to"))
    return reach.join(spans, "part").where((F.col("from") <= F.col("high")) & (F.col("to") >= F.col("low"))).select("g", "block")


def meet(pairs: DataFrame, content: DataFrame, asking: DataFrame, cells: Cells, make, schema: str, known: DataFrame | None = None) -> DataFrame:
    """What ``make(group, known rows)`` tells of each group after it took the blocks of its ``pairs`` (g, block).

    A group's blocks are dealt to stripes, so that a task streams about ``STREAM`` of them and holds one.
    ``known`` (g, ...) comes with its group, and must be bounded by it.
    """
    spark = pairs.sparkSession
    p, n_blocks, n_groups = n_partitions(spark), content.count(), asking.count()
    stripes = max(1, min(p, n_blocks), -(-n_blocks // STREAM))
    right = pairs.join(content.select("block", "ids", "labels", "vs", "more"), "block").select("g", F.pmod(F.xxhash64("block"), F.lit(stripes)).cast("int").alias("stripe"), "block", F.lit(None).cast("int").alias("dim"), F.lit(None).cast("binary").alias("homes"), "ids", "labels", "vs", "more")
    left = asking.select("g", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), F.lit(-1).cast("long").alias("block"), "dim", "homes", "ids", "labels", "vs", F.lit(None).cast("binary").alias("more"))
    fields = [c for c in known.columns if c != "g"] if known is not None else []
    told = (known if fields else pairs.limit(0).select("g", F.lit(0).alias("nothing"))).groupBy("g").agg(F.collect_list(F.struct(*(fields or ["nothing"]))).alias("known"))
    rows = left.join(told, "g", "left").unionByName(right.withColumn("known", F.lit(None).cast(told.schema["known"].dataType)))
    streams = rows.repartition(max(p, n_groups * stripes // 4), "g", "stripe").sortWithinPartitions("g", "stripe", "block")
    names = ("g", "stripe", "block", "dim", "homes", "ids", "labels", "vs", "more", "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, used = None, False
        for batch in batches:
            for k in range(batch.num_rows):
                g, _, block, dim, homes, ids, labels, vs, more, known_ = (batch.column(batch.schema.get_field_index(c))[k].as_py() for c in names)
                if block == -1:
                    if used:
                        yield from work.out()
                    work, used = make(g, Group(cells.kind, dim, homes, ids, labels, vs), known_ or []), False
                else:
                    work.take(np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(vs, cells.kind).reshape(-1, work.q.dim), more)
                    used = True
        if used:
            yield from work.out()

    return streams.mapInArrow(run, schema)


class Lists:
    """The ``k`` first (highest score, then smallest id) of each of ``n`` lists so far."""

    def __init__(self, n: int, k: int, dtype):
        self.k, self.n = k, n
        self.at, self.score, self.name = np.zeros(0, np.int64), np.zeros(0, dtype), np.zeros(0, np.int64)
        #: The score, and the id, that a full list's last has.
        self.bar = np.full(n, np.iinfo(dtype).min if np.issubdtype(dtype, np.integer) else -np.inf, dtype)
        self.last = np.full(n, LAST)

    def add(self, at: np.ndarray, score: np.ndarray, name: np.ndarray) -> None:
        some = (score > self.bar[at]) | (score == self.bar[at]) & (name <= self.last[at])
        if not some.any():
            return
        at, score, name = (np.concatenate(x) for x in ((self.at, at[some]), (self.score, score[some]), (self.name, name[some])))
        order = np.lexsort((name, -score, at))
        at = at[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        rank = np.arange(len(at)) - np.repeat(first, np.diff(np.concatenate([first, [len(at)]])))
        order, full = order[rank < self.k], order[rank == self.k - 1]
        self.bar[at[rank == self.k - 1]], self.last[at[rank == self.k - 1]] = score[full], name[full]
        self.at, self.score, self.name = at[rank < self.k], score[order], name[order]
