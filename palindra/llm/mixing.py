"""Mixing sources to target weights by the cube method."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from random import Random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palindra.llm.common import cut, read, word_count

#: Units that one task moves at a time; what it leaves open is at most as many as the constraints.
BLOCK = 1024
#: A probability within this of 0 or 1 is settled.
EPS = 1e-9
#: Sources up to this many are sent to all executors with their targets.
BROADCAST_SOURCES = 20_000


def target_shares(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """``share`` of all ``sizes`` by weight, none above ``most`` times its own size.

    What a cap cuts off goes to the sources still below theirs, by weight, until none is above.
    """
    targets, open_ = [0.0] * len(sizes), [k for k, s in enumerate(sizes) if s > 0]
    rest = share * sum(sizes)
    while open_:
        total = sum(weights[k] for k in open_)
        over = [k for k in open_ if rest * weights[k] / total > most * sizes[k]]
        if not over:
            for k in open_:
                targets[k] = rest * weights[k] / total
            break
        for k in over:
            targets[k] = most * sizes[k]
            rest -= targets[k]
        open_ = [k for k in open_ if k not in set(over)]
    return targets


def cube_flight(sizes: list[float], chance: list[float], rng: Random, land: bool = False) -> list[float]:
    """The probabilities after the flight: all but at most two are 0 or 1.

    Each move takes the largest open unit's direction, projected onto the null space of the two
    balance constraints over all open units (sum of sizes, number of units), as far as the first
    unit that settles, up or down at random so that no probability changes on average. Large
    units settle while many small ones can make up for them. With ``land``, the open rest gives
    up first the number of units, then the sizes.
    """
    size, p = np.asarray(sizes, float), np.asarray(chance, float).copy()
    p[p < EPS], p[p > 1 - EPS] = 0.0, 1.0
    open_ = np.flatnonzero((p > 0) & (p < 1))
    open_ = open_[np.argsort(-size[open_], kind="stable")]

    def move(units: np.ndarray, u: np.ndarray) -> np.ndarray:
        q = p[units]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)).min()
            down = np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)).min()
        q = q + (up if rng.random() * (up + down) < down else -down) * u
        q[q < EPS], q[q > 1 - EPS] = 0.0, 1.0
        p[units] = q
        return units[(q > 0) & (q < 1)]

    while len(open_) > 2:
        c = size[open_] - size[open_].mean()
        spread, n = float(c @ c), len(open_)
        free = np.full(n, 1 - 1 / n) - (c * c / spread if spread > 0 else 0)
        k = int(np.argmax(free > 1e-6)) if (free > 1e-6).any() else int(np.argmax(free))
        u = -1 / n - (c * (c[k] / spread) if spread > 0 else np.zeros(n))
        u[k] += 1
        u[np.abs(u) < 1e-13] = 0.0
        if not u.any():
            break
        after = move(open_, u)
        if len(after) == n:  # rounding left all just inside
            p[open_[-1]] = round(p[open_[-1]])
            after = open_[:-1]
        open_ = after
    if len(open_) == 2 and (land or size[open_[0]] == size[open_[1]]):
        a, b = size[open_]
        open_ = move(open_, np.array([1.0, -1.0] if a == b else [max(b, 1e-9), -max(a, 1e-9)]))
    if land:
        for k in open_:
            p[k] = 1.0 if rng.random() < p[k] else 0.0
    return p.tolist()


def _flight(seed: int, land: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def fly(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "spot", "doc_id"], ascending=[False, True, True]).reset_index(drop=True)
        key = f"{seed}|{rows['source_no'][0]}|{rows['block'][0]}|{land}".encode()
        rng = Random(int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "big"))
        return rows.assign(chance=cube_flight(rows["size"].astype(float).tolist(), rows["chance"].tolist(), rng, land))

    return fly


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """How many words of each document the mix takes.

    A document's size is its words (null or wordless text: 0). Sources in code point order, null
    last, weigh ``weights`` in turn and share ``share`` of all sizes, each at most ``most`` times
    its own size, the excess shared anew. A source's rate is its target over its size. Every
    document is taken the whole part of the rate; the fraction is an inclusion probability that
    cube sampling makes 0 or 1, keeping both the tokens and the documents of each source. The
    flight runs in blocks of ``block`` units of one source, so a hot source is many blocks; two
    open units at most are left of each and fly again together, until one block per source is
    left, and lands. Units fly by descending size, so what is left to land is small. Units are dealt
    by a hash of their key, source and size, which also seeds the moves: reruns agree.

    Rows equal in key, source and size are interchangeable and make one unit, however many they
    are: n of them with a fraction f are taken floor(n f) times, and the unit flies with what
    is left of n f. So neither a hot key nor null keys fill a block. Documents of size 0 are taken
    0 words. Texts are read once. One row per source comes to the driver. Empty: empty.
    Returns doc_id, source, size, source_size, target, copies, taken.
    """
    spark = docs.sparkSession
    alike = ["doc_id", "source", "size"]
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.spark_partition_id().alias("part"))
    rows = cut(rows.groupBy(*alike, "part").agg(F.count("*").alias("n")))
    table = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.countDistinct(F.struct("doc_id", "size")).alias("n")).toPandas()
    table = table.sort_values("source", key=lambda c: c.map(lambda x: (1, b"") if pd.isna(x) else (0, x.encode("utf-8", "surrogatepass"))))
    sizes = [int(x) for x in table["source_size"]]
    targets = target_shares(sizes, [weights[k % len(weights)] for k in range(len(sizes))], share, most)
    records = [(None if pd.isna(s) else s, no, size, t, (t / size if size else 0.0), max(1, -(-int(n) // block))) for no, (s, size, t, n) in enumerate(zip(table["source"], sizes, targets, table["n"], strict=True))]
    plan = spark.createDataFrame(records, "source string, source_no int, source_size long, target double, rate double, blocks int")
    plan = F.broadcast(plan) if len(records) <= BROADCAST_SOURCES else plan
    same = Window.partitionBy(*alike)
    parts = rows.withColumn("before", F.coalesce(F.sum("n").over(same.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("n").over(same))
    fraction = F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(0.0) * F.col("all")
    parts = parts.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("doc_id", "d.source", "size", "n", "before", "source_no", "source_size", "target", "blocks", F.floor("rate").cast("long").alias("whole"), fraction.alias("fraction"), "all")
    parts = parts.withColumn("some", F.floor(F.col("fraction") + EPS).cast("long")).withColumn("chance", F.greatest(F.col("fraction") - F.col("some"), F.lit(0.0)))
    spot = F.xxhash64("doc_id", "source_no", "size", F.lit(seed))
    units = parts.where((F.col("before") == 0) & (F.col("chance") > EPS))
    moving = units.select("doc_id", "size", "source_no", spot.alias("spot"), "chance", F.pmod(F.shiftright(spot, 7), F.col("blocks")).cast("int").alias("block"))
    schema, most_blocks, picked = moving.schema, max((r[5] for r in records), default=1), []
    while True:
        land = most_blocks == 1
        flown = moving.groupBy("source_no", "block").applyInPandas(_flight(seed, land), schema)
        flown = flown if land else cut(flown)
        picked.append(flown.where(F.col("chance") == 1.0))
        if land:
            break
        per = max(1, block // 2)  # two units at most came from each block
        most_blocks = -(-most_blocks // per) if most_blocks > per else 1
        moving = flown.where((F.col("chance") > 0.0) & (F.col("chance") < 1.0)).withColumn("block", F.pmod(F.shiftright("spot", 23), F.lit(most_blocks)).cast("int"))
    extra = picked[0]
    for more in picked[1:]:
        extra = extra.unionByName(more)
    extra = extra.select(F.col("doc_id").alias("id"), F.col("source_no").alias("no"), F.col("size").alias("s"), F.lit(1).alias("one"))
    base = parts.join(extra, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("source_no") == F.col("no")) & (F.col("size") == F.col("s")), "left")
    # of equal rows the first take the extra copies
    base = base.withColumn("extra", F.col("some") + F.coalesce("one", F.lit(0))).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    copies = F.col("whole") + F.when(F.col("before") + F.col("k") <= F.col("extra"), 1).otherwise(0)
    return base.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
