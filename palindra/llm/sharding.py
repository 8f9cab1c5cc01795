"""Sharding by a minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palindra.llm.common import read, utf8_size

#: Ordered cells of the text hash. A cell is the atomic group: equal texts share one.
CELLS = 1 << 16


def _greedy(prefix: np.ndarray, start: int, capacity: int) -> int:
    """The furthest cut after ``start`` whose shard is within ``capacity``."""
    return int(np.searchsorted(prefix, prefix[start] + capacity, side="right")) - 1


def _shards_needed(prefix: np.ndarray, start: int, capacity: int, most: int) -> int:
    used, last = 0, len(prefix) - 1
    while start < last and used <= most:
        start, used = _greedy(prefix, start, capacity), used + 1
    return used


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least capacity at which ``shards`` contiguous runs hold all ``sizes``, by binary search."""
    if not len(sizes):
        return 0
    prefix = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    low, high = max(int(sizes.max()), -(-int(prefix[-1]) // shards)), int(prefix[-1])
    while low < high:
        mid = (low + high) // 2
        if _shards_needed(prefix, 0, mid, shards) <= shards:
            high = mid
        else:
            low = mid + 1
    return low


def minimax_cuts(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each group: contiguous, none above the smallest feasible capacity.

    Within that capacity each cut is the one nearest to an equal share of what remains from
    which the rest still fits, so a single heavy group leaves no empty shards behind it.
    """
    prefix = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    capacity, n, start = smallest_capacity(sizes, shards), len(sizes), 0
    shard = np.zeros(n, np.int32)
    for k in range(shards):
        left = shards - k
        if start >= n:
            break
        most = n if left == 1 else _greedy(prefix, start, capacity)
        goal = prefix[start] + (prefix[n] - prefix[start]) / left
        cut = int(np.searchsorted(prefix, goal))
        if cut > start + 1 and goal - prefix[cut - 1] < prefix[min(cut, n)] - goal:
            cut -= 1
        low = min(max(cut, start + 1), most)
        high = most
        while low < high and left > 1:  # a later cut never makes the rest harder
            if _shards_needed(prefix, low, capacity, left - 1) <= left - 1:
                high = low
            else:
                low += max(1, (high - low) // 2)
        shard[start : high if left > 1 else n] = k
        start = high if left > 1 else n
    return shard


def shard_documents(docs: DataFrame, shards: int = 24, cells: int = CELLS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each row's shard of 0 .. ``shards`` - 1 under the law ``bytes``, and its slot in it.

    A size is the UTF-8 bytes of the text plus 8. Rows with equal texts stay together: the
    ordered atomic groups are ``cells`` residues of the bits from 40 on of the 64-bit text hash, so the table that comes
    to the driver has at most ``cells`` rows whatever the input. Its minimax contiguous partition
    is exact. A second count over cells and sub-cells, at most twice as many, makes the slots
    gapless without numbering a shard in one task; a hot text is numbered in many sub-cells.
    Null and empty texts have 8 bytes and checksum 0, and nulls are one group. Repeated rows each
    get a slot. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (utf8_size(F.col(text)) + 8).alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.pmod(F.shiftrightunsigned(F.xxhash64(F.col(text)), 40), F.lit(cells)).cast("int").alias("cell"),
    )
    table = rows.groupBy("cell").agg(F.sum("size").alias("size"), F.count("*").alias("n")).toPandas().sort_values("cell")
    per = max(64, -(-int(table["n"].sum()) // cells))
    table["subs"] = -(-table["n"] // per)
    table["shard"] = minimax_cuts(table["size"].to_numpy(np.int64), shards) if len(table) else 0
    plan = spark.createDataFrame(table[["cell", "subs", "shard"]].astype("int32") if len(table) else [], "cell int, subs int, shard int")
    rows = rows.join(F.broadcast(plan), "cell").withColumn("sub", F.pmod(F.xxhash64("doc_id"), F.col("subs")).cast("int"))
    slots = rows.groupBy("cell", "sub").agg(F.count("*").alias("n"), F.first("shard").alias("shard")).toPandas().sort_values(["shard", "cell", "sub"])
    slots["first"] = slots["n"].groupby(slots["shard"]).cumsum() - slots["n"] if len(slots) else 0
    first = spark.createDataFrame(slots[["cell", "sub", "first"]].astype({"cell": "int32", "sub": "int32", "first": "int64"}) if len(slots) else [], "cell int, sub int, first long")
    number = F.row_number().over(Window.partitionBy("cell", "sub").orderBy("doc_id", "size", "text_crc32"))
    return (
        rows.withColumn("number", number)
        .join(F.broadcast(first), ["cell", "sub"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("number") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))
