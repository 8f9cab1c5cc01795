"""Overlapping candidates: clusters of intervals and the best of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palindra.functions.running import before

ORDER = ["lts", "rts", "a", "b", "len"]
#: Bases of a bucket in which running maxima are folded before the buckets' are.
BUCKET = 1 << 17


def first_of_file(arms: DataFrame) -> DataFrame:
    """The first row of each file by contig and position, whether skipped or not."""
    return arms.groupBy("file").agg(F.min(F.struct("contig_no", *ORDER, "rte", "skip")).alias("x")).select("file", "x.*")


def clusters(arms: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The live rows with ``cluster``: rows of a contig whose [lts, rte] overlap in a chain.

    A file's first row counts even where it is skipped: it can bridge two live rows.
    """
    live = arms.where(~F.col("skip")).withColumn("phantom", F.lit(False))
    ghost = first_of_file(arms).where("skip").withColumn("phantom", F.lit(True))
    rows = live.unionByName(ghost, allowMissingColumns=True)
    at = F.floor(F.col("lts") / bucket)
    rows = before(rows, "rte", "_reach", ["file", "contig_no"], ORDER, at, "max")
    rows = rows.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("lts") > F.col("_reach")), 1).otherwise(0).cast("long"))
    rows = before(rows, "_new", "_earlier", ["file", "contig_no"], ORDER, at, "sum")
    return rows.withColumn("cluster", F.col("_earlier") + F.col("_new")).where(~F.col("phantom")).drop("_reach", "_new", "_earlier", "phantom")


def best_per_cluster(rows: DataFrame) -> DataFrame:
    """The row of each cluster with the highest ``sim``; the first in order on ties."""
    columns = [c for c in rows.columns if c not in ("file", "contig_no", "cluster")]
    rank = F.struct("sim", *[(-F.col(c)).alias(f"_{c}") for c in ORDER])
    found = rows.groupBy("file", "contig_no", "cluster").agg(F.max_by(F.struct(*columns), rank).alias("x"))
    return found.select("file", "contig_no", "cluster", "x.*")
