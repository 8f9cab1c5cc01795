"""GFF3 records of six features as element rows, and comparison of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palindra.functions.running import before
from palindra.plans.pipeline import COORDINATES

#: Features of a record in order: full, duplication, body, arm, arm, duplication.
FEATURES = 6


def gff_records(lines: DataFrame) -> DataFrame:
    """One row per record of (file, no, value), numbered lines: seqid, its coordinates, sim and n_features.

    Consecutive feature lines are a record; any line that starts with ``#`` ends it; lines of
    fewer than five columns are ignored. A record is good with six features, taken by position;
    ``bad`` marks the others, whose coordinates are null. A missing similarity is 0.
    """
    bucket = F.floor(F.col("no") / 65536)
    rows = before(lines.withColumn("mark", F.col("value").startswith("#").cast("long")), "mark", "record", ["file"], ["no"], bucket, "sum")
    cells = F.split("value", "\t")
    rows = rows.where((F.col("mark") == 0) & (F.size(cells) >= 5)).select("file", "record", F.struct("no", F.get(cells, 0).alias("seqid"), F.get(cells, 3).cast("long").alias("start"), F.get(cells, 4).cast("long").alias("stop"), F.coalesce(F.get(cells, 8), F.lit("")).alias("more")).alias("x"))
    records = rows.groupBy("file", "record").agg(F.sort_array(F.collect_list("x")).alias("x"))
    good = F.size("x") == FEATURES
    pairs = [F.when(good, F.get("x", k)[c]) for k in (0, 1, 2, 3, 4, 5) for c in ("start", "stop")]
    score = F.regexp_extract(F.array_join(F.transform("x", lambda f: f["more"]), ";"), r"tir_similarity=([0-9.]+)", 1)
    return records.select("file", "record", F.get("x", 0)["seqid"].alias("seqid"), *[v.alias(n) for n, v in zip(COORDINATES, pairs, strict=True)], F.when(good, F.when(score == "", 0.0).otherwise(score.cast("double"))).alias("sim"), F.size("x").alias("n_features"), (~good).alias("bad"))


def read_gff(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return gff_records(files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("no", "value")).where("value <> ''"))


def multiset_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, as often as it lacks them, with ``side``."""
    right = right.select(*left.columns)
    only = left.exceptAll(right).withColumn("side", F.lit("left"))
    return only.unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
