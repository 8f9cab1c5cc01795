"""Writing elements."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palindra.functions.sequence import two_decimals
from palindra.plans.pipeline import formatted

HEADER = ["seqid", "full_start", "full_stop", "tsd1_start", "tsd1_stop", "body_start", "body_stop", "tir1_start", "tir1_stop", "tir2_start", "tir2_stop", "tsd2_start", "tsd2_stop", "sim"]


def to_tsv(elements: DataFrame) -> str:
    """The rows of one fragment as text: a header, then tab-separated lines in order."""
    rows = formatted(elements).select(*HEADER)
    return "".join("\t".join(map(str, r)) + "\n" for r in [HEADER, *rows.collect()])


def write_tsv(elements: DataFrame, path: str) -> None:
    """One sorted tab-separated file with a header under ``path``."""
    formatted(elements).select(*HEADER).coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_fragments(elements: DataFrame, path: str, files: list[str] | None = None, suffix: str = ".elements.tsv") -> None:
    """One file ``<stem><suffix>`` per fragment under ``path``: a header, then its rows in order.

    All fragments are written at once, each by one task, and then named. ``files`` are all
    fragments; those without elements get a header alone. Where two files of different folders
    have one stem, all of that stem but the first path in order get a checksum of their path too.
    """
    spark = elements.sparkSession
    given = spark.createDataFrame([(f,) for f in files or []], "file string").select(F.regexp_replace("file", "^(file:)?/+", "/").alias("file"))
    rows = elements.withColumn("file", F.regexp_replace("file", "^(file:)?/+", "/")).withColumn("sim", two_decimals(F.col("sim")))
    all_ = rows.select("file").union(given).distinct()
    stem = F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    names = all_.withColumn("stem", stem).withColumn("place", F.row_number().over(Window.partitionBy("stem").orderBy("file")))
    names = names.select("file", F.when(F.col("place") == 1, F.col("stem")).otherwise(F.concat("stem", F.lit("-"), F.crc32(F.col("file").cast("binary")).cast("string"))).alias("fragment"))
    there = f"{path.rstrip('/')}/_fragments-{uuid.uuid4().hex}"
    lines = names.join(rows, "file", "left").withColumn("text", F.when(F.col("seqid").isNotNull(), F.concat_ws("\t", *HEADER)))
    heads = names.select("fragment", F.lit(None).cast("string").alias("seqid"), F.lit(None).cast("long").alias("full_start"), F.lit("\t".join(HEADER)).alias("text"))
    body = lines.where("text IS NOT NULL").select("fragment", "seqid", "full_start", "text")
    heads.unionByName(body).repartition("fragment").sortWithinPartitions("fragment", F.col("seqid").asc_nulls_first(), "full_start", "text").select("text", "fragment").write.partitionBy("fragment").text(there)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(there).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in sorted(r.fragment for r in names.select("fragment").collect()):
        part = [x.getPath() for x in fs.listStatus(hadoop(f"{there}/fragment={_escaped(name)}")) if x.getPath().getName().startswith("part-")]
        to = hadoop(f"{path.rstrip('/')}/{name}{suffix}")
        fs.delete(to, False)
        if len(part) != 1 or not fs.rename(part[0], to):
            raise OSError(f"no single file for fragment {name}")
    fs.delete(hadoop(there), True)


def _escaped(name: str) -> str:
    """``name`` as Spark names a partition's folder."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in "\"#%'*/:=?\\\x7f{[]^" else c for c in name)


def write_parquet(elements: DataFrame, path: str) -> None:
    elements.write.mode("overwrite").parquet(path)
