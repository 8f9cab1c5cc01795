"""Sequence files as contig tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palindra.functions.running import before

#: Letters of an id that put it with others for numbering.
_ALIKE = 8
SCHEMA = "file string, contig_no long, seqid string, seq string"


def parse_fasta(files: DataFrame) -> DataFrame:
    """Contigs of (file, value), whole FASTA files: records from ``>`` at a line's start.

    The id is the header up to the first white space; lines are joined, white space dropped,
    letters raised. Order in the file is contig_no. Whatever comes before the first record is
    ignored; an empty file has no rows.
    """
    records = files.select("file", F.posexplode(F.split(F.concat(F.lit("\n"), "value"), "\n>")).alias("no", "record")).where("no > 0")
    header = F.regexp_extract("record", r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("record", r"^[^\n]*\n?", ""), r"\s", "")
    return records.select("file", (F.col("no") - 1).cast("long").alias("contig_no"), F.regexp_extract(header, r"^(\S*)", 1).alias("seqid"), F.upper(body).alias("seq"))


def parse_fastq(files: DataFrame) -> DataFrame:
    """Contigs of (file, value), whole FASTQ files of four lines a record."""
    lines = F.filter(F.split("value", "\r?\n"), lambda x: x != "")
    rows = files.select("file", lines.alias("lines")).where(F.size("lines") >= 4)
    records = rows.select("file", "lines", F.explode(F.sequence(F.lit(0), (F.size("lines") / 4).cast("int") - 1)).alias("no"))
    line = lambda k: F.get("lines", F.col("no") * 4 + k)
    return records.select("file", F.col("no").cast("long").alias("contig_no"), F.regexp_extract(line(0), r"^@?(\S*)", 1).alias("seqid"), F.upper(F.regexp_replace(line(1), r"\s", "")).alias("seq"))


def _whole(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def read_sequences(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Contigs of FASTA and FASTQ files, gzipped where the name says so.

    A file is FASTQ if its first character is ``@``. Each file is an independent fragment.
    """
    files = _whole(spark, [paths] if isinstance(paths, str) else list(paths))
    fastq = F.ltrim("value").startswith("@")
    return parse_fasta(files.where(~fastq)).unionByName(parse_fastq(files.where(fastq)))


def read_manifest(spark: SparkSession, manifest: str) -> list[str]:
    """Paths in a text file, one a line, trimmed, blank lines dropped, in their order."""
    rows = spark.read.text(manifest, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("no", "path"))
    return [r.path for r in rows.select("no", F.trim("path").alias("path")).where("path <> ''").orderBy("no").collect()]


def contigs_of(rows: DataFrame, seq: str = "seq", seqid: str = "seqid", file: str | None = None) -> DataFrame:
    """Any table of sequences as contigs: ordered by id within its file, those of one id by their letters.

    Rows are numbered by the counts of ids that begin alike and the order within these, so that no task has a
    whole file. Null ids come first.
    """
    rows = rows.select((F.col(file) if file else F.lit("table")).alias("file"), F.col(seqid).cast("string").alias("seqid"), F.col(seq).alias("seq"), F.lit(1).cast("long").alias("one"))
    numbered = before(rows, "one", "no", ["file"], ["seqid", "seq"], F.coalesce(F.substring("seqid", 1, _ALIKE), F.lit("")), "sum")
    return numbered.select("file", F.col("no").cast("long").alias("contig_no"), "seqid", "seq")
