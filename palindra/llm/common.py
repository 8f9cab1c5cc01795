"""What the operators share: reading tables, cutting lineage, batches of rows in Python."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of code points other than ASCII white space, everywhere.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that a Python worker holds as arrays at a time.
CHUNK_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _checkpoint_dir(spark: SparkSession) -> None:
    if not spark.conf.get("spark.checkpoint.dir", "") and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="palindra-"))


def cut(df: DataFrame, dealt: bool = False) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, free of its lineage.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset, as in
    tests on one machine, a temporary folder takes its place. With ``dealt``, Spark goes on to
    know by which keys the rows are dealt, and later joins on them move nothing: an adaptive plan
    would not tell.
    """
    spark = df.sparkSession
    _checkpoint_dir(spark)
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    try:
        if dealt:
            spark.conf.set(name, "false")
        out = df.checkpoint(True)
    finally:
        spark.conf.set(name, before)
    del df
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more.

    It does so when the driver's garbage is collected, which a driver with little to do may put
    off until the disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes the shuffle files of a plan when the plan has run.

    ``release`` does not reach the plan that ran last: its files stay while the next ones are written.
    Only for what is made and run once within: a second run of the same DataFrame would miss its files.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def store(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder, and read again."""
    spark = df.sparkSession
    _checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    with swept(spark):
        df.write.parquet(path)
    return spark.read.parquet(path)


def word_count(text) -> F.Column:
    """Words of ``text``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most ``rows`` rows of text go to a Python worker at a time, so that memory stays bounded."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


#: Ids from here on stand for missing ones within an operator, and sort behind usual ones.
UNNAMED = 1 << 62


def unnamed(*content) -> F.Column:
    """An id for rows that have none, from what they hold."""
    return F.xxhash64(*content).bitwiseAND(F.lit(UNNAMED - 1)).bitwiseOR(F.lit(UNNAMED))


def utf8_size(text) -> F.Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def byte_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (all its bytes, the n + 1 offsets); null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.fill_null(b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def pieces(batch: pa.RecordBatch, text: str | int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``limit`` bytes of ``text``, a row at least."""
    if not batch.num_rows:
        return
    _, at = byte_views(batch.column(text if isinstance(text, int) else batch.schema.get_field_index(text)))
    start, n = 0, batch.num_rows
    while start < n:
        end = max(start + 1, int(np.searchsorted(at, at[start] + limit, side="right")) - 1)
        yield batch.slice(start, min(end, n) - start)
        start = min(end, n)
