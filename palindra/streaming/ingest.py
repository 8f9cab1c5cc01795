"""Fragments that arrive in a folder, searched as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from palindra.plans.params import Params
from palindra.plans.pipeline import stages
from palindra.sources.fasta import parse_fasta


def watch_fragments(spark: SparkSession, folder: str, out: str, checkpoint: str, params: Params | None = None) -> StreamingQuery:
    """A query that searches each new FASTA file of ``folder`` and appends its elements to ``out``.

    Files are independent, so a batch of files is an ordinary search. Batches are written under
    their number, overwriting, so that a repeated batch leaves no rows twice.
    """

    def search(files: DataFrame, batch: int) -> None:
        found = stages(parse_fasta(files), params)
        found["elements"].write.mode("overwrite").parquet(f"{out}/batch={batch}")
        found["narrow"].unpersist()

    files = spark.readStream.format("text").option("wholetext", True).load(folder).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.writeStream.foreachBatch(search).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
