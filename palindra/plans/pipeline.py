"""The whole search as one plan, with every stage at hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palindra.functions.sequence import two_decimals
from palindra.operators import extension, overlap, repeats, similarity, tsd
from palindra.plans.params import Params
from palindra.sources.shared import checkpointed

COORDINATES = ["full_start", "full_stop", "tsd1_start", "tsd1_stop", "body_start", "body_stop", "tir1_start", "tir1_stop", "tir2_start", "tir2_stop", "tsd2_start", "tsd2_stop"]


def element_columns(rows: DataFrame) -> DataFrame:
    """1-based inclusive contig coordinates of the six parts of each element."""
    full_start, full_stop, body_start, body_stop = F.col("lts") - F.col("tsd") + 1, F.col("rte") + F.col("tsd") + 1, F.col("lts") + 1, F.col("rte") + 1
    one = F.struct((F.col("lts") + 1).alias("s"), (F.col("lte") + 1).alias("e"))
    two = F.struct((F.col("rts") + 1).alias("s"), (F.col("rte") + 1).alias("e"))
    low, high = F.least(one, two), F.greatest(one, two)
    values = [full_start, full_stop, full_start, body_start - 1, body_start, body_stop, low["s"], low["e"], high["s"], high["e"], body_stop + 1, full_stop]
    return rows.select("file", "contig_no", *[v.alias(n) for v, n in zip(values, COORDINATES, strict=True)], "sim")


def stages(contigs: DataFrame, params: Params | None = None, size: int = repeats.TILE, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> dict[str, DataFrame]:
    """Seeds, arms, passed (by length), duplicated, compared, narrow, clustered, best and elements.

    ``narrow``, the candidates without their strings, is read several times and so held by ``keep``: persisted by
    default, then ``unpersist`` it when done. ``seqid`` and coordinates are joined to the best only.
    """
    p = params or Params()
    stretches = repeats.tiles(contigs, p, size)
    out = {"seeds": repeats.seeds(contigs, p, size, stretches)}
    out["arms"] = extension.arms(contigs, p, size, stretches)
    out["passed"] = extension.length_gate(out["arms"], p)
    out["duplicated"] = tsd.find_tsd(out["passed"], p)
    out["compared"] = similarity.arm_similarity(out["duplicated"], p)
    slim = out["compared"].select("file", "contig_no", *overlap.ORDER, "lte", "rte", "tsd", "sim", "skip")
    out["narrow"] = slim = keep(slim)
    out["clustered"] = overlap.clusters(slim)
    out["best"] = overlap.best_per_cluster(out["clustered"])
    names = contigs.select("file", F.col("contig_no").cast("long").alias("contig_no"), "seqid")
    out["elements"] = element_columns(out["best"]).join(names, ["file", "contig_no"]).select("file", "seqid", *COORDINATES, "sim")
    return out


def find_elements(contigs: DataFrame, params: Params | None = None, size: int = repeats.TILE) -> DataFrame:
    """(file, seqid, twelve coordinates, sim): the terminal-inverted-repeat elements of ``contigs``.

    ``contigs`` has file, contig_no (its order in the file), seqid and seq. Files are independent.
    The candidates are found at once and held in the shared folder, so nothing stays in the session's cache.
    """
    return stages(contigs, params, size, checkpointed)["elements"]


def formatted(elements: DataFrame) -> DataFrame:
    """Elements as written: sorted by sequence and start within each file, ``sim`` with two decimals."""
    return elements.orderBy("file", "seqid", *COORDINATES).withColumn("sim", two_decimals(F.col("sim")))
