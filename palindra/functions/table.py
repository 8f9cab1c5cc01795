"""Repeats as a table function of SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import Row

from palindra.functions.packed import codes
from palindra.operators.repeats import tile_seeds
from palindra.plans.params import Params


@udtf(returnType="file string, contig_no bigint, a bigint, b bigint, len bigint")
class MaximalRepeats:
    """Maximal exact inverted repeats of the contigs of a table argument of (file, contig_no, seq), as ``repeats.seeds`` has them."""

    def eval(self, row: Row, seed: int, max_arm: int, min_distance: int, max_distance: int) -> Iterator[tuple]:
        code = codes((row["seq"] or "").upper())
        p = Params(seed=seed, max_arm=max_arm, min_distance=min_distance, max_distance=max_distance)
        a, b, length = tile_seeds(code, np.array([0, len(code)]), np.array([0]), np.array([len(code)]), p)
        for x in zip(a.tolist(), b.tolist(), length.tolist(), strict=True):
            yield (row["file"], row["contig_no"], *x)


def register(spark: SparkSession, name: str = "maximal_repeats") -> None:
    """``SELECT * FROM maximal_repeats(TABLE(contigs) PARTITION BY (file, contig_no), 20, 1000, 10, 5000)``.

    The numbers are the shortest and longest repeat and the distance between starts. A contig is a task's; its letters need not be capital.
    """
    spark.udtf.register(name, MaximalRepeats)
