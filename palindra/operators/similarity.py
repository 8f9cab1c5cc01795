"""The similarity gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palindra.plans.params import Params


def arm_similarity(arms: DataFrame, params: Params) -> DataFrame:
    """``arms`` with ``left_arm``, ``edit_distance`` and ``sim``; ``skip`` where below the gate.

    The left arm starts after the duplication, the right arm is the one before it was moved; both
    lack their last base. Special bases equal each other here. The distance is banded: beyond the
    band the row is skipped and ``sim`` is null, as it is for rows skipped before.
    """
    start = F.col("left_start") if "left_start" in arms.columns else F.greatest(F.lit(0), F.col("lts") - params.vicinity)
    left = F.substr("left_text", (F.col("lts") - start + 1).cast("int"), (F.col("lte") - F.col("lts")).cast("int"))
    arms = arms.withColumn("left_arm", F.when(~F.col("skip"), left))
    longer = F.greatest(F.length("left_arm"), F.length("right_arm"))
    arms = arms.withColumn("_band", (F.floor(longer * (100.0 - params.similar) / 100.0) + 2).cast("int"))
    distance = F.expr("levenshtein(left_arm, right_arm, _band)")
    arms = arms.withColumn("edit_distance", F.when(distance >= 0, distance)).drop("_band")
    sim = F.lit(100.0) * (F.lit(1.0) - F.col("edit_distance") / longer)
    arms = arms.withColumn("sim", F.when(longer == 0, 100.0).otherwise(sim))
    return arms.withColumn("skip", F.col("skip") | F.coalesce(F.col("sim") < params.similar, F.lit(True)))
