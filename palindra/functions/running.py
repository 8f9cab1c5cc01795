"""Running totals and maxima over long orders, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def before(df: DataFrame, value: str, out: str, keys: list[str], order: list[str], bucket: Column, how: str) -> DataFrame:
    """``df`` with ``out``: the sum or max of ``value`` over the rows before, by ``order`` within ``keys``.

    ``bucket`` must not fall along the order. Each bucket is folded by itself, then the buckets'
    totals are, then each row adds what lies before its bucket.
    """
    fold = {"sum": F.sum, "max": F.max}[how]
    df = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "_bucket").agg(fold(value).alias("_total")).withColumn("_carried", fold("_total").over(across)).drop("_total")
    rows = df.withColumn("_inside", fold(value).over(inside)).join(totals, [*keys, "_bucket"])
    both = F.coalesce("_inside", F.lit(0)) + F.coalesce("_carried", F.lit(0)) if how == "sum" else F.greatest("_inside", "_carried")
    return rows.withColumn(out, both).drop("_bucket", "_inside", "_carried")
