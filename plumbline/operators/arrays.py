"""Array operators that need more than one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import pad_to
from ..session import join_summary


def pad_to_max(df: DataFrame, arr: str, by: str, cap: int | None = None,
               out: str = "padded") -> DataFrame:
    """Pad every array to the longest of its batch; ``length`` counts the real values.

    With ``cap`` longer arrays are cut to it, and ``length`` is the cut one.
    """
    longest = F.max(F.size(arr))
    widest = df.groupBy(by).agg((longest if cap is None else F.least(longest, F.lit(cap))).alias("_w"))
    return join_summary(df, widest, [by]).withColumn(out, pad_to(arr, F.col("_w"))).drop("_w")


def pool_long(df: DataFrame, key: str, vec: str, weight: Column | str) -> DataFrame:
    """Weighted sum of a key's vectors as (key, pos, value), summed on the map side.

    For keys with any number of vectors; the array form is ``weighted_pool``.
    """
    w = F.col(weight) if isinstance(weight, str) else weight
    long = df.select(key, w.cast("double").alias("_w"), F.posexplode(vec).alias("pos", "_x"))
    return long.groupBy(key, "pos").agg(F.sum(F.col("_x").cast("double") * F.col("_w")).alias("value"))
