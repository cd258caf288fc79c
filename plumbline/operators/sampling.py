"""Selections inside groups: first k, evenly spaced k, most common values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import as_col
from ..functions.vectors import SLOTS
from .order import GROUP_ROWS, ranked, top_per_group


def first_k(df: DataFrame, key: str, order: Sequence[Column | str], k: int = SLOTS) -> DataFrame:
    """First ``k`` rows of every key."""
    return top_per_group(df, [key], order, k)


def uniform_k(df: DataFrame, key: str, order: Sequence[Column | str],
              k: int = SLOTS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``k`` evenly spaced rows per key, positions truncated to whole numbers.

    Slot ``i`` takes position ``floor(i*(n-1)/(k-1))`` of the ordered group, so a
    group shorter than ``k`` repeats rows.  Rows without a slot are dropped before
    the slots are expanded.
    """
    if k < 1:
        raise ValueError("k must be positive")
    rows = ranked(df, [key], order, "_rank", size="_n", group_rows=group_rows)
    pos, last = F.col("_rank") - 1, F.col("_n") - 1
    step = max(k - 1, 1)
    # Slots i with floor(i*last/step) == pos are the run from ceil(pos*step/last) up to, but
    # without, ceil((pos+1)*step/last).  Rows whose run is empty go before slots are made.
    span = F.greatest(last, F.lit(1))
    low = F.when(last == 0, F.lit(0)).otherwise(F.ceil(pos * step / span))
    high = F.when(last == 0, F.lit(k)).otherwise(F.least(F.lit(k), F.ceil((pos + 1) * step / span)))
    chosen = (rows.withColumn("pos", pos).withColumn("_low", low.cast("int"))
              .withColumn("_high", high.cast("int")).filter(F.col("_low") < F.col("_high")))
    return (chosen.withColumn("slot", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)))
            .drop("_rank", "_n", "_low", "_high"))


def top_values(df: DataFrame, col: Column | str, n: int, out: str = "value") -> DataFrame:
    """The ``n`` most common values with their counts, ties in value order."""
    return (df.groupBy(as_col(col).alias(out)).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), F.asc(out)).limit(n))
