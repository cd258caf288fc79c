"""Batches of bounded padded size from rows of unequal length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import as_col
from ..functions.vectors import MAX_WIDTH, pad_to
from ..session import join_summary, settle
from .order import order_key, ranked


def length_batches(df: DataFrame, length: Column | str, ids: Sequence[str], budget: int,
                   max_length: int = MAX_WIDTH, step: int = 8, seed: int = 42) -> DataFrame:
    """Every row with its ``batch`` (0, 1, ...), so that no batch costs more than ``budget``
    when it is padded to its longest row.

    Lengths are cut to ``max_length`` and rounded up to multiples of ``step``; rows of one
    rounded length stand together, in the seeded order of ``ids``.  The cost in front of a row
    is its place times that length, and a batch ends where it would pass the budget.  Places come
    from range partitions and their counts, so one length may hold any share of the rows.
    A null length counts as 0, and every row costs ``step`` at least.
    """
    widest = -(-max(max_length, 1) // step) * step
    if budget < widest:
        raise ValueError(f"a row of {widest} does not fit a budget of {budget}")
    real = F.least(F.greatest(F.coalesce(as_col(length).cast("bigint"), F.lit(0)), F.lit(0)), F.lit(max_length))
    rounded = F.greatest(F.ceil(real / step), F.lit(1)).cast("bigint") * step
    rows = df.withColumn("_wide", rounded).withColumn("_key", order_key(ids, seed))
    per = F.floor(F.lit(budget) / F.col("_wide"))
    # At most max_length / step rows from here to the offsets.
    counts = rows.groupBy("_wide").agg(F.count("*").alias("_n")).withColumn("_batches", F.ceil(F.col("_n") / per))
    before = W.partitionBy(F.lit(0)).orderBy("_wide").rowsBetween(W.unboundedPreceding, -1)
    offsets = settle(counts.select("_wide", F.coalesce(F.sum("_batches").over(before), F.lit(0)).alias("_from")))
    placed = join_summary(ranked(rows, ["_wide"], ["_key"], "_place"), offsets, ["_wide"], "inner", small=True)
    batch = F.col("_from") + F.floor((F.col("_place") - 1) / per)
    return placed.withColumn("batch", batch.cast("bigint")).drop("_wide", "_key", "_place", "_from")


def batch_report(batches: DataFrame, length: Column | str, max_length: int = MAX_WIDTH) -> DataFrame:
    """One row: batches, rows, cells that are real and cells in all when every batch is padded
    to its longest row, the costliest batch, and the share of padding."""
    real = F.least(F.greatest(F.coalesce(as_col(length).cast("bigint"), F.lit(0)), F.lit(0)), F.lit(max_length))
    each = batches.select("batch", real.alias("_l")).groupBy("batch").agg(
        F.count("*").alias("n"), F.sum("_l").alias("real"), (F.count("*") * F.max("_l")).alias("cost"))
    cells = F.coalesce(F.sum("cost"), F.lit(0))
    return each.agg(
        F.count("*").alias("n_batches"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("real"), F.lit(0)).alias("real_cells"), cells.alias("cells"), F.max("cost").alias("largest"),
        F.try_divide(cells - F.sum("real"), cells).alias("padding"))


def collate(batches: DataFrame, arr: str, ids: Sequence[str], max_length: int = MAX_WIDTH) -> DataFrame:
    """One row per batch: ``items`` in the order of ``ids``, each with its ids, the values padded to
    the longest of the batch, and the real length.  The budget bounds what a row holds."""
    cut = F.slice(F.coalesce(as_col(arr).cast("array<double>"), F.array().cast("array<double>")), 1, max_length)
    items = F.array_sort(F.collect_list(F.struct(*ids, cut.alias("v"))))
    rows = batches.groupBy("batch").agg(items.alias("_i"), F.max(F.size(cut)).alias("width"))
    padded = F.transform("_i", lambda i: F.struct(*[i[c].alias(c) for c in ids], pad_to(i["v"], F.col("width")).alias("p")))
    return rows.select("batch", "width", padded.alias("_p")).select("batch", "width", F.transform("_p", lambda i: F.struct(
        *[i[c].alias(c) for c in ids], i["p"]["values"].alias("values"), i["p"]["length"].alias("length"))).alias("items"))
