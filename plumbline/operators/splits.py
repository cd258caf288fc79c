"""Train / val / test assignment: by stratum, by group count, by cumulative rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import as_col
from ..session import join_summary
from .order import Cuts, cut_points, order_key, place

# Part names, ratios and seed of the published protocol.
PARTS = ("train", "val", "test")
RATIOS = (0.8, 0.1, 0.1)
SEED = 42


def _floors(ratios: Sequence[float]):
    def targets(n: Column) -> list[Column]:
        first = F.floor(n * F.lit(float(ratios[0])))
        return [first, first + F.floor(n * F.lit(float(ratios[1])))]
    return targets


def _rounds(ratios: Sequence[float]):
    def targets(n: Column) -> list[Column]:
        first = F.bround(n * F.lit(float(ratios[0])), 0).cast("bigint")
        return [first, first + F.bround(n * F.lit(float(ratios[1])), 0).cast("bigint")]
    return targets


def _keyed(df: DataFrame, keys: Sequence[Column | str]) -> tuple[DataFrame, list[str]]:
    """Give computed keys a name, so that every key may be a column name or a Column."""
    names = []
    for i, k in enumerate(keys):
        if isinstance(k, str):
            names.append(k)
        else:
            names.append(f"_key_{i}")
            df = df.withColumn(names[-1], k)
    return df, names


def stratified_split(df: DataFrame, strata: Sequence[Column | str], ids: Sequence[str],
                     ratios: Sequence[float] = RATIOS, seed: int = SEED,
                     out: str = "part") -> DataFrame:
    """Per stratum: floor(n*r0) rows to train, floor(n*r1) to val, the rest to test.

    ``ids`` identify a row.  Rows with equal ids stay together.
    """
    columns = df.columns
    df, names = _keyed(df, strata)
    key = order_key(ids, seed)
    units = df.select(*names, key.alias("_k"))
    cuts = cut_points(units, names, "_k", None, _floors(ratios))
    return place(df, cuts, key, PARTS, out).select(*columns, out)


def _group_cuts(df: DataFrame, key: Column | str, ratios: Sequence[float], seed: int,
                by_rows: bool) -> Cuts:
    groups = df.groupBy(as_col(key).alias("_g")).agg(F.count("*").alias("_n"))
    units = groups.select(order_key(["_g"], seed).alias("_k"), "_n")
    if by_rows:
        return cut_points(units, [], "_k", "_n", _floors(ratios))
    return cut_points(units, [], "_k", None, _rounds(ratios))


def group_partition(df: DataFrame, key: str, ratios: Sequence[float] = RATIOS,
                    seed: int = SEED, out: str = "part") -> DataFrame:
    """One row per distinct group with its part; part sizes count groups, not rows.

    Build it once from the union of all stages' groups, store it, and join it
    everywhere with :func:`apply_partition`.
    """
    groups = df.select(key).distinct()
    cuts = _group_cuts(groups, key, ratios, seed, by_rows=False)
    return place(groups, cuts, order_key([key], seed), PARTS, out)


def split_by_group(df: DataFrame, key: Column | str, ratios: Sequence[float] = RATIOS,
                   seed: int = SEED, out: str = "part") -> DataFrame:
    """Rows with the part of their group.

    The part depends only on how the group's own key compares with two boundary
    keys, so the rows are neither shuffled nor joined with the group table and the
    size of a group does not matter.
    """
    cuts = _group_cuts(df, key, ratios, seed, by_rows=False)
    return place(df, cuts, order_key([key], seed), PARTS, out)


def group_aware_split(df: DataFrame, key: Column | str, ratios: Sequence[float] = RATIOS,
                      seed: int = SEED, out: str = "part") -> DataFrame:
    """Rows by group, where a group goes to the part its preceding row count falls in."""
    cuts = _group_cuts(df, key, ratios, seed, by_rows=True)
    return place(df, cuts, order_key([key], seed), PARTS, out)


def apply_partition(df: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """Join a stored partition table; rows of unknown groups are dropped."""
    return join_summary(df, parts, [key], "inner")


def fold_of(df: DataFrame, ids: Sequence[str], folds: int = 10, seed: int = SEED,
            out: str = "fold") -> DataFrame:
    """Cross-validation fold 0..folds-1: equal consecutive slices of the seeded order."""
    key = order_key(ids, seed)

    def targets(n: Column) -> list[Column]:
        return [F.floor(n * F.lit(i) / F.lit(folds)) for i in range(1, folds)]

    cuts = cut_points(df.select(key.alias("_k")), [], "_k", None, targets)
    return place(df, cuts, key, list(range(folds)), out)


def parts_where(df: DataFrame, part: str, name: Column | str = "part") -> DataFrame:
    return df.filter(as_col(name) == part)
