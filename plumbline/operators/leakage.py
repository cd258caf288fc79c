"""Overlap and disjointness checks between sets, parts and stages.

Every check is one aggregation on the key: flags are combined on the map side, so
a key with very many rows costs one row per partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import as_col


def _flagged(a: DataFrame, b: DataFrame, key: Column | str) -> DataFrame:
    left = a.select(as_col(key).alias("key"), F.lit(True).alias("in_a"), F.lit(False).alias("in_b"))
    right = b.select(as_col(key).alias("key"), F.lit(False).alias("in_a"), F.lit(True).alias("in_b"))
    return (left.unionByName(right).filter(F.col("key").isNotNull()).groupBy("key")
            .agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b")))


def overlap(a: DataFrame, b: DataFrame, key: Column | str) -> DataFrame:
    """One row: distinct keys of either side and how many they share."""
    return _flagged(a, b, key).agg(
        F.count_if("in_a").alias("n_a"), F.count_if("in_b").alias("n_b"),
        F.count_if(F.col("in_a") & F.col("in_b")).alias("n_both"))


def same_set(a: DataFrame, b: DataFrame, key: Column | str) -> DataFrame:
    """One row: are the key sets equal, are they disjoint."""
    return overlap(a, b, key).select(
        ((F.col("n_a") == F.col("n_both")) & (F.col("n_b") == F.col("n_both"))).alias("equal"),
        (F.col("n_both") == 0).alias("disjoint"))


def missing(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Distinct expected keys that are not present."""
    return expected.select(key).distinct().join(present.select(key), key, "left_anti")


def disjoint_check(df: DataFrame, key: Column | str, part: str = "part",
                   parts: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Shared keys of every pair of parts; each must be 0."""
    seen = df.groupBy(as_col(key).alias("key")).agg(
        *[F.coalesce(F.max(F.col(part) == p), F.lit(False)).alias(f"in_{i}")
          for i, p in enumerate(parts)])
    pairs = list(combinations(range(len(parts)), 2))
    counts = seen.filter(F.col("key").isNotNull()).agg(
        *[F.count_if(F.col(f"in_{i}") & F.col(f"in_{j}")).alias(f"n_{i}_{j}") for i, j in pairs])
    rows = F.array(*[F.struct(F.lit(parts[i]).alias("part_a"), F.lit(parts[j]).alias("part_b"),
                              F.col(f"n_{i}_{j}").alias("n_shared")) for i, j in pairs])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def assert_disjoint(df: DataFrame, key: Column | str, part: str = "part") -> None:
    spread = df.groupBy(as_col(key)).agg((F.min(part) != F.max(part)).alias("split"))
    n = spread.filter("split").count()
    if n:
        raise ValueError(f"{n} keys occur in more than one part")


def cross_stage_overlap(first: DataFrame, second: DataFrame, ids: str, group: str,
                        part: str = "part", label: str = "label") -> DataFrame:
    """Held-out rows of the second stage against the training rows of the first.

    Two rows, ``clips`` and ``groups``: size of the held-out set and how much of it
    the first stage was trained on.  Clips are compared for genuine rows only.  Each stage is
    read once, and clips and groups are counted in one aggregation.
    """
    yes, no = F.lit(True), F.lit(False)
    genuine = F.when(F.col(label) == 0, F.col(ids).cast("string"))

    def keys(rows: DataFrame, clip: Column, seen: Column, held: Column) -> DataFrame:
        both = F.array(F.struct(F.lit("clips").alias("subject"), clip.alias("key")),
                       F.struct(F.lit("groups").alias("subject"), F.col(group).cast("string").alias("key")))
        return rows.select(F.explode(both).alias("k"), seen.alias("seen"), held.alias("held")).select(
            "k.subject", "k.key", "seen", "held")

    train = keys(first.filter(F.col(part) == "train"), F.col(ids).cast("string"), yes, no)
    test = keys(second.filter(F.col(part) == "test"), genuine, no, yes)
    flags = (train.unionAll(test).filter(F.col("key").isNotNull()).groupBy("subject", "key")
             .agg(F.max("seen").alias("seen"), F.max("held").alias("held")))

    def numbers(subject: str) -> list[Column]:
        own = F.col("held") & (F.col("subject") == subject)
        return [F.count_if(own).alias(f"{subject}_held"), F.count_if(own & F.col("seen")).alias(f"{subject}_seen")]

    row = flags.agg(*numbers("clips"), *numbers("groups"))
    rows = F.array(*[F.struct(F.lit(s).alias("subject"), F.col(f"{s}_held").alias("n_heldout"),
                              F.col(f"{s}_seen").alias("n_seen")) for s in ("clips", "groups")])
    return row.select(F.explode(rows).alias("r")).select("r.*")


# -- membership masks ----------------------------------------------------------------

def marks(space: str, key: Column | str, conditions: Mapping[int, Column]) -> Column:
    """struct(space, key, mask): the bits whose condition holds for the row; NULL where none
    does or the key is NULL.  Bits are powers of two."""
    name = as_col(key).cast("string")
    bits = reduce(lambda a, b: a.bitwiseOR(b), [
        F.when(when, F.lit(bit)).otherwise(F.lit(0)) for bit, when in conditions.items()])
    return F.when((bits != 0) & name.isNotNull(),
                  F.struct(F.lit(space).alias("space"), name.alias("key"), bits.alias("mask")))


def mask_counts(rows: Sequence[DataFrame]) -> DataFrame:
    """(space, mask, n): how many keys of a space belong to exactly the sets of a mask.

    ``rows`` hold a column ``marks``, an array of :func:`marks`.  The masks of a key are put
    together with one ``bit_or`` that combines on the map side; what comes out has at most
    two to the number of bits rows a space, and answers every overlap and disjointness check.
    """
    each = reduce(DataFrame.unionAll, [
        r.select(F.inline(F.filter("marks", lambda m: m.isNotNull()))) for r in rows])
    masks = each.groupBy("space", "key").agg(F.bit_or("mask").alias("mask"))
    return masks.groupBy("space", "mask").agg(F.count("*").alias("n"))


def in_all(space: str, *bits: int) -> Column:
    """Aggregate over :func:`mask_counts`: keys of a space that belong to all of the sets."""
    want = F.lit(sum(bits))
    hit = (F.col("space") == space) & (F.col("mask").bitwiseAND(want) == want)
    return F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))


def part_sizes(df: DataFrame, part: str = "part",
               expected: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Rows of every expected part, 0 for empty ones."""
    counts = df.agg(*[F.count_if(F.col(part) == p).alias(p) for p in expected])
    rows = F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("n")) for p in expected])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def assert_nonempty(df: DataFrame, part: str = "part",
                    expected: Sequence[str] = ("train", "val", "test")) -> None:
    empty = [r["part"] for r in part_sizes(df, part, expected).filter("n = 0").collect()]
    if empty:
        raise ValueError(f"empty parts: {empty}")
